"""Task, resource, worker time and memory statistics from the text of log lines.

The patterns follow the line formats of a Spark executor and of the YARN
allocator. All numbers are cast without failing: what does not fit is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.functions import logtext, paths
from waybill.operators.quantiles import SECONDS, exact_percentile

# Line formats.
TASK = r"(?:Running|Finished) task \d+\.\d+ in stage (\d+\.\d+ \(TID \d+)\)"
REQUEST = (
    r"Will request (\d+) executor containers, each with (\d+) cores and (\d+) MB memory"
    r"(?: including (\d+) MB overhead)?"
)
PYTHON = r"Times: total = (-?\d+), boot = (-?\d+), init = (-?\d+), finish = (-?\d+)"
SPLIT = r"Input split: (\S+):(\d+)\+(\d+)"
BLOCK = r"Block (\S+) stored as \S+ in memory \(estimated size ([\d.]+) (\w+), free ([\d.]+) (\w+)\)"
CAPACITY = r"MemoryStore started with capacity ([\d.]+) (\w+)"
# Bytes per unit.
UNIT_BYTES = {"B": 1} | {
    prefix + end: 2 ** (10 * i) for i, prefix in enumerate("KMGTPE", 1) for end in ("B", "iB")
}
CONTAINER = r"Container request \(host: (\S+), capability: <memory:(\d+), vCores:(\d+)>"
FAILED = r"(?:Exception in|Lost) task (\d+)\.(\d+) in stage (\d+\.\d+) \(TID (\d+)"
READING = r"Started reading broadcast variable (\d+)"
FOUND = r"Found block (\S+) (locally|remotely)"


def _part(pattern: str, group: int) -> Column:
    return F.regexp_extract("value", pattern, group)


def _matched(lines: DataFrame, word: str, pattern: str, *keep: Column | str) -> DataFrame:
    """``file_path``, and ``m``: the part of a line that fits the pattern, for lines with a word.

    The pattern is searched once per line. Groups are taken from the few characters of ``m``
    afterwards; the filter is on the size of an array, which is not pushed below the search.
    """
    found = F.regexp_extract_all("value", F.lit(pattern), F.lit(0)).alias("_all")
    return (
        lines.filter(F.col("value").contains(word)).select("file_path", found, *keep)
        .select("*", F.explode_outer(F.slice("_all", 1, 1)).alias("m")).drop("_all").filter("m IS NOT NULL")
    )


def _number(pattern: str, group: int) -> Column:
    return F.regexp_extract("m", pattern, group).try_cast("bigint")


def _app(df: DataFrame) -> DataFrame:
    return df.select("*", paths.application_id().alias("application_id")).drop("file_path")


def resource_requests(lines: DataFrame) -> DataFrame:
    """Executors, cores and memory each application asked for."""
    asked = _matched(lines, "Will request", REQUEST).select(
        "file_path",
        _number(REQUEST, 1).alias("executors"),
        _number(REQUEST, 2).alias("cores"),
        _number(REQUEST, 3).alias("memory_mb"),
        F.coalesce(_number(REQUEST, 4), F.lit(0)).alias("overhead_mb"),
    )
    return _app(asked).groupBy("application_id").agg(
        F.count("*").alias("n_requests"),
        F.sum("executors").alias("executors"),
        F.sum(F.col("executors") * F.col("cores")).alias("total_cores"),
        F.sum(F.col("executors") * F.col("memory_mb")).alias("total_memory_mb"),
        F.sum(F.col("executors") * F.col("overhead_mb")).alias("total_overhead_mb"),
    )


def task_durations(lines: DataFrame) -> DataFrame:
    """Start, finish and seconds of every task; an unfinished one has nulls.

    Start and finish lines meet in one aggregate on (container, stage and TID
    text), so there is no self-join. The text is taken apart afterwards, once
    per task.
    """
    running = F.col("value").contains("Running task ")
    steps = (
        lines.filter(running | F.col("value").contains("Finished task "))
        .select(
            "file_path", logtext.event_time().alias("at"), running.alias("running"),
            _part(TASK, 1).alias("task"),
        )
        .filter("task != ''")
    )
    tasks = (
        steps.select(
            paths.application_id().alias("application_id"),
            paths.container_id().alias("container_id"),
            "task", "at", "running",
        )
        .groupBy("application_id", "container_id", "task")
        .agg(
            F.min(F.when(F.col("running"), F.col("at"))).alias("started_at"),
            F.max(F.when(~F.col("running"), F.col("at"))).alias("finished_at"),
        )
    )
    return tasks.select(
        "application_id", "container_id",
        F.substring_index("task", " ", 1).alias("stage"),
        F.substring_index("task", " ", -1).try_cast("bigint").alias("tid"),
        "started_at", "finished_at",
        F.timestamp_diff("SECOND", "started_at", "finished_at").alias("duration_sec"),
    )


def task_time_by_app(lines: DataFrame) -> DataFrame:
    """Finished tasks and their mean seconds per application."""
    return (
        task_durations(lines).filter("duration_sec IS NOT NULL").groupBy("application_id")
        .agg(
            F.count("*").alias("n_tasks"),
            F.sum("duration_sec").alias("total_sec"),
            F.try_divide(F.sum("duration_sec"), F.count("*")).alias("mean_sec"),
        )
    )


def unfinished_tasks(lines: DataFrame) -> DataFrame:
    """Tasks that started and never finished."""
    return task_durations(lines).filter("started_at IS NOT NULL AND finished_at IS NULL").select(
        "application_id", "container_id", "stage", "tid", "started_at"
    )


def task_skew(lines: DataFrame) -> DataFrame:
    """Longest against median task time per stage of an application."""
    tasks = task_durations(lines).filter("duration_sec IS NOT NULL")
    keys = ["application_id", "stage"]
    longest = tasks.groupBy(*keys).agg(F.max("duration_sec").alias("max_sec"))
    median = exact_percentile(tasks, keys, "duration_sec", "0.5", "median_sec", SECONDS)
    return longest.join(median, keys).select(
        *keys, F.col("n_values").alias("n_tasks"), "max_sec", "median_sec",
        F.try_divide("max_sec", "median_sec").alias("skew"),
    )


def python_times(lines: DataFrame) -> DataFrame:
    """Python worker times in milliseconds, one row per line that reports them."""
    return _app(_matched(lines, "Times: total = ", PYTHON).select(
        "file_path",
        _number(PYTHON, 1).alias("total_ms"),
        _number(PYTHON, 2).alias("boot_ms"),
        _number(PYTHON, 3).alias("init_ms"),
        _number(PYTHON, 4).alias("finish_ms"),
    ))


def input_bytes(lines: DataFrame) -> DataFrame:
    """Input splits and bytes read per application."""
    splits = _matched(lines, "Input split: ", SPLIT).select("file_path", _number(SPLIT, 3).alias("bytes"))
    return _app(splits).groupBy("application_id").agg(
        F.count("*").alias("n_splits"), F.sum("bytes").alias("input_bytes")
    )


def _bytes(amount: Column, unit: Column) -> Column:
    """Whole bytes of an amount with its unit; null where the unit is not known."""
    factors = F.create_map(*[F.lit(x) for kv in UNIT_BYTES.items() for x in kv])
    return F.round(
        amount.try_cast("decimal(18,4)") * F.try_element_at(factors, unit).cast("decimal(20,0)")
    ).try_cast("bigint")


def block_memory(lines: DataFrame) -> DataFrame:
    """Per application: blocks stored in memory, their bytes, the least memory that was free after one,
    the largest store capacity, and how many of these lines have an amount that can't be read.

    Amounts are decimals, so sums do not depend on the order of rows.
    """
    either = f"{BLOCK}|{CAPACITY}"  # one search of a line for both kinds
    part = lambda i: F.regexp_extract("m", either, i)
    is_block = F.col("m").startswith("Block ")
    words = F.col("value").contains(" in memory (") | F.col("value").contains("MemoryStore started")
    # groups 2 to 5 are those of a block, 6 and 7 those of a capacity
    memory = _matched(lines.filter(words), "emory", either).select(
        "file_path", F.when(is_block, 1).otherwise(0).alias("block"),
        F.when(is_block, _bytes(part(2), part(3))).alias("stored"), F.when(is_block, _bytes(part(4), part(5))).alias("free"),
        F.when(~is_block, _bytes(part(6), part(7))).alias("capacity"),
    )
    unread = F.when(F.col("block") == 1, F.col("stored").isNull() | F.col("free").isNull()).otherwise(F.col("capacity").isNull())
    return _app(memory).groupBy("application_id").agg(
        F.sum("block").alias("n_blocks"),
        F.sum("stored").alias("stored_bytes"),
        F.min("free").alias("min_free_bytes"),
        F.max("capacity").alias("max_capacity_bytes"),
        F.count_if(unread).alias("n_unread"),
    )


def cache_use(lines: DataFrame) -> DataFrame:
    """Cached blocks found, here and on other nodes, per application."""
    found = _matched(lines, "Found block ", FOUND).select(
        "file_path", F.regexp_extract("m", FOUND, 1).alias("block"), F.regexp_extract("m", FOUND, 2).alias("place")
    )
    return _app(found).groupBy("application_id").agg(
        F.count_if(F.col("place") == "locally").alias("n_local"),
        F.count_if(F.col("place") == "remotely").alias("n_remote"),
        F.count_distinct("block").alias("n_blocks"),
    )


def broadcast_reads(lines: DataFrame) -> DataFrame:
    """How often the executors of an application fetched a broadcast variable, and how many variables."""
    read = _matched(lines, "Started reading broadcast", READING).select("file_path", _number(READING, 1).alias("variable"))
    return _app(read).groupBy("application_id").agg(
        F.count("*").alias("n_reads"), F.count_distinct("variable").alias("n_variables")
    )


def container_requests(lines: DataFrame) -> DataFrame:
    """Containers asked for, per application, host and capability."""
    asked = _matched(lines, "Container request ", CONTAINER).select(
        "file_path", F.regexp_extract("m", CONTAINER, 1).alias("host"),
        _number(CONTAINER, 2).alias("memory_mb"), _number(CONTAINER, 3).alias("v_cores"),
    )
    return _app(asked).groupBy("application_id", "host", "memory_mb", "v_cores").agg(F.count("*").alias("n_containers"))


def failed_tasks(lines: DataFrame) -> DataFrame:
    """Failed attempts of every task that failed: first and last attempt and time, and how many."""
    failed = _matched(lines, " task ", FAILED, logtext.event_time().alias("at")).select(
        "file_path", "at", _number(FAILED, 1).alias("task"), _number(FAILED, 2).alias("attempt"),
        F.regexp_extract("m", FAILED, 3).alias("stage"), _number(FAILED, 4).alias("tid"),
    )
    return _app(failed).groupBy("application_id", "stage", "task").agg(
        F.count_distinct("attempt", "tid").alias("n_failures"),
        F.min("attempt").alias("first_attempt"), F.max("attempt").alias("last_attempt"),
        F.min("at").alias("first_failed_at"), F.max("at").alias("last_failed_at"),
    )


def failures_by_app(lines: DataFrame) -> DataFrame:
    """Error lines per application and component."""
    errors = lines.filter(F.col("value").contains("ERROR")).select(
        "file_path", logtext.log_level().alias("log_level"), logtext.component().alias("component")
    ).filter("log_level = 'ERROR'")
    return _app(errors).groupBy("application_id", "component").agg(F.count("*").alias("n_errors"))
