"""Cluster log lines made from the ``events`` table, by Spark.

Each event writes one entry of one to four lines into the log of one container.
``log_lines`` gives them as a lazy frame, as a scan would; ``log_tree`` writes
them as a tree of text files to scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.sources.files import create_empty
from waybill.sources.scratch import checkpointed, new_folder

TREE_APPS = 40  # applications in a written tree, which bounds its number of folders
SILENT = "_0039"  # ending of the application whose containers write nothing into their logs
_trees: dict[tuple[str, str, int | str], str] = {}


# The lines an event writes, by its type. e: event id, s: whole seconds of its
# value, t and t_end: its time, and its time s seconds later.
_TASK = "'task ' || e % 8 || '.0 in stage ' || e % 5 || '.0 (TID ' || e || ')'"
_ATTEMPT = "'task ' || e % 8 || '.' || e % 3 || ' in stage ' || e % 5 || '.0 (TID ' || e"
_LINES = {
    "view": f"""
        t || ' INFO executor.Executor: Running ' || {_TASK},
        if(e % 11 <> 0, t_end || ' INFO executor.Executor: Finished ' || {_TASK}
            || '. 1536 bytes result sent to driver', NULL)""",
    "click": """
        t || ' INFO rdd.HadoopRDD: Input split: hdfs://10.0.0.11:9000/in/part-' || e % 100
            || '.txt:' || e * 1000 || '+' || (s * 1024 + e),
        t || ' INFO python.PythonRunner: Times: total = ' || (s + e % 50) || ', boot = '
            || (e % 300 - 150) || ', init = ' || e % 40 || ', finish = ' || s,
        if(e % 2 = 0, t || ' INFO storage.BlockManager: Found block rdd_' || e % 20 || '_' || e % 4
            || if(e % 3 = 0, ' remotely', ' locally'), NULL)""",
    "purchase": """
        t || ' INFO storage.MemoryStore: Block broadcast_' || e
            || ' stored as bytes in memory (estimated size ' || s || '.' || e % 10
            || if(e % 13 = 0, ' XB', elt(e % 3 + 1, ' KB', ' KiB', ' B')) || ', free '
            || e % 500 || '.5 ' || if(e % 2 = 0, 'MB', 'MiB') || ')',
        if(e % 3 = 0, t || ' INFO storage.MemoryStore: MemoryStore started with capacity '
            || (e % 7 + 1) || '.5 ' || if(e % 2 = 0, 'GB', 'GiB'), NULL),
        if(e % 4 = 0, t || ' INFO broadcast.TorrentBroadcast: Started reading broadcast variable ' || e % 50, NULL)""",
    "signup": """
        t || ' INFO YarnAllocator: Will request ' || (e % 16 + 1) || ' executor containers, each with '
            || (e % 5 + 1) || ' cores and ' || (e % 8 + 1) * 1024 || ' MB memory including '
            || (e % 8 + 1) * 128 || ' MB overhead',
        if(e % 3 = 0, t || ' INFO YarnAllocator: Container request (host: Any, capability: <memory:'
            || (e % 8 + 1) * 1152 || ', vCores:' || (e % 5 + 1) || '>)', NULL),
        if(e % 4 = 0, t || ' WARN YarnAllocator no colon here', NULL),
        if(e % 6 = 1, '17/13/45 10:04:42 WARN a.B: bad date', NULL)""",
    "error": f"""
        if(e % 4 = 0, t || ' WARN scheduler.TaskSetManager: Lost ' || {_ATTEMPT}
            || ', node-' || e % 6 || ', executor ' || e % 9 || '): reset', NULL),
        t || ' ERROR executor.Executor: Exception in ' || {_ATTEMPT} || ')',
        '\tat org.foo.INFORMATION(App.scala:' || e % 90 || ')',
        if(e % 5 = 0, '', NULL),
        if(e % 7 = 0, t || ' TERRORIZE x', NULL)""",
}
_TEXTS = "CASE event_type " + " ".join(
    f"WHEN '{kind}' THEN array({lines})" for kind, lines in _LINES.items()
) + " END"
_IDS = """
    CASE WHEN a % 10 < 7 THEN '1703980800000' WHEN a % 10 < 9 THEN '1700006400000'
    ELSE '1690243200000' END || '_' || lpad(a, greatest(4, length(a)), '0')"""


def log_entries(spark: SparkSession, sf_dir: str, apps: int | None = None) -> DataFrame:
    """One row per event: ``app`` and ``container`` folder names, ``texts``, and the event's id and type.

    A user has one application for every three days of a month. ``texts`` holds
    a null for a line that an event leaves out.
    """
    app = "user_id * 10 + (day(ts) - 1) div 3"
    return (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .selectExpr(
            "event_id AS e", "event_type", "floor(value) AS s",
            "date_format(ts, 'yy/MM/dd HH:mm:ss') AS t",
            "date_format(timestampadd(SECOND, floor(value), ts), 'yy/MM/dd HH:mm:ss') AS t_end",
            app + " AS a" if apps is None else f"({app}) % {apps} AS a",
        )
        .selectExpr("*", f"{_IDS} AS ids")
        .selectExpr(
            "if(e % 97 = 0, 'gateway', 'application_' || ids) AS app",
            "if(e % 97 = 0, 'edge', 'container_' || ids || '_01_00000' || (e % 3 + 1)) AS container",
            f"{_TEXTS} AS texts", "e", "event_type",
        )
    )


def _log_file() -> Column:
    return F.concat(F.lit("file:///logs/"), "app", F.lit("/"), "container", F.lit(".log")).alias("file_path")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines (``value``, ``file_path``)."""
    # explode would add a filter on the array, and make every line twice
    return log_entries(spark, sf_dir).select(F.explode_outer("texts").alias("value"), _log_file()).filter("value IS NOT NULL")


def log_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs of all applications, empty ones included: a row per file (``file_path``).

    It stands for the inventory that a store keeps of its files, and is written as such. A tree with a file for
    each is no way to get it: there are as many as two for every five events. No line is made.
    """
    entries = log_entries(spark, sf_dir).filter(F.col("event_type").isin(*_LINES))  # others write nothing
    return checkpointed(entries.select(_log_file()).distinct())


def log_tree(spark: SparkSession, sf_dir: str, apps: int = TREE_APPS) -> str:
    """Write the lines as a tree of text files, once per Spark application; its root.

    An entry is written as one value with line breaks inside, so its lines stay
    together and in order. The rebalance gives each folder few files, and cuts
    a folder that holds much of the data into files of the advisory size.
    """
    key = (spark.sparkContext.applicationId, sf_dir, apps)
    if key not in _trees:
        root = new_folder(spark, "logs")
        (
            log_entries(spark, sf_dir, apps)
            .select(F.array_join("texts", "\n").alias("value"), "app", "container")
            .hint("rebalance", "app", "container")
            .write.partitionBy("app", "container").text(root)
        )
        _trees[key] = root
    return _trees[key]


def container_logs(spark: SparkSession, sf_dir: str) -> str:
    """Write one file per container, its entries in the order of their events, once per Spark application; the root.

    The logs of one application are there, and empty.
    """
    key = (spark.sparkContext.applicationId, sf_dir, "containers")
    if key not in _trees:
        root = new_folder(spark, "containers")
        entries = log_entries(spark, sf_dir, TREE_APPS)
        silent = F.col("app").endswith(SILENT)
        (
            entries.filter(~silent)
            .select(F.array_join("texts", "\n").alias("value"), "app", "container", "e")
            .repartition("app", "container").sortWithinPartitions("app", "container", "e").drop("e")
            .write.partitionBy("app", "container").text(root)
        )
        for r in entries.filter(silent).select("app", "container").distinct().collect():  # three containers at most
            create_empty(spark, f"{root}/app={r['app']}/container={r['container']}/part-00000.txt")
        _trees[key] = root
    return _trees[key]


_months: dict[tuple[str, str], str] = {}


def monthly_orders(spark: SparkSession, sf_dir: str) -> str:
    """Write ``orders`` in a ``yyyy=/mm=`` layout, once per Spark application; its root."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _months:
        root = new_folder(spark, "orders")
        (
            spark.read.parquet(f"{sf_dir}/orders.parquet")
            .withColumn("yyyy", F.year("o_orderdate"))
            .withColumn("mm", F.date_format("o_orderdate", "MM"))
            .hint("rebalance", "yyyy", "mm")
            .write.partitionBy("yyyy", "mm").parquet(root)
        )
        _months[key] = root
    return _months[key]
