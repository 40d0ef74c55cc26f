"""The registered queries: each is (spark, table folder) -> lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.functions import logtext, paths
from waybill.operators import (
    daily, distribution, entries, execution, levels, records, reports, rollup, tasks, templates, usage,
)
from waybill.plans import sql_functions
from waybill.plans.demo_logs import container_logs, log_inventory, log_lines, log_tree, monthly_orders
from waybill.sources import files, ranges, scratch, sinks, tables, text

Query = Callable[[SparkSession, str], DataFrame]

TIMELINE = (
    "cluster_id string, application_id string, app_number string, "
    "start_time timestamp_ntz, end_time timestamp_ntz"
)
# lineitem in the part of a trip table
TRIPS = daily.TripColumns(
    pickup="l_shipdate", distance="l_quantity", tax="l_tax",
    fare="l_extendedprice", tip="l_discount", passengers="l_linenumber",
)
# orders in the same part
ORDER_TRIPS = daily.TripColumns(
    pickup="o_orderdate", distance="o_totalprice", tax="o_totalprice",
    fare="o_totalprice", tip="o_totalprice", passengers="o_custkey",
)
YEAR = 1996
OUTLIERS = 1.05  # times the median
TASK_BYTES = 64 << 20  # text that a task reads in small blocks, about


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on_lines(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(log_lines(spark, sf_dir))


def _on_files(operator: Callable[[DataFrame], DataFrame]) -> Query:
    """Operators on the files of a tree with empty logs; a row per file, nothing is read of them."""
    return lambda spark, sf_dir: operator(files.scan_file_metadata(spark, container_logs(spark, sf_dir)))


def _on_levels(operator: Callable[[DataFrame], DataFrame], mode: str = "loose") -> Query:
    return _on_lines(lambda lines: operator(levels.level_frame(lines, mode)))


def _on_timeline(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_lines(lambda lines: operator(usage.app_timeline(lines)))


def _on_durations(operator: Callable[[DataFrame], DataFrame], largest: bool = True) -> Query:
    """Operators on the durations of the largest cluster, or of all.

    The durations, a row per application, are written once: the operators use them
    several times, and the lines are read for that no more than once.
    """
    spans = distribution.largest_cluster_durations if largest else distribution.app_durations
    return _on_timeline(lambda t: operator(scratch.written(spans(t), "durations")))


@contextmanager
def _small_blocks(spark: SparkSession, root: str, size: str) -> Iterator[None]:
    """Scans of this tree that run inside cut files into blocks of this size.

    By itself Spark gives every block a task, which costs more than the block. So the number of tasks follows the
    bytes of the tree: a task reads many blocks, one after the other.
    """
    n_bytes = files.scan_file_metadata(spark, root).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-n_bytes // TASK_BYTES))
    settings = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.maxPartitionNum": str(tasks)}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    """Round means of doubles, whose last digits depend on the order of addition."""
    return df.withColumns({c: F.round(c, places) for c in columns})


# scans

def scan_log_tree(spark, sf_dir):
    lines = text.scan_log_tree(spark, log_tree(spark, sf_dir))
    return lines.select("value")


def scan_log_glob(spark, sf_dir):
    root = log_tree(spark, sf_dir)
    lines = text.scan_log_glob(spark, f"{root}/app=application_*/container=*/*.txt")
    return lines.select("value")


def file_path_column(spark, sf_dir):
    lines = text.scan_log_tree(spark, log_tree(spark, sf_dir))
    containers = lines.groupBy("file_path").agg(F.count("*").alias("n"))
    return (
        paths.with_application_ids(containers)
        .select("application_id", paths.container_id().alias("container_id"), "n")
        .groupBy("application_id", "container_id").agg(F.sum("n").alias("n_lines"))
    )


def scan_parquet_many(spark, sf_dir):
    root = monthly_orders(spark, sf_dir)
    months = tables.month_paths(root, 1995, [1, 12]) + tables.month_paths(root, 1997, [6])
    return tables.scan_parquet_many(spark, months, root).select("o_orderkey", "o_totalprice", "yyyy")


def scan_parquet_glob(spark, sf_dir):
    root = monthly_orders(spark, sf_dir)
    orders = tables.scan_parquet_glob(spark, f"{root}/yyyy=1996/*/*.parquet", root)
    return orders.select("o_orderkey", "o_totalprice", "yyyy")


def scan_month_range(spark, sf_dir):
    orders = tables.scan_month_range(spark, monthly_orders(spark, sf_dir), 1996, range(1, 7))
    return orders.select("o_orderkey", "o_orderdate", "yyyy")


def range_source(spark, sf_dir):
    """Orders of every day from the first to the last, days without any included."""
    days = _table(spark, sf_dir, "orders").groupBy(F.unix_date(F.to_date("o_orderdate")).alias("id")).agg(
        F.count("*").alias("n")
    )
    calendar = tables.numbers_between(days.agg(F.min("id").alias("low"), F.max("id").alias("high")))
    return calendar.join(days, "id", "left").select(
        F.date_from_unix_date("id").alias("order_day"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n_orders")
    )


def range_even_double(spark, sf_dir):
    return tables.even_doubled(_table(spark, sf_dir, "orders"), "o_orderkey")


def sql_count(spark, sf_dir):
    return tables.count_by_sql(_table(spark, sf_dir, "orders"))


def source_health(spark, sf_dir):
    names = ["orders", "lineitem", "documents", "no_such_table"]
    return tables.source_health(spark, {n: f"{sf_dir}/{n}.parquet" for n in names})


def row_counts(spark, sf_dir):
    names = ["orders", "lineitem", "events", "documents"]
    return tables.row_counts({n: _table(spark, sf_dir, n) for n in names})


def schema_rows(spark, sf_dir):
    return tables.schema_rows(_table(spark, sf_dir, "lineitem"))


def inventory_with_lines(spark, sf_dir):
    root = container_logs(spark, sf_dir)
    return usage.inventory_with_lines(files.scan_file_metadata(spark, root), text.scan_log_tree(spark, root))


def containers_per_app(spark, sf_dir):
    """Containers of all applications, from an inventory of their logs."""
    return usage.containers_per_app(log_inventory(spark, sf_dir))


# written results

def csv_round_trip(spark, sf_dir):
    """Log lines, and the lines again with quotes, commas, a tab and a final backslash, through CSV."""
    folder = scratch.new_folder(spark, "lines")
    noted = F.concat(F.lit(' "'), "value", F.lit('",\tsaid it, '), "file_path", F.lit("\\"))
    sinks.write_csv(log_lines(spark, sf_dir).select("value", noted.alias("noted")), folder)
    return tables.scan_csv(spark, folder, "value string, noted string")


def reload_saved_results(spark, sf_dir):
    """Redraw from saved tables: the bars come from the CSV, not from the logs."""
    folder = scratch.new_folder(spark, "timeline")
    sinks.write_csv(usage.app_timeline(log_lines(spark, sf_dir)), folder)
    return usage.apps_per_cluster_bars(tables.scan_csv(spark, folder, TIMELINE))


def write_totals(spark, sf_dir):
    """Totals of lines, observed while the level counts are written, beside the counts that were written."""
    folder = scratch.new_folder(spark, "counts")
    frame = levels.level_frame(log_lines(spark, sf_dir))
    totals = sinks.write_csv_counted(
        frame, folder, total_lines=F.sum("n_lines"), lines_with_level=F.sum("count"), n_rows=F.count("*")
    )
    written = tables.scan_csv(spark, folder, "log_level string, n_lines bigint, count bigint").filter("count > 0")
    return written.select("log_level", "count", *[F.lit(v).cast("bigint").alias(k) for k, v in totals.items()])


# placed lines: a byte range source

def _placed_lines(spark, sf_dir):
    return ranges.scan_placed_lines(spark, container_logs(spark, sf_dir))


def _in_tree():
    """The folders of a file below the root of its tree, which has another name in every run."""
    return F.regexp_extract("file_path", "app=[^/]+/container=[^/]+", 0)


def scan_placed_lines(spark, sf_dir):
    return _placed_lines(spark, sf_dir).select("value", _in_tree().alias("file"), "line_start")


def sample_log_entries(spark, sf_dir):
    return levels.sample_log_entries(_placed_lines(spark, sf_dir), file=_in_tree())


def levels_with_sample(spark, sf_dir):
    """Counts and sample from one pass; a sampled line beside the totals of its level."""
    frame, sample = levels.levels_and_sample(_placed_lines(spark, sf_dir), file=_in_tree())
    return sample.join(F.broadcast(frame), "log_level")  # five rows


# trips

def filter_year(spark, sf_dir):
    orders = daily.filter_year(_table(spark, sf_dir, "orders"), "o_orderdate", YEAR)
    return orders.select("o_orderkey", "o_orderdate", "o_totalprice")


def date_parts(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return daily.date_parts(orders, "o_orderdate").drop("o_orderdate")


def daily_summary(spark, sf_dir, year=YEAR):
    days = daily.daily_summary(_table(spark, sf_dir, "lineitem"), year, TRIPS)
    return daily.newest_first(_rounded(days, 6, "mean_trip_distance"))


def daily_latest(spark, sf_dir):
    trips = daily.newest_days(_table(spark, sf_dir, "lineitem"), 20, TRIPS)
    return _rounded(daily.daily_latest(daily.daily_summary(trips, None, TRIPS)), 6, "mean_trip_distance")


def daily_latest_by_month(spark, sf_dir):
    """The newest days of a table partitioned by month; the scan opens the months of these days."""
    orders = tables.scan_parquet_glob(spark, monthly_orders(spark, sf_dir))
    month_end = F.last_day(F.make_date("yyyy", F.col("mm").cast("int"), F.lit(1)))
    trips = daily.newest_days(orders, 20, ORDER_TRIPS, month_end)
    return _rounded(daily.daily_latest(daily.daily_summary(trips, None, ORDER_TRIPS)), 7, "mean_trip_distance")


def daily_p95_approx(spark, sf_dir):
    return daily.daily_p95_approx(_table(spark, sf_dir, "lineitem"), "l_shipdate", "l_extendedprice")


def daily_p95_exact(spark, sf_dir):
    return daily.daily_p95_exact(_table(spark, sf_dir, "lineitem"), "l_shipdate", "l_extendedprice")


def daily_rollup_totals(spark, sf_dir):
    return daily.daily_rollup_totals(_table(spark, sf_dir, "lineitem"), "l_shipdate", YEAR)


def report_daily(spark, sf_dir):
    trips = daily.newest_days(_table(spark, sf_dir, "lineitem"), 5, TRIPS)
    return reports.report_daily(daily.daily_summary(trips, None, TRIPS))


# roll-ups: the first update of a store sees a part of the files, the second finds the others

def _rolled_orders(spark, sf_dir):
    root, store = monthly_orders(spark, sf_dir), scratch.new_folder(spark, "rollup")
    for part in (f"{root}/yyyy=199*", root):
        rollup.add_new_files(
            spark, store, part, lambda p: tables.scan_parquet_many(spark, p, root), lambda df: daily.daily_partials(df, None, ORDER_TRIPS)
        )
    return rollup.merged(spark, store, daily.merge_partials)


def _rolled_logs(spark, sf_dir):
    root, store = container_logs(spark, sf_dir), scratch.new_folder(spark, "rollup")
    for part in (f"{root}/app=application_*_000*", root):
        rollup.add_new_files(spark, store, part, lambda p: text.scan_log_glob(spark, *p), rollup.cluster_partials)
    return rollup.merged(spark, store, rollup.merge_clusters)


def rollup_daily_summary(spark, sf_dir):
    days = daily.summary_of_partials(_rolled_orders(spark, sf_dir))
    return _rounded(days, 7, "mean_trip_distance")


def rollup_daily_totals(spark, sf_dir):
    return rollup.daily_totals(_rolled_orders(spark, sf_dir))


def rollup_cluster_summary(spark, sf_dir):
    return rollup.cluster_summary(_rolled_logs(spark, sf_dir))


def rollup_usage_totals(spark, sf_dir):
    return rollup.usage_totals(_rolled_logs(spark, sf_dir))


# SQL texts over table functions

def _by_sql(text, **args):
    def query(spark, sf_dir):
        sql_functions.register(log_lines(spark, sf_dir))
        return spark.sql(text, args=args)

    return query


# entries

def multiline_entries(spark, sf_dir):
    """Every line of a tree with the head of its entry, in one pass."""
    lines = ranges.scan_entries(spark, log_tree(spark, sf_dir, 2), range_bytes=1 << 20)
    return lines.select(
        paths.container_id().alias("container_id"), "value", "is_continuation", "entry_timestamp", "entry_level"
    )


def multiline_entries_blocks(spark, sf_dir):
    """The same from Spark's own text scan, for stores that only Spark reads.

    The tree has few files, and they are cut into small blocks, so many blocks open inside an entry.
    """
    root = log_tree(spark, sf_dir, 2)
    with _small_blocks(spark, root, "16k"):
        lines = entries.attach_entries(text.scan_log_blocks(spark, root))
    return (
        lines.select(
            paths.container_id().alias("container_id"),
            "value", "is_continuation", "entry_timestamp", "entry_level",
        )
    )


QUERIES: dict[str, Query] = {
    "scan_log_tree": scan_log_tree,
    "scan_log_glob": scan_log_glob,
    "file_path_column": file_path_column,
    "scan_parquet_many": scan_parquet_many,
    "scan_parquet_glob": scan_parquet_glob,
    "scan_month_range": scan_month_range,
    "range_source": range_source,
    "range_even_double": range_even_double,
    "sql_count": sql_count,
    "source_health": source_health,
    "row_counts": row_counts,
    "schema_rows": schema_rows,
    "csv_round_trip": csv_round_trip,
    "reload_saved_results": reload_saved_results,
    # records
    "parse_log_level": _on_lines(lambda x: x.select("value", logtext.log_level().alias("log_level"))),
    "parse_log_record": _on_lines(records.parse_log_record),
    "enrich_log_record": _on_lines(records.enrich_log_record),
    "parse_log_timestamp": _on_lines(records.parse_log_timestamp),
    "timestamp_rejects": _on_lines(records.timestamp_rejects),
    "parse_path_ids": _on_lines(records.parse_path_ids),
    "parse_container_id": _on_lines(records.parse_container_id),
    "container_role": _on_lines(records.container_role),
    "cluster_start_time": _on_lines(records.cluster_start_time),
    "filter_has_level": _on_lines(levels.lines_with_level),
    "filter_has_timestamp": _on_lines(lambda x: x.filter(logtext.timestamp_text() != "")),
    "filter_error_lines": _on_lines(levels.filter_error_lines),
    "multiline_entries": multiline_entries,
    "multiline_entries_blocks": multiline_entries_blocks,
    # levels
    "log_level_counts": _on_levels(levels.log_level_counts),
    "log_level_counts_strict": _on_levels(levels.log_level_counts, "strict"),
    "log_totals": _on_levels(levels.log_totals),
    "log_level_distribution": _on_levels(levels.log_level_distribution),
    "level_counts_complete": _on_levels(levels.level_counts_complete),
    "level_token_counts": _on_lines(levels.level_token_counts),
    "scan_placed_lines": scan_placed_lines,
    "sample_log_entries": sample_log_entries,
    "sample_by_text": _on_lines(levels.sample_by_text),
    "levels_with_sample": levels_with_sample,
    "write_totals": write_totals,
    "sample_random": _on_lines(levels.sample_check),
    "component_counts": _on_lines(levels.component_counts),
    "top_components": _on_lines(levels.top_components),
    "report_log_levels": _on_levels(reports.report_log_levels),
    # usage
    "app_timeline": _on_timeline(usage.sorted_timeline),
    "cluster_summary": _on_timeline(lambda t: usage.cluster_summary(t).orderBy("cluster_id")),
    "usage_totals": _on_timeline(usage.usage_totals),
    "top_clusters": _on_timeline(usage.top_clusters),
    "largest_cluster": _on_timeline(lambda t: usage.top_clusters(t, 1)),
    "largest_cluster_apps": _on_timeline(usage.largest_cluster_apps),
    "cluster_share": _on_timeline(usage.cluster_share),
    "apps_per_cluster_bars": _on_timeline(usage.apps_per_cluster_bars),
    "app_concurrency": _on_timeline(usage.app_concurrency),
    "top_apps_by_files": _on_files(usage.top_apps_by_files),
    "files_per_app": _on_files(usage.files_per_app),
    "dataset_inventory": _on_files(usage.dataset_inventory),
    "inventory_with_lines": inventory_with_lines,
    "containers_per_app": containers_per_app,
    "report_cluster_usage": _on_timeline(reports.report_cluster_usage),
    # durations
    "app_durations": _on_durations(lambda d: d),
    "duration_histogram": _on_durations(distribution.duration_histogram),
    "duration_histogram_log": _on_durations(
        lambda d: _rounded(distribution.duration_histogram_log(d), 9, "log_bin_start", "log_bin_end")
    ),
    "duration_density": _on_durations(
        lambda d: _rounded(distribution.duration_density(d), 12, "density")
    ),
    "duration_density_binned": _on_durations(
        lambda d: _rounded(distribution.duration_density_binned(d), 12, "density")
    ),
    "app_duration_stats": _on_durations(
        lambda d: _rounded(distribution.app_duration_stats(d), 6, "mean_sec", "stddev_sec")
    ),
    "duration_cdf": _on_durations(distribution.duration_cdf),
    # the longest demo application takes three days, the median two at least
    "duration_outliers": _on_durations(lambda d: distribution.duration_outliers(d, OUTLIERS), largest=False),
    "duration_histogram_by_cluster": _on_durations(
        lambda d: distribution.duration_histogram(d, by=["cluster_id"]), largest=False
    ),
    "duration_density_by_cluster": _on_durations(
        lambda d: _rounded(distribution.duration_density(d, by=["cluster_id"]), 12, "density"), largest=False
    ),
    "duration_cdf_by_cluster": _on_durations(
        lambda d: distribution.duration_cdf(d, by=["cluster_id"]), largest=False
    ),
    # tasks
    "resource_requests": _on_lines(tasks.resource_requests),
    "task_durations": _on_lines(tasks.task_durations),
    "task_time_by_app": _on_lines(tasks.task_time_by_app),
    "unfinished_tasks": _on_lines(tasks.unfinished_tasks),
    "task_skew": _on_lines(tasks.task_skew),
    "python_times": _on_lines(tasks.python_times),
    "input_bytes": _on_lines(tasks.input_bytes),
    "block_memory": _on_lines(tasks.block_memory),
    "cache_use": _on_lines(tasks.cache_use),
    "container_requests": _on_lines(tasks.container_requests),
    "failed_tasks": _on_lines(tasks.failed_tasks),
    "failures_by_app": _on_lines(tasks.failures_by_app),
    "failure_templates": _on_lines(templates.failure_templates),
    "line_templates": _on_lines(templates.line_templates),
    "broadcast_reads": _on_lines(tasks.broadcast_reads),
    "container_busy": _on_lines(execution.container_busy),
    "stage_timeline": _on_lines(execution.stage_timeline),
    # trips
    "filter_year": filter_year,
    "date_parts": date_parts,
    "daily_summary": daily_summary,
    "daily_latest": daily_latest,
    "daily_latest_by_month": daily_latest_by_month,
    "daily_p95_approx": daily_p95_approx,
    "daily_p95_exact": daily_p95_exact,
    "daily_rollup_totals": daily_rollup_totals,
    "report_daily": report_daily,
    # roll-ups
    "rollup_daily_summary": rollup_daily_summary,
    # table functions
    "sql_level_counts": _by_sql("SELECT * FROM log_level_counts(:mode)", mode="strict"),
    "sql_app_timeline": _by_sql("SELECT * FROM app_timeline(cluster => :cluster)", cluster="1700006400000"),
    "sql_cluster_usage": _by_sql(
        "SELECT c.cluster_id, c.num_applications, max(t.end_time) AS last_end FROM cluster_usage(:least) c "
        "JOIN app_timeline() t ON t.cluster_id = c.cluster_id GROUP BY ALL", least=2,
    ),
    "rollup_daily_totals": rollup_daily_totals,
    "rollup_cluster_summary": rollup_cluster_summary,
    "rollup_usage_totals": rollup_usage_totals,
}
