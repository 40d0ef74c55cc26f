"""What the plans look like: reads, pushed filters, pruned columns, shuffles."""

import time

import pytest

from waybill.operators import levels, usage
from waybill.plans import analyses, catalog
from waybill.plans.demo_logs import log_lines, log_tree
from waybill.sources import text
from waybill.sources.tables import scan_csv


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def records_read(spark):
    time.sleep(0.5)  # stage metrics arrive on a listener thread
    context = spark.sparkContext
    quantiles = context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, quantiles, None)
    return sum(s.inputRecords() for s in context._jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages))


# queries that use their lines in more than one branch of the plan
BRANCHED = [
    "app_concurrency", "app_duration_stats", "block_memory", "app_durations", "cluster_share", "duration_cdf",
    "duration_density", "duration_histogram", "duration_outliers", "largest_cluster_apps",
    "log_level_distribution", "report_cluster_usage", "report_log_levels", "task_skew",
]


@pytest.mark.parametrize("name", BRANCHED)
def test_log_queries_read_the_lines_once(spark, sf_dir, monkeypatch, name):
    root = log_tree(spark, sf_dir)
    monkeypatch.setattr(catalog, "log_lines", lambda s, d: text.scan_log_tree(s, root))
    n = text.scan_log_tree(spark, root).count()
    before = records_read(spark)
    catalog.QUERIES[name](spark, sf_dir).collect()
    # besides the lines, duration queries read what they have written: a row per application, three times at most
    assert records_read(spark) - before <= n + 3 * n // 10


def test_exact_percentile_reads_its_input_once(spark, sf_dir):
    before = records_read(spark)
    catalog.QUERIES["daily_p95_exact"](spark, sf_dir).collect()
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert records_read(spark) - before <= 2 * rows  # once, and once for the count above


def test_year_filter_reaches_the_scan(spark, sf_dir):
    p = plan(catalog.QUERIES["filter_year"](spark, sf_dir))
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)" in p
    assert "LessThan(o_orderdate,1997-01-01T00:00)" in p


def test_daily_summary_reads_six_columns(spark, sf_dir):
    p = plan(catalog.QUERIES["daily_summary"](spark, sf_dir))
    schema = next(x for x in p.splitlines() if x.startswith("ReadSchema"))
    assert schema.count(":") == 1 + 6


def test_month_range_prunes_files(spark, sf_dir):
    df = catalog.QUERIES["scan_month_range"](spark, sf_dir)
    assert all("yyyy=1996" in f for f in df.inputFiles())
    assert {f.split("mm=")[1][:2] for f in df.inputFiles()} == {f"{m:02d}" for m in range(1, 7)}


def test_top_k_and_samples_do_not_sort_everything(spark, sf_dir):
    for name in ("top_clusters", "sample_log_entries", "sample_by_text", "sample_random", "top_components", "daily_latest"):
        p = plan(catalog.QUERIES[name](spark, sf_dir))
        assert "TakeOrderedAndProject" in p and "rangepartitioning" not in p


def test_summary_drops_the_timeline_sort(spark, sf_dir):
    t = usage.sorted_timeline(usage.app_timeline(log_lines(spark, sf_dir)))
    assert "rangepartitioning" not in plan(usage.cluster_summary(t))


def test_no_cross_joins_and_python_only_for_entries(spark, sf_dir):
    for name, query in catalog.QUERIES.items():
        p = plan(query(spark, sf_dir))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
        assert "MapInArrow" not in p, name  # the entries' one Arrow step has run by then
        assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p, name


def test_level_regex_runs_once_per_line(spark, sf_dir):
    p = plan(levels.log_level_counts(levels.level_frame(log_lines(spark, sf_dir))))
    assert p.count("regexp_extract(value") <= 2  # the operator's output and its grouping key


def test_entries_do_not_shuffle_lines(spark, sf_dir):
    p = plan(catalog.QUERIES["multiline_entries_blocks"](spark, sf_dir))
    shuffled = [x for x in p.splitlines() if x.startswith("Arguments: hashpartitioning")]
    scans = [x for x in p.splitlines() if x.startswith("PushedFilters") and "), EqualTo(entry_timestamp,?)" in x]
    # all lines that take part in a shuffle are open ones, or rows of blocks
    assert len(scans) == 1 and p.count("SortAggregate") == 0 and len(shuffled) <= 3


def test_entries_of_ranges_are_one_pass(spark, sf_dir):
    p = plan(catalog.QUERIES["multiline_entries"](spark, sf_dir))
    assert "BatchScan log_entries" in p and "Exchange" not in p and "Scan parquet" not in p


@pytest.mark.parametrize("name", [
    "duration_histogram", "duration_histogram_log", "duration_density", "app_duration_stats", "duration_cdf",
    "duration_outliers", "duration_histogram_by_cluster", "duration_density_by_cluster", "duration_cdf_by_cluster",
])
def test_duration_plans_are_flat(spark, sf_dir, name):
    p = plan(catalog.QUERIES[name](spark, sf_dir))
    scans = [x for x in p.splitlines() if x.startswith("(") and ") Scan " in x]
    assert len(scans) <= 3, scans


@pytest.mark.parametrize("name", ["daily_summary", "daily_latest", "daily_p95_approx", "report_daily"])
def test_daily_summaries_take_one_aggregate(spark, sf_dir, name):
    p = plan(catalog.QUERIES[name](spark, sf_dir))
    assert "approx_percentile" not in p and "kll_sketch_agg_double" in p and "Window" not in p


def test_analyses_write_everything(spark, sf_dir, tmp_path):
    lines = log_lines(spark, sf_dir)
    analyses.log_level_analysis(lines, f"{tmp_path}/levels")
    analyses.cluster_usage_analysis(lines, f"{tmp_path}/usage")
    trips = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    analyses.daily_trip_analysis(trips, f"{tmp_path}/trips", 1996, catalog.TRIPS)
    text_of = lambda p: "".join(f.read_text() for f in sorted((tmp_path / p).glob("part-*")))
    assert text_of("levels/summary").startswith("Total log lines processed: ")
    assert text_of("levels/counts").splitlines()[0] == "log_level,count"
    assert len(text_of("levels/sample").splitlines()) == 11
    assert text_of("usage/stats").startswith("Total unique clusters: 4\n")
    timeline = scan_csv(spark, f"{tmp_path}/usage/timeline", catalog.TIMELINE)
    assert timeline.count() == usage.app_timeline(lines).count()
    assert len(text_of("usage/durations").splitlines()) == 31
    assert text_of("trips/summary").startswith("Year: 1996, Month: 12, Day: 31\n")
