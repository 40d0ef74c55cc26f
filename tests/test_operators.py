"""Operators against plain Python, at sizes where splitting and carrying happen."""

import csv
import datetime
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from waybill.functions import logtext
from waybill.operators import daily, distribution, entries, levels, reports, tasks, usage
from waybill.operators.quantiles import ANY_NUMBER, SECONDS, exact_percentile, log_cell, span_cell
from waybill.operators.running import running_total
from waybill.sources import scratch, sinks, tables, text

TIMELINE = (
    "cluster_id string, application_id string, app_number string, "
    "start_time timestamp_ntz, end_time timestamp_ntz"
)
START = datetime.datetime(2017, 1, 1)


def timeline_of(spark, rows):
    """rows: (cluster, number, start second, end second)"""
    at = lambda s: START + datetime.timedelta(seconds=s)
    return spark.createDataFrame(
        [(c, f"application_{c}_{n:04d}", f"{n:04d}", at(a), at(b)) for c, n, a, b in rows], TIMELINE
    )


def durations_of(spark, values, cluster="c"):
    rows = [(cluster, str(i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "cluster_id string, application_id string, duration_sec bigint")


def percentile(values, num, den):
    s = sorted(values)
    return s[max(0, -(-len(s) * num // den) - 1)]


@pytest.mark.parametrize("cells", [ANY_NUMBER, (log_cell(0.5),), (log_cell(1), log_cell(3), log_cell(1e4))])
def test_exact_percentile(spark, cells):
    rng = random.Random(7)
    data = [("hot", round(rng.lognormvariate(3, 2), 2)) for _ in range(4000)]
    data += [("ties", float(rng.randrange(4))) for _ in range(500)]
    data += [("one", 5.0), ("null", None), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(data, "k string, v double").repartition(7)
    for p, num, den in (("0.95", 95, 100), ("0.5", 1, 2), ("1.0", 1, 1), ("0.001", 1, 1000)):
        got = {
            r["k"]: (r["q"], r["n_values"])
            for r in exact_percentile(df, ["k"], "v", p, "q", cells).collect()
        }
        groups = {}
        for k, v in data:
            if v is not None:
                groups.setdefault(k, []).append(v)
        assert got == {k: (percentile(v, num, den), len(v)) for k, v in groups.items()}


def test_exact_percentile_of_two_keys(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("a"), (F.col("id") % 2).alias("b"), "id")
    got = exact_percentile(df, ["a", "b"], "id", "0.5", "m", (span_cell(7),)).collect()
    for r in got:
        values = [i for i in range(1000) if i % 3 == r["a"] and i % 2 == r["b"]]
        assert r["m"] == percentile(values, 1, 2)
    assert len(got) == 6


def test_exact_percentile_of_a_large_group(spark):
    n = 2_000_000
    df = spark.range(n).select(F.lit("g").alias("k"), ((F.col("id") * 7919) % n - 500_000).alias("v"))
    for cells in (ANY_NUMBER, SECONDS):
        row = exact_percentile(df, ["k"], "v", "0.95", "q", cells).first()
        assert (row["q"], row["n_values"]) == (n * 95 // 100 - 1 - 500_000, n)


def test_running_total(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("k"), (F.col("id") * 3 - 400).alias("o"), "id")
    w = Window.partitionBy("k").orderBy("o")
    want = {(r["k"], r["o"]): r["t"] for r in df.select("k", "o", F.sum("id").over(w).alias("t")).collect()}
    got = running_total(df, ["k"], "o", "id", 37, "t").collect()
    assert {(r["k"], r["o"]): r["t"] for r in got} == want and len(got) == 500


def test_concurrency(spark):
    t = timeline_of(spark, [
        ("1", 1, 0, 100), ("1", 2, 100, 90000), ("1", 3, 50, 200000), ("1", 4, 50, 60), ("2", 1, 5, 5),
    ])
    got = {
        (r["cluster_id"], (r["at_time"] - START).total_seconds()): (r["running_before_starts"], r["running"])
        for r in usage.app_concurrency(t).collect()
    }
    assert got == {
        ("1", 0): (0, 1), ("1", 50): (1, 3), ("1", 60): (2, 2), ("1", 100): (1, 2),
        ("1", 90000): (1, 1), ("1", 200000): (0, 0), ("2", 5): (-1, 0),
    }


def test_histogram_against_numpy(spark):
    import numpy as np

    rng = random.Random(3)
    values = [int(rng.lognormvariate(6, 1.5)) for _ in range(700)]
    got = distribution.duration_histogram(durations_of(spark, values)).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=30)
    assert [r["count"] for r in got] == counts.tolist()
    np.testing.assert_allclose([r["bin_start"] for r in got] + [got[-1]["bin_end"]], edges)
    density, _ = np.histogram(values, bins=30, density=True)
    np.testing.assert_allclose([r["density"] for r in got], density)


def test_histogram_edge_cases(spark):
    same = distribution.duration_histogram(durations_of(spark, [7, 7, 7])).collect()
    assert [(r["bin"], r["count"], r["bin_start"], r["bin_end"]) for r in same] == [(1, 3, 7.0, 7.0)]
    assert distribution.duration_histogram(durations_of(spark, [])).count() == 0
    assert distribution.duration_density(durations_of(spark, [7, 7])).count() == 0
    logs = distribution.duration_histogram_log(durations_of(spark, [0, 1000])).orderBy("bin").collect()
    assert logs[0]["log_bin_start"] is None and abs(logs[-1]["log_bin_end"] - 3) < 1e-9


def test_density_against_numpy(spark):
    import numpy as np

    values = [11, 300, 300, 900, 1123, 5000, 55957]
    got = distribution.duration_density(durations_of(spark, values), points=50).orderBy("point").collect()
    v = np.array(values, float)
    h = v.std(ddof=1) * len(v) ** -0.2
    x = np.linspace(v.min(), v.max(), 50)
    want = np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))
    np.testing.assert_allclose([r["x"] for r in got], x)
    np.testing.assert_allclose([r["density"] for r in got], want, rtol=1e-10)


@pytest.mark.parametrize("seed, spread", [(1, 400), (2, 30_000), (3, 2_000_000)])
def test_binned_density_is_near_the_direct_sum(spark, seed, spread):
    import numpy as np

    rng = np.random.default_rng(seed)
    values = np.r_[rng.integers(1, spread, 3000), rng.normal(spread / 3, spread / 20, 3000).astype(int)].tolist()
    df = durations_of(spark, values)
    exact = {r["point"]: r for r in distribution.duration_density(df).collect()}
    got = distribution.duration_density_binned(df).collect()
    top = max(r["density"] for r in exact.values())
    assert len(got) == 200
    for r in got:
        assert abs(r["x"] - exact[r["point"]]["x"]) <= 1e-9 * spread and abs(r["density"] - exact[r["point"]]["density"]) < 1e-3 * top


def test_binned_density_cases(spark):
    assert distribution.duration_density_binned(durations_of(spark, [7, 7])).count() == 0
    assert distribution.duration_density_binned(durations_of(spark, [])).count() == 0
    both = durations_of(spark, [1, 5, 9]).unionByName(durations_of(spark, [2, 80]).select(F.lit("other").alias("cluster_id"), "application_id", "duration_sec"))
    assert both.transform(lambda d: distribution.duration_density_binned(d, 10, ["cluster_id"])).groupBy("cluster_id").count().count() == 2


def test_percentile_of_rank_zero_is_the_smallest(spark):
    from waybill.operators.quantiles import exact_percentile

    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("b", -2.0), ("c", None)], "k string, v double")
    got = {r["k"]: r["m"] for r in exact_percentile(df, ["k"], "v", "0", "m").collect()}
    assert got == {"a": 1.0, "b": -2.0}


def test_csv_keeps_marks_blanks_and_refuses_lost_rows(spark, tmp_path):
    from waybill.sources import sinks, tables

    odd = [("\0",), ("",), (" ",), ("x",), ('"',), ("a,b",)]
    sinks.write_csv(spark.createDataFrame(odd, "x string"), f"{tmp_path}/one")
    assert sorted(map(tuple, tables.scan_csv(spark, f"{tmp_path}/one", "x string").collect())) == sorted(odd)
    two = [("\0", None), (None, None), ("", ""), (None, "\0")]
    sinks.write_csv(spark.createDataFrame(two, "x string, y string"), f"{tmp_path}/two")
    key = lambda r: tuple((v is None, v or "") for v in r)
    assert sorted(map(tuple, tables.scan_csv(spark, f"{tmp_path}/two", "x string, y string").collect()), key=key) == sorted(two, key=key)
    with pytest.raises(Exception, match="would be lost"):
        sinks.write_csv(spark.createDataFrame([("x",), (None,)], "x string"), f"{tmp_path}/null")


def test_table_functions(spark, sf_dir):
    from waybill.plans import sql_functions
    from waybill.plans.demo_logs import log_lines

    lines = log_lines(spark, sf_dir)
    assert set(sql_functions.register(lines)) == {"log_level_counts", "app_timeline", "cluster_usage"}
    assert spark.sql("SELECT * FROM app_timeline()").count() == usage.app_timeline(lines).count()
    plan = spark.sql("SELECT * FROM log_level_counts(:m)", args={"m": "strict"})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("events.parquet") + plan.count("Relation") == 1  # the other way of matching is pruned
    sql_functions.register(lines.filter("false"))
    assert spark.sql("SELECT * FROM cluster_usage()").count() == 0


def test_cdf_outliers_stats(spark):
    values = [1, 2, 2, 3, 10, 200000]
    spans = durations_of(spark, values)
    cdf = {r["duration_sec"]: r["share"] for r in distribution.duration_cdf(spans).collect()}
    assert cdf == {1: 1 / 6, 2: 3 / 6, 3: 4 / 6, 10: 5 / 6, 200000: 1.0}
    out = distribution.duration_outliers(spans, 3.0).collect()
    assert sorted(r["duration_sec"] for r in out) == [10, 200000]
    s = distribution.app_duration_stats(spans).first()
    assert (s["n"], s["min_sec"], s["median_sec"], s["max_sec"]) == (6, 1, 2, 200000)


# numbers of a published run: applications per cluster, and its level counts
CLUSTERS = {
    "1440487435730": 1, "1448006111297": 2, "1460011102909": 1,
    "1472621869829": 8, "1474351042505": 1, "1485248649253": 181,
}


def test_usage_of_a_known_distribution(spark):
    rows = [(c, i, i, i + 60) for c, n in CLUSTERS.items() for i in range(n)]
    t = timeline_of(spark, rows)
    summary = {r["cluster_id"]: r["num_applications"] for r in usage.cluster_summary(t).collect()}
    assert summary == CLUSTERS
    totals = usage.usage_totals(t).first()
    assert (totals["total_clusters"], totals["total_applications"]) == (6, 194)
    assert abs(totals["avg_apps_per_cluster"] - 194 / 6) < 1e-12
    top = [tuple(r) for r in usage.top_clusters(t).collect()]
    assert top == [
        ("1485248649253", 181), ("1472621869829", 8), ("1448006111297", 2),
        ("1440487435730", 1), ("1460011102909", 1),
    ]
    assert usage.largest_cluster_apps(t).count() == 181
    share = {r["cluster_id"]: r["percentage"] for r in usage.cluster_share(t).collect()}
    assert round(share["1485248649253"], 1) == 93.3
    report = [r["line"] for r in reports.report_cluster_usage(t).orderBy("line_no").collect()]
    assert report[:6] == [
        "Total unique clusters: 6", "Total applications: 194",
        "Average applications per cluster: 32.33", "", "Most heavily used clusters:",
        "  Cluster 1485248649253: 181 applications",
    ]
    assert len(report) == 10


def test_level_report_of_known_counts(spark):
    counts = {"INFO": 27389482, "ERROR": 11259, "WARN": 9595}
    frame = spark.createDataFrame(
        [(k, v, v) for k, v in counts.items()] + [("", 5826268, 0)],
        "log_level string, n_lines bigint, count bigint",
    )
    report = [r["line"] for r in reports.report_log_levels(frame).orderBy("line_no").collect()]
    assert report == [
        "Total log lines processed: 33,236,604", "Total lines with log levels: 27,410,336",
        "Unique log levels found: 3", "", "Log level distribution:",
        "  INFO : 27,389,482 ( 99.92%)", "  ERROR:     11,259 (  0.04%)", "  WARN :      9,595 (  0.04%)",
    ]
    complete = {r["log_level"]: r["count"] for r in levels.level_counts_complete(frame).collect()}
    assert complete == {**counts, "DEBUG": 0}


def test_empty_input(spark):
    none = spark.createDataFrame([], "value string, file_path string")
    totals = levels.log_totals(levels.level_frame(none)).first()
    assert tuple(totals) == (0, 0, 0)
    t = usage.app_timeline(none)
    assert tuple(usage.usage_totals(t).first()) == (0, 0, None)
    no_files = spark.createDataFrame([], "file_path string, length long")
    assert tuple(usage.dataset_inventory(no_files).first()) == (0, 0, 0, 0)
    assert usage.top_apps_by_files(no_files).count() == usage.containers_per_app(no_files).count() == 0
    assert usage.largest_cluster_apps(t).count() == 0
    assert reports.report_log_levels(levels.level_frame(none)).count() == 5
    assert reports.report_cluster_usage(t).count() == 5


def test_results_do_not_depend_on_partitioning(spark, sf_dir):
    from waybill.plans.demo_logs import log_lines

    lines = log_lines(spark, sf_dir)
    spread = lines.repartition(13)
    for operator in (
        levels.level_frame, levels.sample_by_text, usage.app_timeline,
        lambda x: distribution.app_duration_stats(distribution.largest_cluster_durations(usage.app_timeline(x)))
        .drop("stddev_sec"),
    ):
        a, b = (sorted(map(tuple, operator(x).collect())) for x in (lines, spread))
        assert a == b
    frame = levels.level_frame(lines)
    totals = levels.log_totals(frame).first()
    assert sum(r["count"] for r in levels.log_level_counts(frame).collect()) == totals["lines_with_level"]
    assert usage.app_timeline(lines).filter("start_time > end_time").count() == 0


def test_sorted_outputs(spark, sf_dir):
    from __spark_entry__ import queries

    q = queries()
    rows = q["app_timeline"](spark, sf_dir).collect()
    assert [r[:2] for r in rows] == sorted(r[:2] for r in rows)
    counts = q["log_level_counts"](spark, sf_dir).collect()
    assert [-r["count"] for r in counts] == sorted(-r["count"] for r in counts)
    days = [r[:3] for r in q["daily_summary"](spark, sf_dir).collect()]
    assert days == sorted(days, reverse=True)


# multi-line entries

def _entry_oracle(files):
    out = []
    for name, rows in files.items():
        head = (None, None)
        for line in rows:
            stamped = len(line) > 16 and line[2:3] == "/" and line[14:15] == ":"
            if stamped:
                head = (line[:17], next((w for w in ("INFO", "WARN", "ERROR") if w in line), ""))
            out.append((name, line, not stamped, *head))
    return sorted(out, key=str)


def test_entries_across_blocks(spark, tmp_path):
    rng = random.Random(11)
    files = {}
    for f in range(4):
        rows = ["before any head", ""] if f % 2 else []
        for i in range(400):
            level = rng.choice(["INFO", "WARN", "ERROR", ""])
            rows.append(f"24/01/02 03:{i // 60:02d}:{i % 60:02d} {level} a.B: message {f} {i}")
            rows += [f"\tat x.Y({f}.{i}.{j})" for j in range(rng.choice([0, 0, 1, 2, 40]))]
        files[f"f{f}.log"] = rows
        (tmp_path / f"f{f}.log").write_text("\n".join(rows) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        blocks = text.scan_log_blocks(spark, str(tmp_path))
        assert blocks.select("file_path", "block_start").distinct().count() > 20
        attached = entries.attach_entries(blocks)
        # the files are cut in another way by the time the result is asked for, and one has grown
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        with open(tmp_path / "f0.log", "a") as log:
            log.write("24/01/02 04:00:00 WARN a.B: too late\n")
        got = attached.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = [
        (r["file_path"].rsplit("/", 1)[1], r["value"], r["is_continuation"], r["entry_timestamp"], r["entry_level"])
        for r in got
    ]
    assert sorted(got, key=str) == _entry_oracle(files)


def test_a_missing_block_fails(spark):
    heads = "file_path string, block_start bigint, entry_timestamp string, entry_level string"
    known = entries._inherited_heads(spark.createDataFrame([("f", 0, "t", "INFO"), ("f", 9, "?", "?")], heads))
    assert sorted((r["block_start"], r["inherited"] and r["inherited"]["entry_level"]) for r in known.collect()) == [
        (0, None), (9, "INFO"),
    ]


def test_entries_across_batches(spark, tmp_path):
    rows = ["24/01/02 03:04:05 WARN a.B: head"] + [f"\tline {i}" for i in range(50)]
    files = {f"f{i}.log": rows[i:] for i in range(3)}
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = entries.attach_entries(text.scan_log_blocks(spark, str(tmp_path))).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    got = [
        (r["file_path"].rsplit("/", 1)[1], r["value"], r["is_continuation"], r["entry_timestamp"], r["entry_level"])
        for r in got
    ]
    assert sorted(got, key=str) == _entry_oracle(files)


def test_small_blocks_share_tasks(spark, tmp_path, monkeypatch):
    from waybill.plans import catalog

    rng = random.Random(5)
    rows = {f"container_7_0001_01_00000{f}": [] for f in (1, 2)}
    for name, lines in rows.items():
        for i in range(5000):
            lines.append(f"24/01/02 03:{i // 60 % 60:02d}:{i % 60:02d} {rng.choice(['INFO', 'WARN', ''])} a.B: message {i}")
            lines += [f"\tat x.Y({i}.{j})" for j in range(rng.choice([0, 0, 3, 60]))]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    monkeypatch.setattr(catalog, "log_tree", lambda *_: str(tmp_path))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.maxPartitionNum")
    before = [spark.conf.get(n, None) for n in names]
    df = catalog.multiline_entries_blocks(spark, "")
    assert [spark.conf.get(n, None) for n in names] == before
    tasks = df.inputFiles()  # a task writes one file
    n_blocks = spark.read.parquet(*tasks).filter("_is_block").count()
    assert n_blocks > 100 and len(tasks) <= spark.sparkContext.defaultParallelism + 1
    assert sorted((tuple(r) for r in df.collect()), key=str) == _entry_oracle(rows)


# trips

def test_daily_summary_cases(spark):
    at = lambda *a: datetime.datetime(*a)
    rows = [
        (at(2021, 1, 1, 0, 0), 1.0, 0.5, 10.0, 0.0, 1.0), (at(2021, 1, 1, 23, 59), 3.0, 0.5, 20.0, 1.0, 2.0),
        (at(2021, 6, 5, 1, 0), 2.0, 0.0, 7.0, 2.0, None), (at(2020, 12, 31, 23, 59), 9.0, 9.0, 9.0, 9.0, 9.0),
        (at(2022, 1, 1, 0, 0), 9.0, 9.0, 9.0, 9.0, 9.0), (None, 1.0, 1.0, 1.0, 1.0, 1.0),
    ]
    trips = spark.createDataFrame(
        rows, "tpep_pickup_datetime timestamp_ntz, trip_distance double, mta_tax double, "
        "fare_amount double, tip_amount double, passenger_count double",
    )
    got = daily.newest_first(daily.daily_summary(trips, 2021)).collect()
    assert [tuple(r) for r in got] == [
        (2021, 6, 5, 1, 2.0, 0.0, 7.0, 2.0, None), (2021, 1, 1, 2, 2.0, 0.5, 20.0, 0.0, 2),
    ]
    assert daily.daily_summary(trips).count() == 4
    totals = daily.daily_rollup_totals(trips, "tpep_pickup_datetime", 2021).first()
    assert tuple(totals) == (2, 3, 1.5, datetime.date(2021, 1, 1), datetime.date(2021, 6, 5))


# sources and sinks

def test_csv_keeps_text_ids_and_times(spark, tmp_path):
    t = timeline_of(spark, [("1", 39, 0, 5), ("", 7, 1, 2)])
    sinks.write_csv(t, str(tmp_path / "t"))
    back = tables.scan_csv(spark, str(tmp_path / "t"), TIMELINE)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, t.collect()))
    assert "0039" in {r["app_number"] for r in back.collect()}
    saved = "".join(p.read_text() for p in (tmp_path / "t").glob("part-*.csv"))
    assert "2017-01-01 00:00:05" in saved


def test_csv_is_plain_csv(spark, tmp_path):
    texts = ["\tat x.Y(A.scala:1)", 'say "hi"', "a,b", "ends with \\", '"', "  blanks  ", "", None, "\\N", '\\"', "é | ü"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    sinks.write_csv(df, str(tmp_path / "t"))
    back = tables.scan_csv(spark, str(tmp_path / "t"), "i int, t string")
    assert dict(map(tuple, back.collect())) == dict(enumerate(texts))
    rows = [r for p in (tmp_path / "t").glob("part-*.csv") for r in list(csv.reader(open(p, newline="")))[1:]]
    assert {int(i): t for i, t in rows} == {i: t or "" for i, t in enumerate(texts)}


def test_csv_with_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([("a\nb",), ("c",)], "t string")
    sinks.write_csv(df, str(tmp_path / "t"))
    back = tables.scan_csv(spark, str(tmp_path / "t"), "t string", multi_line=True)
    assert sorted(r["t"] for r in back.collect()) == ["a\nb", "c"]


def test_sample_takes_lines_not_texts(spark):
    # one text makes up most lines: it should make up most of a sample, but not all of it
    common = spark.range(9000).select(F.lit("24/01/02 03:04:05 INFO a.B: same").alias("value"))
    rare = spark.range(1000).select(F.format_string("24/01/02 03:04:05 WARN a.B: %d", "id").alias("value"))
    lines = common.unionByName(rare).withColumn("file_path", F.lit("f"))
    got = [r["log_level"] for r in levels.sample_by_text(lines, 100).collect()]
    assert len(got) == 100 and 78 <= got.count("INFO") <= 98
    again = levels.sample_by_text(lines.repartition(7), 100).collect()
    assert sorted(r["log_level"] for r in again) == sorted(got)
    assert levels.sample_by_text(lines.filter("value LIKE '%WARN%'"), 5000).count() == 1000
    assert levels.sample_check(lines, 20, 5).first() == (20, 20)


def test_memory_units(spark):
    line = "24/01/02 03:04:05 INFO storage.MemoryStore: Block b_{0} stored as bytes in memory (estimated size {1}, free {2})"
    rows = [line.format(i, s, f) for i, (s, f) in enumerate([
        ("9.1 KiB", "2.0 GiB"), ("16.0 B", "1.0 TB"), ("1.0 MB", "3.0 MiB"), ("2.0 ZZ", "1.0 GB"), ("1.0 KB", "2.0 QQ"),
    ])]
    df = spark.createDataFrame([(r, "f") for r in rows], "value string, file_path string")
    row = tasks.block_memory(df).first()
    assert row["n_blocks"] == 5 and row["n_unread"] == 2
    assert row["stored_bytes"] == round(9.1 * 1024) + 16 + 2**20 + 1024 and row["min_free_bytes"] == 3 * 2**20


def test_facets_are_the_parts(spark):
    a, b = durations_of(spark, [1, 5, 5, 90], "a"), durations_of(spark, [7, 7], "b")
    both = a.unionByName(b)
    for operator in (distribution.duration_histogram, distribution.duration_density, distribution.duration_cdf):
        got = sorted(map(tuple, operator(both, by=["cluster_id"]).collect()))
        want = sorted((c, *r) for c, part in (("a", a), ("b", b)) for r in operator(part).collect())
        for g, w in zip(got, want, strict=True):
            assert g[0] == w[0] and g[1:] == pytest.approx(w[1:])


def test_views_do_not_meet(spark):
    one, two = tables.count_by_sql(spark.range(1)), tables.count_by_sql(spark.range(2))
    assert (one.first()["total"], two.first()["total"]) == (1, 2)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("counted_")]


def test_written_folders_can_be_removed(spark):
    path = scratch.new_folder(spark, "x")
    spark.range(3).write.parquet(path)
    assert scratch.remove(spark, path) and not scratch.remove(spark, path)
    with pytest.raises(ValueError):
        scratch.remove(spark, "/tmp/other")


def test_source_health(spark, sf_dir, tmp_path):
    (tmp_path / "bad.parquet").write_text("no parquet")
    got = {
        r["source"]: r for r in tables.source_health(
            spark, {"orders": f"{sf_dir}/orders.parquet", "gone": f"{sf_dir}/gone", "bad": str(tmp_path / "bad.parquet")}
        ).collect()
    }
    assert got["orders"]["ok"] and got["orders"]["n_columns"] == 6
    assert not got["gone"]["ok"] and got["gone"]["error_class"] == "PATH_NOT_FOUND"
    assert not got["bad"]["ok"] and got["bad"]["error_class"]


def test_month_paths():
    assert tables.month_paths("s3a://b/t", 2021, [1, 12], "yyyy={year}/trips_{year}-{month:02d}.parquet") == [
        "s3a://b/t/yyyy=2021/trips_2021-01.parquet", "s3a://b/t/yyyy=2021/trips_2021-12.parquet",
    ]


def test_scratch_follows_the_session():
    def session(master, **conf):
        return SimpleNamespace(
            conf=SimpleNamespace(get=conf.get), sparkContext=SimpleNamespace(master=master)
        )

    shared = session("spark://host", **{"spark.checkpoint.dir": "s3a://bucket/dir/"})
    a, b = scratch.new_folder(shared, "x"), scratch.new_folder(shared, "x")
    assert a.startswith("s3a://bucket/dir/waybill-x-") and a != b
    with pytest.raises(RuntimeError):
        scratch.new_folder(session("spark://host"), "x")
    assert scratch.new_folder(session("local[2]"), "x")
