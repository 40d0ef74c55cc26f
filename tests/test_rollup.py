"""Sketched percentiles, pruned newest days, and stored partial aggregates."""

import time

import pytest
from pyspark.sql import functions as F

from waybill.operators import daily, rollup
from waybill.plans.catalog import TRIPS
from waybill.sources import tables

COLUMNS = daily.TripColumns(pickup="at", distance="x", tax="x", fare="x", tip="x", passengers="x")


def stages(spark):
    time.sleep(0.5)  # stage metrics arrive on a listener thread
    context = spark.sparkContext
    quantiles = context._gateway.new_array(context._jvm.double, 0)
    found = context._jsc.sc().statusStore().stageList(None, False, False, quantiles, None)
    return list(context._jvm.scala.jdk.javaapi.CollectionConverters.asJava(found))


def metric(spark, name):
    return sum(getattr(s, name)() for s in stages(spark))


def trips(spark, n, days, distinct):
    at = F.timestamp_add("DAY", (F.col("id") % days).cast("int"), F.lit("2021-01-01 10:00:00").cast("timestamp_ntz"))
    return spark.range(0, n, 1, 8).select(at.alias("at"), (F.pmod(F.xxhash64("id"), F.lit(distinct)) / 100).alias("x"))


def test_percentile_rank_is_near(spark):
    df = trips(spark, 400_000, 4, 10_000_000)
    got = daily.daily_p95_approx(df, "at", "x").collect()
    exact = {r["dt_day"]: r for r in daily.daily_p95_exact(df, "at", "x").collect()}
    assert len(got) == 4
    for r in got:
        day = df.filter(F.dayofmonth("at") == r["dt_day"])
        rank = day.agg(F.avg((F.col("x") <= r["q95"]).cast("double"))).first()[0]
        assert abs(rank - 0.95) < 0.006 and r["q95"] != 0
        assert abs(r["q95"] / exact[r["dt_day"]]["q95"] - 1) < 0.01


def test_small_days_are_exact_and_nothing_is_null(spark):
    df = trips(spark, 800 * 3, 3, 500)
    key = lambda r: (r["dt_day"], r["q95"])
    assert sorted(map(key, daily.daily_p95_approx(df, "at", "x").collect())) == sorted(map(key, daily.daily_p95_exact(df, "at", "x").collect()))
    odd = spark.createDataFrame(
        [("2021-01-01 00:00:00", None), ("2021-01-02 00:00:00", float("nan")), ("2021-01-03 00:00:00", 2.0), (None, 1.0)], "t string, x double"
    ).select(F.col("t").cast("timestamp_ntz").alias("at"), "x")
    assert {r["dt_day"]: r["q95"] for r in daily.daily_p95_approx(odd, "at", "x").collect()} == {1: None, 2: None, 3: 2.0}


def test_shuffle_does_not_grow_with_distinct_fares(spark):
    written = []
    for n in (200_000, 1_600_000):
        before = metric(spark, "shuffleWriteBytes")
        daily.daily_summary(trips(spark, n, 5, 10**9), None, COLUMNS).collect()
        written.append(metric(spark, "shuffleWriteBytes") - before)
    assert written[1] < 2 * written[0] and max(written) < 8 * 5 * 25_000  # tasks, days, bytes of a sketch


@pytest.mark.parametrize("layout", ["sorted", "partitioned"])
def test_newest_days_skip_older_files(spark, tmp_path, layout):
    df = trips(spark, 60_000, 60, 1000)
    if layout == "sorted":
        df.withColumn("at", F.to_date("at")).repartitionByRange(20, "at").write.parquet(f"{tmp_path}/t")
    else:
        df.withColumn("mm", F.month("at")).write.partitionBy("mm").parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    last_day = None if layout == "sorted" else F.last_day(F.make_date(F.lit(2021), "mm", F.lit(1)))
    before = metric(spark, "inputRecords")
    newest = daily.newest_days(stored, 1, COLUMNS, last_day)
    got = daily.daily_summary(newest, None, COLUMNS).collect()
    read = metric(spark, "inputRecords") - before
    assert [(r["dt_month"], r["dt_day"], r["num_trips"]) for r in got] == [(3, 1, 1000)]
    assert read <= 60_000 + 5_000  # the times of all trips, then the files of the newest day


def test_newest_days_of_nothing(spark):
    assert daily.newest_days(trips(spark, 0, 1, 1), 5, COLUMNS).count() == 0


def test_an_update_reads_new_files_only(spark, tmp_path):
    df = trips(spark, 9000, 90, 1000).withColumn("mm", F.month("at"))
    root, store = f"{tmp_path}/t", f"{tmp_path}/store"
    read = lambda p: tables.scan_parquet_many(spark, p, root)
    part = lambda x: daily.daily_partials(x, None, COLUMNS)
    for month in (1, 2, 3):
        one = df.filter(F.col("mm") == month)
        one.drop("mm").write.parquet(f"{root}/mm={month}")
        n = one.count()
        before = metric(spark, "inputRecords")
        assert rollup.add_new_files(spark, store, root, read, part) > 0
        extra = sum(f > 0 for f in [month - 1]) * 100  # the manifest's rows
        assert metric(spark, "inputRecords") - before <= n + 100 + extra
    assert rollup.add_new_files(spark, store, root, read, part) == 0
    days = rollup.merged(spark, store, daily.merge_partials)
    key = lambda f: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in f.collect())
    assert key(daily.summary_of_partials(days)) == key(daily.daily_summary(df, None, COLUMNS))
    assert tuple(rollup.daily_totals(days).first())[:3] == (90, 9000, 100.0)


def test_broken_updates_and_changed_files(spark, tmp_path):
    root, store = f"{tmp_path}/t", f"{tmp_path}/store"
    (tmp_path / "t").mkdir()
    log = tmp_path / "t" / "application_7_0001.log"
    log.write_text("17/03/29 10:00:00 INFO a: b\n")
    read = lambda p: spark.read.text(p).select("value", F.col("_metadata.file_path").alias("file_path"))
    with pytest.raises(ValueError):
        rollup.merged(spark, store, rollup.merge_clusters)

    def broken(lines):
        rollup.cluster_partials(lines).write.parquet(f"{store}/partials/batch=lost")
        raise RuntimeError("lost on the way")

    with pytest.raises(RuntimeError):
        rollup.add_new_files(spark, store, root, read, broken)
    assert rollup.files_seen(spark, store).count() == 0
    assert rollup.add_new_files(spark, store, root, read, rollup.cluster_partials) == 1
    summary = rollup.cluster_summary(rollup.merged(spark, store, rollup.merge_clusters)).collect()
    assert [(r["cluster_id"], r["num_applications"], r["n_lines"]) for r in summary] == [("7", 1, 1)]  # the lost partials do not count
    (tmp_path / "t" / "application_7_0002.log").touch()
    assert rollup.add_new_files(spark, store, root, read, rollup.cluster_partials) == 1
    log.write_text("17/03/29 10:00:00 INFO a: b\nmore\n")
    with pytest.raises(ValueError, match="changed"):
        rollup.add_new_files(spark, store, root, read, rollup.cluster_partials)
