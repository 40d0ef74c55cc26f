"""Roll-ups that are kept and grow: partial aggregates of files seen, merged when asked.

A store is a folder with ``partials`` (aggregates of one update each) and ``manifest`` (the files of each update). An update
lists the files, reads those the manifest does not have, writes their partials, and then one manifest file, which is
what makes them count. An update that is broken off leaves partials nobody names; the next one does its work again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.functions import logtext, paths
from waybill.sources.files import scan_file_metadata

SEEN = "file_path string, length long, batch string"
HLL_BITS = 14  # 2^14 registers: about 0.8 % standard error; close to exact up to some thousand ids
Step = Callable[[DataFrame], DataFrame]


def files_seen(spark: SparkSession, store: str) -> DataFrame:
    """``file_path``, ``length`` and ``batch`` of every file whose partials are in the store."""
    try:
        return spark.read.schema(SEEN).parquet(f"{store}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SEEN)


def add_new_files(
    spark: SparkSession, store: str, root: str, read: Callable[[list[str]], DataFrame], partials: Step, file_filter: str | None = None
) -> int:
    """Add the files below ``root`` (a path or pattern) that the store has not seen; their number.

    ``read`` makes a frame of their paths, ``partials`` its partial aggregates. Files that were seen are not opened. One
    that has another length than when it was seen is refused, since its old share can't be taken back.
    Empty files are noted and not read.
    """
    listed = scan_file_metadata(spark, root, file_filter).select("file_path", "length")
    seen = files_seen(spark, store).select("file_path", F.col("length").alias("_then"), F.lit(True).alias("_seen"))
    news = listed.join(seen, "file_path", "left").filter("_seen IS NULL OR length <> _then").orderBy("file_path")
    new = news.select("file_path", "length", "_then").collect()  # names of the new files, as in every listing
    changed = [r["file_path"] for r in new if r["_then"] is not None]
    if changed:
        raise ValueError(f"{len(changed)} files have changed since they were rolled up, {changed[0]} first")
    if not new:
        return 0
    batch = uuid.uuid4().hex
    full = [r["file_path"] for r in new if r["length"]]
    if full:
        partials(read(full)).write.parquet(f"{store}/partials/batch={batch}")
    noted = spark.createDataFrame([(r["file_path"], r["length"], batch) for r in new], SEEN)
    noted.coalesce(1).write.mode("append").parquet(f"{store}/manifest")
    return len(new)


def merged(spark: SparkSession, store: str, merge: Step) -> DataFrame:
    """The partials of all finished updates, merged."""
    batches = [r[0] for r in files_seen(spark, store).filter("length > 0").select("batch").distinct().collect()]  # one per update
    if not batches:
        raise ValueError(f"{store} has no files yet")
    return merge(spark.read.option("basePath", f"{store}/partials").parquet(*[f"{store}/partials/batch={b}" for b in batches]))


# ---- logs: lines, times and applications per cluster

def cluster_partials(lines: DataFrame) -> DataFrame:
    """Per cluster: lines, first and last time, and a sketch of the applications. Lines become one row per file first."""
    in_files = lines.select("file_path", logtext.event_time().alias("at")).groupBy("file_path").agg(
        F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last")
    )
    # As in a timeline, an application without any time is not listed. Sketches pass over empty texts, and files outside
    # an application folder have an empty id, so ids get a prefix.
    timed = F.when(F.col("first").isNotNull(), F.concat(F.lit("id "), "application_id"))
    return paths.with_application_ids(in_files).groupBy("cluster_id").agg(
        F.sum("n").alias("n_lines"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.hll_sketch_agg(timed, F.lit(HLL_BITS)).alias("apps"),
    )


def merge_clusters(partials: DataFrame) -> DataFrame:
    return partials.groupBy("cluster_id").agg(
        F.sum("n_lines").alias("n_lines"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.hll_union_agg("apps").alias("apps"),
    )


def cluster_summary(clusters: DataFrame) -> DataFrame:
    """Applications (estimated), lines, first start and last end per cluster, from merged partials."""
    return clusters.select(
        "cluster_id", F.hll_sketch_estimate("apps").alias("num_applications"), "n_lines",
        F.col("first").alias("cluster_first_app"), F.col("last").alias("cluster_last_app"),
    )


def usage_totals(clusters: DataFrame) -> DataFrame:
    """Clusters, applications (estimated) and mean applications per cluster, from merged partials."""
    apps = F.sum(F.hll_sketch_estimate("apps"))
    return clusters.agg(
        F.count("*").alias("total_clusters"), F.coalesce(apps, F.lit(0)).alias("total_applications"),
        F.try_divide(apps, F.count("*")).alias("avg_apps_per_cluster"),
    )


# ---- trips: see ``daily.daily_partials`` and ``daily.merge_partials``

def daily_totals(days: DataFrame) -> DataFrame:
    """Days, trips, mean trips a day, first and last date, from merged daily partials."""
    return days.agg(
        F.count("*").alias("n_days"), F.coalesce(F.sum("trips"), F.lit(0)).alias("total_trips"),
        F.try_divide(F.sum("trips"), F.count("*")).alias("mean_daily_trips"),
        F.min("_day").alias("first_date"), F.max("_day").alias("last_date"),
    )
