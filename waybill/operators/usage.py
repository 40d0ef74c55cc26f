"""Cluster usage: application timelines, cluster summaries, concurrency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.functions import logtext, paths
from waybill.operators.running import running_total

DAY = 86400


def app_timeline(lines: DataFrame, drop_unidentified: bool = False) -> DataFrame:
    """First and last time of every application.

    Lines are first reduced to one row per file, so the path regexes run once
    per file rather than once per line, and a hot application costs no more
    than its number of files. Files outside an application folder form a group
    with empty ids unless dropped.
    """
    files = (
        lines.select("file_path", logtext.event_time().alias("at"))
        .groupBy("file_path").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    )
    apps = (
        paths.with_application_ids(files)
        .groupBy("cluster_id", "application_id", "app_number")
        .agg(F.min("first").alias("start_time"), F.max("last").alias("end_time"))
        # Applications without any time are not listed. Since the condition
        # reads both times, every consumer prunes to the same columns, and a
        # query that uses the timeline twice reuses one exchange (one scan).
        .filter("start_time IS NOT NULL AND end_time IS NOT NULL")
    )
    return apps.filter("application_id != ''") if drop_unidentified else apps


def sorted_timeline(timeline: DataFrame) -> DataFrame:
    return timeline.orderBy("cluster_id", "application_id")


def cluster_summary(timeline: DataFrame) -> DataFrame:
    """Applications, first start and last end per cluster."""
    return timeline.groupBy("cluster_id").agg(
        F.count_distinct("application_id").alias("num_applications"),
        F.min("start_time").alias("cluster_first_app"),
        F.max("end_time").alias("cluster_last_app"),
    )


def app_counts(timeline: DataFrame) -> DataFrame:
    """Applications per cluster. A timeline has one row per application."""
    return timeline.groupBy("cluster_id").agg(F.count("*").alias("num_applications"))


def usage_totals(timeline: DataFrame) -> DataFrame:
    """Clusters, applications, and mean applications per cluster."""
    return app_counts(timeline).agg(
        F.count("*").alias("total_clusters"),
        F.coalesce(F.sum("num_applications"), F.lit(0)).alias("total_applications"),
        F.try_divide(F.sum("num_applications"), F.count("*")).alias("avg_apps_per_cluster"),
    )


def top_clusters(timeline: DataFrame, n: int = 5) -> DataFrame:
    """The n clusters with most applications; ties go to the smaller id."""
    return app_counts(timeline).orderBy(F.desc("num_applications"), "cluster_id").limit(n)


def largest_cluster_apps(timeline: DataFrame) -> DataFrame:
    """Timeline of the cluster with most applications, without a driver round trip."""
    # one row, so the broadcast has a fixed size
    largest = F.broadcast(top_clusters(timeline, 1).select("cluster_id"))
    return timeline.join(largest, "cluster_id", "left_semi")


def cluster_share(timeline: DataFrame) -> DataFrame:
    """Each cluster's percentage of all applications."""
    counts = app_counts(timeline)
    total = counts.agg(F.sum("num_applications")).scalar()
    return counts.select(
        "cluster_id", "num_applications",
        F.try_divide(F.col("num_applications") * 100.0, total).alias("percentage"),
    )


def apps_per_cluster_bars(timeline: DataFrame) -> DataFrame:
    """Bar chart data: bars in descending order, with their labels."""
    return (
        app_counts(timeline)
        .select(
            F.col("cluster_id").cast("string").alias("cluster_id"),
            "num_applications",
            F.col("num_applications").cast("string").alias("label"),
        )
        .orderBy(F.desc("num_applications"), "cluster_id")
    )


def app_concurrency(timeline: DataFrame) -> DataFrame:
    """Applications running in each cluster after every second that changes it.

    At equal times an end counts before a start: ``running_before_starts`` is
    the number left after the ends, ``running`` the number after the starts.
    Starts and ends are first summed per second, so a busy second is one row.
    """
    start = F.struct(F.col("start_time").alias("at_time"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    end = F.struct(F.col("end_time").alias("at_time"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    changes = (
        timeline.select("cluster_id", F.inline(F.array(start, end)))
        .groupBy("cluster_id", "at_time")
        .agg(F.sum("up").alias("started"), F.sum("down").alias("ended"))
        .withColumn("second", F.timestamp_diff("SECOND", F.lit("2000-01-01").cast("timestamp_ntz"), "at_time"))
        .withColumn("delta", F.col("started") - F.col("ended"))
    )
    # a day holds 86400 seconds at most, and two-digit years 36525 days
    total = running_total(changes, ["cluster_id"], "second", "delta", DAY, "running")
    return total.select(
        "cluster_id", "at_time", "started", "ended",
        (F.col("running") - F.col("started")).alias("running_before_starts"),
        "running",
    )


def top_apps_by_files(files: DataFrame, n: int = 5) -> DataFrame:
    """Applications with most log files, and their bytes; ``files`` has a row per file (see ``scan_file_metadata``)."""
    return files_per_app(files).filter("application_id != ''").orderBy(F.desc("n_files"), "application_id").limit(n)


def files_per_app(files: DataFrame) -> DataFrame:
    """Files, empty files and bytes of every application; ``''`` for files outside an application folder."""
    return (
        files.select(paths.application_id().alias("application_id"), "length")
        .groupBy("application_id")
        .agg(F.count("*").alias("n_files"), F.count_if(F.col("length") == 0).alias("n_empty_files"), F.sum("length").alias("n_bytes"))
    )


def dataset_inventory(files: DataFrame) -> DataFrame:
    """Applications, files, empty files and bytes of a data set, from a row per file. No line is read."""
    apps = files_per_app(files)
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return apps.agg(
        F.count(F.nullif("application_id", F.lit(""))).alias("n_applications"),
        whole("n_files"), whole("n_empty_files"), whole("n_bytes"),
    )


def inventory_with_lines(files: DataFrame, lines: DataFrame) -> DataFrame:
    """The inventory and the number of lines, which are counted without being parsed."""
    return dataset_inventory(files).withColumn("n_lines", lines.agg(F.count("*")).scalar())


def containers_per_app(files: DataFrame) -> DataFrame:
    """Containers of each application by role, those with an empty log included; ``files`` has a row per file."""
    containers = (
        files.select(
            paths.application_id().alias("application_id"),
            paths.container_id().alias("container_id"),
        )
        .filter("container_id != ''").distinct()
    )
    return (
        containers.select("application_id", paths.container_role().alias("role"))
        .groupBy("application_id", "role").agg(F.count("*").alias("n_containers"))
    )
