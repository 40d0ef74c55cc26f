"""Lines to records: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.functions import logtext, paths


def parse_log_record(lines: DataFrame, mode: str = "loose") -> DataFrame:
    """``timestamp`` text, ``log_level``, ``component`` and the line as ``message``."""
    return lines.select(
        logtext.timestamp_text().alias("timestamp"),
        logtext.log_level(mode=mode).alias("log_level"),
        logtext.component().alias("component"),
        F.col("value").alias("message"),
    )


def enrich_log_record(lines: DataFrame, drop_unidentified: bool = False) -> DataFrame:
    """Records with a time, and the ids from their path.

    Lines outside an application folder keep empty ids unless dropped. An
    impossible date gives a null ``timestamp``, see ``timestamp_rejects``.
    """
    timed = lines.filter(logtext.timestamp_text() != "").select(
        logtext.event_time().alias("timestamp"),
        logtext.log_level().alias("log_level"),
        logtext.component().alias("component"),
        F.col("value").alias("message"),
        "file_path",
    )
    out = paths.with_application_ids(timed)
    return out.filter("application_id != ''") if drop_unidentified else out


def parse_log_timestamp(lines: DataFrame) -> DataFrame:
    """Time stamp text, its time, and whether the text was no real time."""
    return lines.select(logtext.timestamp_text().alias("timestamp_text")).select(
        "timestamp_text",
        logtext.parse_stamp("timestamp_text").alias("event_time"),
    ).select(
        "*",
        ((F.col("timestamp_text") != "") & F.col("event_time").isNull()).alias("rejected"),
    )


def timestamp_rejects(lines: DataFrame) -> DataFrame:
    """Lines with a time stamp, and how many of those are impossible dates."""
    return parse_log_timestamp(lines).agg(
        F.count_if(F.col("timestamp_text") != "").alias("n_stamped"),
        F.count_if("rejected").alias("n_rejected"),
    )


def parse_path_ids(lines: DataFrame) -> DataFrame:
    """Distinct files with the ids in their path."""
    return paths.with_application_ids(lines.select("file_path").distinct())


def parse_container_id(lines: DataFrame) -> DataFrame:
    """Distinct files with their container."""
    return lines.select("file_path").distinct().select(
        "file_path", paths.container_id().alias("container_id")
    )


def container_role(lines: DataFrame) -> DataFrame:
    """Distinct containers with their role."""
    return parse_container_id(lines).select("container_id").distinct().select(
        "container_id", paths.container_role().alias("role")
    )


def cluster_start_time(lines: DataFrame) -> DataFrame:
    """Distinct clusters with the start time their id encodes."""
    return (
        parse_path_ids(lines).select("cluster_id").distinct().filter("cluster_id != ''")
        .select("cluster_id", paths.cluster_start_time().alias("started_at"))
    )
