"""When something ran: unions of intervals, busy and idle time, timelines of stages and containers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybill.operators.running import running_total
from waybill.operators.tasks import task_durations
from waybill.operators.usage import DAY

EPOCH = "2000-01-01"


def interval_union(spans: DataFrame, keys: Sequence[str], start: str, end: str, width: int = DAY) -> DataFrame:
    """Busy and idle seconds of each group between its first start and last end, whatever overlaps.

    Spans become changes, summed per second, so a busy second is one row. A group is cut into buckets of ``width``
    seconds: the number running comes from bucket totals carried on and the changes inside a bucket; the second of the
    next change from inside the bucket or, for its last change, from the next bucket that has one. No task holds
    more than a bucket of a group, or the buckets of a group.

    Gives the keys, ``first_start``, ``last_end``, ``n_spans``, ``busy_sec``, ``idle_sec``, ``longest_gap_sec``, ``most_running``. Spans
    without start or end, or that end ahead of their start, are left out; those of no length count but are never busy.
    """
    keys = list(keys)
    second = lambda c: F.timestamp_diff("SECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))
    whole = spans.filter(F.col(end) >= F.col(start)).select(*keys, second(start).alias("_from"), second(end).alias("_to"))
    change = lambda at, up, n: F.struct(F.col(at).alias("second"), F.lit(up).alias("delta"), F.lit(n).alias("spans"))
    changes = (
        whole.select(*keys, F.inline(F.array(change("_from", 1, 1), change("_to", -1, 0))))
        .groupBy(*keys, "second").agg(F.sum("delta").alias("delta"), F.sum("spans").alias("spans"))
    )
    running = running_total(changes, keys, "second", "delta", width, "running").withColumn(
        "bucket", F.floor(F.col("second") / width)
    )
    along = Window.partitionBy(*keys).orderBy("bucket")
    following = running.groupBy(*keys, "bucket").agg(F.min("second").alias("_first")).select(
        *keys, "bucket", F.lead("_first").over(along).alias("following")
    )
    inside = Window.partitionBy(*keys, "bucket").orderBy("second")
    lengths = running.withColumn("next", F.lead("second").over(inside)).join(following, [*keys, "bucket"]).withColumn(
        "length", F.coalesce("next", "following", "second") - F.col("second")
    )
    busy = F.col("running") > 0
    at = lambda c: F.timestamp_add("SECOND", c, F.lit(EPOCH).cast("timestamp_ntz"))
    return lengths.groupBy(*keys).agg(
        at(F.min("second")).alias("first_start"), at(F.max("second")).alias("last_end"), F.sum("spans").alias("n_spans"),
        F.coalesce(F.sum(F.when(busy, F.col("length"))), F.lit(0)).alias("busy_sec"),
        F.coalesce(F.sum(F.when(~busy, F.col("length"))), F.lit(0)).alias("idle_sec"),
        F.coalesce(F.max(F.when(~busy, F.col("length"))), F.lit(0)).alias("longest_gap_sec"),
        F.max("running").alias("most_running"),
    )


def container_busy(lines: DataFrame) -> DataFrame:
    """Busy share and longest gap of each container, from its finished tasks."""
    found = interval_union(task_durations(lines), ["application_id", "container_id"], "started_at", "finished_at")
    return found.withColumn("busy_share", F.try_divide("busy_sec", F.col("busy_sec") + F.col("idle_sec")))


def stage_timeline(lines: DataFrame) -> DataFrame:
    """When each stage of an application ran, over all its containers, and how many tasks at most at once."""
    return interval_union(task_durations(lines), ["application_id", "stage"], "started_at", "finished_at")
