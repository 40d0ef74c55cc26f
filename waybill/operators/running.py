"""Running totals that no single task has to hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, value: str, width: int, name: str
) -> DataFrame:
    """Add the sum of ``value`` up to and including each row, by whole-number ``order``.

    A plain window would put a whole group in one task. Here a group is cut
    into buckets of ``width`` order values: the buckets' sums are accumulated
    first (one row each), then each bucket adds its own rows. ``order`` must be
    unique within a group, so a bucket has at most ``width`` rows.
    """
    cut = df.withColumn("_bucket", F.floor(F.col(order) / width))
    ahead = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        cut.join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_before") + F.sum(value).over(inside))
        .drop("_bucket", "_before")
    )
