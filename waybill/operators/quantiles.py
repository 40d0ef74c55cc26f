"""Exact percentiles of groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cells = Sequence[Callable[[Column], Column]]


def log_cell(steps: float) -> Callable[[Column], Column]:
    """Numbers to cells whose width is a ``steps``-th of a factor e (of 1, near zero); never decreasing."""
    return lambda v: F.rint(F.signum(v.cast("double")) * F.log1p(F.abs(v.cast("double"))) * steps)


def span_cell(width: int) -> Callable[[Column], Column]:
    """Whole numbers to cells of ``width`` numbers."""
    return lambda v: F.floor(v / width)


# A double lies in one of some 1.5 million cells, then in one of some 10,000 of it,
# then among the few million doubles that are equal to seven digits.
ANY_NUMBER: Cells = (log_cell(1e3), log_cell(1e7))
DAY = 86400
SECONDS: Cells = (span_cell(DAY),)


def exact_percentile(
    df: DataFrame, keys: Sequence[str], value: str, p: str, name: str, cells: Cells = ANY_NUMBER
) -> DataFrame:
    """Per group, the smallest value with at least ``p`` of the values at or below it; for ``p`` 0 the smallest of all.

    This is ``percentile_disc`` without its one hash map per group. Equal values are counted first. Then
    the range of values is cut into cells, coarse ones first: the counts of a group's cells tell which
    holds the wanted rank, and only that cell is looked into. What is ordered in one task is the cells of a
    group, whose number the kind of value bounds, and the distinct values of one finest cell. A
    hot group is spread over its values in all other steps.

    Gives the keys (which must not be null), ``name`` and ``n_values``. ``p`` is
    decimal text, so that rank arithmetic is exact.
    """
    keys = list(keys)
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    )
    group = Window.partitionBy(*keys)
    inside = counted
    for level, cell in enumerate(cells):
        # The cell reads _n as well: a condition on _v alone would be pushed below the count, and
        # the uses of ``counted`` would no longer share one scan.
        placed = inside.withColumn("_cell", F.when(F.col("_n") > 0, cell(F.col("_v"))))
        known = [] if level == 0 else ["n_values", "_rank", "_before"]
        sums = placed.groupBy(*keys, "_cell", *known).agg(F.sum("_n").alias("_in_cell"))
        upto = F.sum("_in_cell").over(group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
        if level == 0:
            total = F.sum("_in_cell").over(group)
            sums = sums.withColumns({
                "n_values": total, "_rank": F.greatest(F.lit(1), F.ceil(total.cast("decimal(20,0)") * F.lit(Decimal(p)))), "_before": F.lit(0),
            })
        wanted = (
            sums.withColumn("_upto", F.col("_before") + upto)
            .filter("_upto >= _rank AND _upto - _in_cell < _rank")
            .select(*keys, "_cell", "n_values", "_rank", (F.col("_upto") - F.col("_in_cell")).alias("_before"))
        )
        inside = placed.drop(*known).join(wanted, [*keys, "_cell"]).drop("_cell")
    along = group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        inside.withColumn("_seen", F.col("_before") + F.sum("_n").over(along))
        .filter("_seen >= _rank")
        .groupBy(*keys)
        .agg(F.min("_v").alias(name), F.first("n_values").alias("n_values"))
    )
