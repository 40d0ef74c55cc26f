"""Distribution of application durations: the data behind the charts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.operators.quantiles import SECONDS, exact_percentile
from waybill.operators.running import running_total
from waybill.operators.usage import DAY, largest_cluster_apps


def app_durations(timeline: DataFrame) -> DataFrame:
    """Seconds from start to end of every application; rows without one are dropped."""
    return timeline.select(
        "cluster_id", "application_id",
        F.timestamp_diff("SECOND", "start_time", "end_time").alias("duration_sec"),
    ).na.drop(subset=["duration_sec"])


def largest_cluster_durations(timeline: DataFrame) -> DataFrame:
    """Durations of the cluster with most applications."""
    return app_durations(largest_cluster_apps(timeline))


def _counted(durations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Equal durations become one row, so what follows depends on distinct values."""
    return durations.groupBy(*by, "duration_sec").agg(F.count("*").alias("n"))


def _with_stats(df: DataFrame, of: DataFrame, by: Sequence[str] = (), **values: Column) -> DataFrame:
    """Add aggregates over ``of`` to every row, as a struct ``s``: of all rows, or of the row's group."""
    one = F.struct(*[c.alias(k) for k, c in values.items()]).alias("s")
    if by:
        return df.join(of.groupBy(*by).agg(one), list(by))
    return df.select("*", of.agg(one).scalar().alias("s"))


def _bounds() -> dict[str, Column]:
    return {"lo": F.min("duration_sec"), "hi": F.max("duration_sec"), "total": F.sum("n")}


def duration_histogram(durations: DataFrame, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins from the shortest to the longest duration; the last is closed.

    Empty bins show 0. If all durations are equal there is one bin. Bin numbers
    are whole-number arithmetic, so no value falls beside its bin by rounding. With ``by`` (columns that are
    not null) there is a histogram for each group, with bounds of its own.
    """
    counted = _counted(durations, by)
    step = F.expr(f"((duration_sec - s.lo) * {bins}) div nullif(s.hi - s.lo, 0)")
    counts = (
        _with_stats(counted, counted, by, **_bounds())
        .select(*by, F.least(F.coalesce(step, F.lit(0)) + 1, F.lit(bins)).cast("bigint").alias("bin"), "n")
        .groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    )
    stats = F.struct(*[c.alias(k) for k, c in _bounds().items()]).alias("s")
    numbers = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(bins).cast("bigint"))).alias("bin")
    grid = counted.groupBy(*by).agg(stats).select(*by, "s", numbers).filter(
        "s.lo IS NOT NULL AND (s.hi > s.lo OR bin = 1)"
    )
    spread = F.col("s.hi") > F.col("s.lo")
    width = (F.col("s.hi") - F.col("s.lo")) / bins
    count = F.coalesce("n", F.lit(0).cast("bigint"))
    return grid.join(counts, [*by, "bin"], "left").select(
        *by, "bin",
        F.when(spread, F.col("s.lo") + (F.col("bin") - 1) * width)
        .otherwise(F.col("s.lo").cast("double")).alias("bin_start"),
        F.when(spread, F.col("s.lo") + F.col("bin") * width)
        .otherwise(F.col("s.hi").cast("double")).alias("bin_end"),
        count.alias("count"),
        F.try_divide(count, F.col("s.total") * width).alias("density"),
    )


def duration_histogram_log(durations: DataFrame, bins: int = 30) -> DataFrame:
    """The histogram with its bin edges on a log10 axis (null at or below zero)."""
    h = duration_histogram(durations, bins)
    edge = lambda c: F.when(F.col(c) > 0, F.log10(c))
    return h.select(
        "bin",
        edge("bin_start").alias("log_bin_start"),
        edge("bin_end").alias("log_bin_end"),
        "count",
    )


def duration_density(durations: DataFrame, points: int = 200, by: Sequence[str] = ()) -> DataFrame:
    """Gaussian density curve at evenly spaced points from shortest to longest.

    The bandwidth is ``stddev * N^(-1/5)``. Each distinct duration adds its
    weight to every point; the points are fixed in number, and their sums are
    combined before the shuffle. No rows when the durations do not differ. With ``by`` (columns that are
    not null) there is a curve for each group.
    """
    counted = _counted(durations, by)
    d = F.col("duration_sec").cast("decimal(38,0)")
    stats = _with_stats(
        counted, counted, by, **_bounds(), s1=F.sum(F.col("n") * d), s2=F.sum(F.col("n") * d * d)
    )
    total = F.col("s.total").cast("double")
    # sums of whole numbers are exact, so the variance does not depend on row order
    spread = F.col("s.s2").cast("double") - F.col("s.s1").cast("double") ** 2 / total
    scaled = (
        stats.filter("s.total > 1 AND s.hi > s.lo")
        .select(
            *by, "duration_sec", "n",
            F.col("s.lo").alias("lo"), (F.col("s.hi") - F.col("s.lo")).alias("range"),
            total.alias("total"),
            (F.sqrt(spread / (total - 1)) * F.pow(total, F.lit(-0.2))).alias("h"),
        )
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
        .select(
            "*", (F.col("lo") + F.col("point") * F.col("range") / (points - 1)).alias("x")
        )
    )
    z = (F.col("x") - F.col("duration_sec")) / F.col("h")
    weight = F.col("n") * F.exp(-0.5 * z * z) / (F.col("total") * F.col("h") * math.sqrt(2 * math.pi))
    return scaled.groupBy(*by, "point", "x").agg(F.sum(weight).alias("density"))


CELLS = 16  # grid cells between two points of a binned curve


def duration_density_binned(durations: DataFrame, points: int = 200, by: Sequence[str] = ()) -> DataFrame:
    """The density curve from a grid: durations are shared out to the two grid nodes beside them (linear binning), and the
    nodes' weights are convolved with a table of kernel weights, one for each distance in cells.

    The work behind the binning depends on the grid alone, ``CELLS`` times ``points`` nodes, not on the number
    of distinct durations. Sums are of whole numbers, so they do not depend on the order of rows. The curve differs from the
    direct sum by about (cell / bandwidth)^2 / 8 of its curvature; bandwidths from some cells on give three digits.
    """
    last = CELLS * (points - 1)
    counted = _counted(durations, by)
    d = F.col("duration_sec").cast("decimal(38,0)")
    stats = _with_stats(counted, counted, by, **_bounds(), s1=F.sum(F.col("n") * d), s2=F.sum(F.col("n") * d * d))
    total = F.col("s.total").cast("double")
    spread = F.col("s.s2").cast("double") - F.col("s.s1").cast("double") ** 2 / total
    # place = (duration - lo) * last / range, as a node and a whole remainder out of range
    placed = stats.filter("s.total > 1 AND s.hi > s.lo").select(
        *by, "n", F.col("s.lo").alias("lo"), (F.col("s.hi") - F.col("s.lo")).alias("range"), total.alias("total"),
        (F.sqrt(spread / (total - 1)) * F.pow(total, F.lit(-0.2))).alias("h"),
        F.expr(f"((duration_sec - s.lo) * {last}) div (s.hi - s.lo)").alias("node"),
        F.expr(f"((duration_sec - s.lo) * {last}) % (s.hi - s.lo)").alias("rest"),
    )
    share = lambda node, part: F.struct(node.alias("node"), (F.col("n") * part).cast("decimal(38,0)").alias("weight"))
    group = [*by, "lo", "range", "total", "h"]
    nodes = placed.select(*group, F.inline(F.array(
        share(F.col("node"), F.col("range") - F.col("rest")), share(F.col("node") + 1, F.col("rest")),
    ))).filter("weight > 0").groupBy(*group, "node").agg((F.sum("weight").cast("double") / F.col("range")).alias("weight"))
    z = (F.col("point") * CELLS - F.col("node")) * F.col("range") / last / F.col("h")
    kernel = F.exp(-0.5 * z * z) / (F.col("total") * F.col("h") * math.sqrt(2 * math.pi))
    x = F.col("lo") + F.col("point") * F.col("range") / (points - 1)
    return (
        nodes.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
        .groupBy(*by, "point", x.alias("x")).agg(F.sum(F.col("weight") * kernel).alias("density"))
    )


def app_duration_stats(durations: DataFrame) -> DataFrame:
    """n, shortest, median, longest, mean and standard deviation per cluster."""
    basic = durations.groupBy("cluster_id").agg(
        F.count("*").alias("n"),
        F.min("duration_sec").alias("min_sec"),
        F.max("duration_sec").alias("max_sec"),
        F.avg("duration_sec").alias("mean_sec"),
        F.stddev_samp("duration_sec").alias("stddev_sec"),
    )
    median = exact_percentile(durations, ["cluster_id"], "duration_sec", "0.5", "median_sec", SECONDS)
    return basic.join(median, "cluster_id").select(
        "cluster_id", "n", "min_sec", "median_sec", "max_sec", "mean_sec", "stddev_sec"
    )


def duration_cdf(durations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of applications that took at most each occurring duration, of all or in each group."""
    counted = _counted(durations, by)
    keys = list(by) or ["all"]
    group = counted if by else counted.withColumn("all", F.lit(0))
    total = running_total(group, keys, "duration_sec", "n", DAY, "cumulative")
    return _with_stats(total, counted, by, total=F.sum("n")).select(
        *by, "duration_sec", "n", "cumulative",
        (F.col("cumulative") / F.col("s.total")).alias("share"),
    )


def duration_outliers(durations: DataFrame, factor: float = 2.0) -> DataFrame:
    """Applications that took more than ``factor`` times their cluster's median."""
    median = exact_percentile(durations, ["cluster_id"], "duration_sec", "0.5", "median_sec", SECONDS)
    return (
        durations.join(median.select("cluster_id", "median_sec"), "cluster_id")
        .filter(F.col("duration_sec") > F.col("median_sec") * factor)
        .select("cluster_id", "application_id", "duration_sec", "median_sec")
    )
