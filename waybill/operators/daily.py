"""Daily summaries of a table of timed events."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.operators.quantiles import exact_percentile


@dataclass(frozen=True)
class TripColumns:
    """Which columns of a table play the parts of a trip record."""

    pickup: str = "tpep_pickup_datetime"
    distance: str = "trip_distance"
    tax: str = "mta_tax"
    fare: str = "fare_amount"
    tip: str = "tip_amount"
    passengers: str = "passenger_count"


def date_parts(df: DataFrame, time: str) -> DataFrame:
    """Add ``dt_year``, ``dt_month`` and ``dt_day``."""
    return df.select(
        "*",
        F.year(time).alias("dt_year"),
        F.month(time).alias("dt_month"),
        F.dayofmonth(time).alias("dt_day"),
    )


def in_year(df: DataFrame, time: str, year: int) -> Column:
    """``year(time) = year`` as a range on the raw column, which reaches the scan."""
    kind = df.schema[time].dataType
    low = F.lit(datetime(year, 1, 1).isoformat(" ")).cast(kind)
    high = F.lit(datetime(year + 1, 1, 1).isoformat(" ")).cast(kind)
    return (F.col(time) >= low) & (F.col(time) < high)


def filter_year(df: DataFrame, time: str, year: int) -> DataFrame:
    return df.filter(in_year(df, time, year))


def _by_day(df: DataFrame, time: str, year: int | None) -> DataFrame:
    """Rows of a year, or all rows with a time, with their day."""
    kept = df.filter(F.col(time).isNotNull()) if year is None else filter_year(df, time, year)
    return kept.withColumn("_day", F.to_date(time))


def _day_parts() -> list[Column]:
    return [
        F.year("_day").alias("dt_year"),
        F.month("_day").alias("dt_month"),
        F.dayofmonth("_day").alias("dt_day"),
    ]


def newest_first(daily: DataFrame) -> DataFrame:
    return daily.orderBy(F.desc("dt_year"), F.desc("dt_month"), F.desc("dt_day"))


# Size of a sketch of fares. With 99 % confidence the rank of its percentile is within 0.4 % of the wanted one; up to
# this many values a sketch holds them all, and its percentile is exact.
SKETCH_K = 800
FARE_RANK = 0.95


def _sketch(value: str) -> Column:
    return F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH_K))


def _sketched_percentile(sketch: str) -> Column:
    """The percentile of a sketch; null where no number went into it (nulls and NaN do not)."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(FARE_RANK)))


def daily_partials(trips: DataFrame, year: int | None = None, cols: TripColumns = TripColumns()) -> DataFrame:
    """What a daily summary is made of, one row per day: counts, sums, extremes and a sketch of the fares.

    A task hands on one row of bounded size for each of its days, however many fares differ. Partials of different
    inputs can be kept and merged, see ``merge_partials``.
    """
    return _by_day(trips, cols.pickup, year).groupBy("_day").agg(
        F.count("*").alias("trips"),
        F.sum(F.col(cols.distance).cast("double")).alias("distance"), F.count(cols.distance).alias("n_distance"),
        F.max(cols.tax).alias("tax"), F.min(cols.tip).alias("tip"),
        F.sum(F.col(cols.passengers).cast("double")).alias("passengers"), F.count(cols.passengers).alias("n_passengers"),
        _sketch(cols.fare).alias("fares"),
    )


def merge_partials(partials: DataFrame) -> DataFrame:
    """Partials of several inputs as one row per day again."""
    total = [F.sum(c).alias(c) for c in ("trips", "distance", "n_distance")]
    return partials.groupBy("_day").agg(
        *total, F.max("tax").alias("tax"), F.min("tip").alias("tip"),
        *[F.sum(c).alias(c) for c in ("passengers", "n_passengers")],
        F.kll_merge_agg_double("fares", F.lit(SKETCH_K)).alias("fares"),
    )


def summary_of_partials(partials: DataFrame) -> DataFrame:
    """The daily summary of partials with one row per day."""
    return partials.select(
        *_day_parts(), F.col("trips").alias("num_trips"),
        F.try_divide("distance", "n_distance").alias("mean_trip_distance"),
        F.col("tax").alias("max_mta_tax"), _sketched_percentile("fares").alias("q95_fare_amount"),
        F.col("tip").alias("min_tip_amount"),
        F.ceil(F.try_divide("passengers", "n_passengers")).alias("mean_passenger_count"),
    )


def daily_summary(trips: DataFrame, year: int | None = None, cols: TripColumns = TripColumns()) -> DataFrame:
    """Trips, mean distance, highest tax, 95th percentile of fares, lowest tip and
    mean passengers (rounded up) of every day of a year; all days without one.

    One aggregate. The percentile comes from a sketch of bounded size per task and day: exact for days of up to ``SKETCH_K``
    fares, within 0.4 % of the rank beyond (``daily_p95_exact`` has the exact one).
    """
    return summary_of_partials(daily_partials(trips, year, cols))


def newest_days(
    trips: DataFrame, n: int, cols: TripColumns = TripColumns(), last_day: Column | None = None
) -> DataFrame:
    """The trips of the n newest days.

    The times alone are read to find the first of these days, which is a scalar that is known before the trips are
    scanned. The scan gets it as a bound on the raw column, so row groups of older days are skipped where the file format has
    bounds for the column's type (Parquet: dates, and times in UTC microseconds; not zone-less times). For tables partitioned by
    time, ``last_day`` is an expression over the partition columns, the last day a partition can hold: partitions that end
    ahead of the bound are not opened.
    """
    days = (
        trips.select(F.to_date(cols.pickup).alias("_newest")).filter("_newest IS NOT NULL").distinct()
        .orderBy(F.desc("_newest")).limit(n)
    )
    first = days.agg(F.min("_newest").alias("_first"))
    bound = first.select(F.col("_first").cast(trips.schema[cols.pickup].dataType)).scalar()
    kept = trips if last_day is None else trips.filter(last_day >= first.scalar())
    return kept.filter(F.col(cols.pickup) >= bound)


def daily_latest(daily: DataFrame, n: int = 20) -> DataFrame:
    """The n newest days."""
    return newest_first(daily).limit(n)


def daily_p95_approx(df: DataFrame, time: str, value: str, year: int | None = None) -> DataFrame:
    """95th percentile per day from one sketch of bounded size per task and day.

    Exact for days of up to ``SKETCH_K`` values; beyond, the rank is within 0.4 % with 99 % confidence.
    """
    days = _by_day(df, time, year).groupBy("_day").agg(_sketch(value).alias("_sketch"))
    return days.select(*_day_parts(), _sketched_percentile("_sketch").alias("q95"))


def daily_p95_exact(df: DataFrame, time: str, value: str, year: int | None = None) -> DataFrame:
    """Exact 95th percentile per day."""
    days = _by_day(df, time, year).select("_day", value)
    return exact_percentile(days, ["_day"], value, "0.95", "q95").select(*_day_parts(), "q95")


def daily_rollup_totals(df: DataFrame, time: str, year: int | None = None) -> DataFrame:
    """Over the daily rows: days, trips, mean trips a day, first and last date."""
    days = _by_day(df, time, year).groupBy("_day").agg(F.count("*").alias("n"))
    return days.agg(
        F.count("*").alias("n_days"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_trips"),
        F.try_divide(F.sum("n"), F.count("*")).alias("mean_daily_trips"),
        F.min("_day").alias("first_date"),
        F.max("_day").alias("last_date"),
    )
