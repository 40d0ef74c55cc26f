"""Text reports as frames of numbered lines (``line_no``, ``line``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.operators.daily import daily_latest
from waybill.operators.usage import app_counts, top_clusters


def _numbered(lines: Column) -> Column:
    """Array of texts to rows ``line_no`` (from 1), ``line``."""
    return F.inline(F.transform(
        lines, lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"))
    ))


def report_log_levels(levels: DataFrame) -> DataFrame:
    """Totals and distribution of log levels, from a level frame."""
    level = F.struct(-F.col("count"), F.col("log_level"), F.col("count"))
    # a level frame has five rows at most
    totals = levels.agg(
        F.coalesce(F.sum("n_lines"), F.lit(0)).alias("all"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("valid"),
        F.array_sort(F.collect_list(F.when(F.col("count") > 0, level))).alias("levels"),
    )
    one_level = lambda r: F.format_string(
        "  %-5s: %,10d (%6.2f%%)", r["log_level"], r["count"], r["count"] * 100.0 / F.col("valid")
    )
    head = F.array(
        F.format_string("Total log lines processed: %,d", "all"),
        F.format_string("Total lines with log levels: %,d", "valid"),
        F.format_string("Unique log levels found: %d", F.size("levels")),
        F.lit(""),
        F.lit("Log level distribution:"),
    )
    return totals.select(_numbered(F.concat(head, F.transform("levels", one_level))))


def report_cluster_usage(timeline: DataFrame, n: int = 5) -> DataFrame:
    """Totals and the n most used clusters."""
    totals = app_counts(timeline).agg(
        F.count("*").alias("clusters"),
        F.coalesce(F.sum("num_applications"), F.lit(0)).alias("apps"),
    ).select(_numbered(F.array(
        F.format_string("Total unique clusters: %,d", "clusters"),
        F.format_string("Total applications: %,d", "apps"),
        F.format_string(
            "Average applications per cluster: %.2f",
            F.coalesce(F.try_divide("apps", "clusters"), F.lit(0.0)),
        ),
        F.lit(""),
        F.lit("Most heavily used clusters:"),
    )))
    # n rows
    best = top_clusters(timeline, n).agg(F.array_sort(F.collect_list(
        F.struct(-F.col("num_applications"), F.col("cluster_id"), F.col("num_applications"))
    )).alias("best")).select(_numbered(F.transform("best", lambda r: F.format_string(
        "  Cluster %s: %d applications", r["cluster_id"], r["num_applications"]
    ))))
    return totals.unionByName(best.select((F.col("line_no") + 5).alias("line_no"), "line"))


def report_daily(daily: DataFrame, n: int = 5) -> DataFrame:
    """The n newest days of a daily summary, eight lines each."""
    latest = daily_latest(daily, n)
    date = F.struct(-F.col("dt_year"), -F.col("dt_month"), -F.col("dt_day"))
    money = lambda label, c: F.format_string(f"  {label}: $%.2f", c)
    block = F.array(
        F.format_string("Year: %d, Month: %02d, Day: %02d", "dt_year", "dt_month", "dt_day"),
        F.format_string("  Trips: %,d", "num_trips"),
        F.format_string("  Avg Distance: %.2f miles", "mean_trip_distance"),
        money("Max MTA Tax", "max_mta_tax"),
        money("95th Percentile Fare", "q95_fare_amount"),
        money("Min Tip", "min_tip_amount"),
        F.format_string("  Avg Passengers: %d", "mean_passenger_count"),
        F.lit("-" * 40),
    )
    # n rows
    days = latest.agg(F.array_sort(F.collect_list(F.struct(date, block.alias("block")))).alias("days"))
    return days.select(_numbered(F.flatten(F.transform("days", lambda d: d["block"]))))
