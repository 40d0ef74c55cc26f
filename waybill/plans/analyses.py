"""Whole analyses: every result table, report and chart table written in one go.

Each reads its input once and keeps the small frame all results come from in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from waybill.operators import daily, distribution, levels, reports, usage
from waybill.sources.scratch import checkpointed
from waybill.sources.sinks import write_csv, write_report


def log_level_analysis(lines: DataFrame, out: str, sample: int = 10) -> None:
    """``counts``, ``sample`` and ``summary`` below ``out``.

    Lines with their places (``scan_placed_lines``) are read once; others twice, as their sample has to count equal lines.
    """
    if "line_start" in lines.columns:
        frame, drawn = levels.levels_and_sample(lines, sample)
    else:
        frame, drawn = checkpointed(levels.level_frame(lines)), levels.sample_by_text(lines, sample)
    write_csv(levels.log_level_counts(frame), f"{out}/counts", one_file=True)
    write_csv(drawn, f"{out}/sample", one_file=True)
    write_report(reports.report_log_levels(frame), f"{out}/summary")


def cluster_usage_analysis(lines: DataFrame, out: str) -> None:
    """``timeline``, ``cluster_summary``, ``stats`` and the chart tables ``bars``,
    ``durations`` and ``density`` below ``out``."""
    timeline = checkpointed(usage.app_timeline(lines))
    spans = distribution.largest_cluster_durations(timeline)
    write_csv(usage.sorted_timeline(timeline), f"{out}/timeline")
    write_csv(usage.cluster_summary(timeline).orderBy("cluster_id"), f"{out}/cluster_summary")
    write_csv(usage.apps_per_cluster_bars(timeline), f"{out}/bars")
    write_csv(distribution.duration_histogram(spans).orderBy("bin"), f"{out}/durations", one_file=True)
    write_csv(distribution.duration_density_binned(spans).orderBy("point"), f"{out}/density", one_file=True)
    write_report(reports.report_cluster_usage(timeline), f"{out}/stats")


def daily_trip_analysis(
    trips: DataFrame, out: str, year: int | None = None, cols: daily.TripColumns = daily.TripColumns()
) -> None:
    """``daily`` and ``summary`` below ``out``."""
    days = checkpointed(daily.daily_summary(trips, year, cols))
    write_csv(daily.newest_first(days), f"{out}/daily")
    write_report(reports.report_daily(days), f"{out}/summary")
