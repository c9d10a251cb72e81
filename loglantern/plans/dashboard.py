"""The detailed report and the dashboard: several aggregates of one scope."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglantern.functions.text import code_label, short_label
from loglantern.functions.times import HOUR
from loglantern.operators.aggregates import (
    days_of,
    hourly_counts,
    level_counters,
    level_counts,
    pie_slices,
    top_event_codes,
    top_named_sources,
    top_sources,
)
from loglantern.operators.filters import in_scope
from loglantern.operators.series import time_series


def detailed_report(
    entries: DataFrame,
    session_id: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> dict[str, DataFrame]:
    """Counters, top sources, counts by hour and day, and top event codes.

    Each part reads just the column it counts; the days come out of the hours.
    """
    rows = in_scope(entries, session_id, start, end)
    return report(rows, rows, rows, rows)


def report(levels: DataFrame, times: DataFrame, sources: DataFrame, codes: DataFrame) -> dict[str, DataFrame]:
    """The report, each column taken from its own frame of entries, which may be weighted."""
    hours = hourly_counts(times)
    return {
        "counters": level_counters(levels),
        "by_level": level_counts(levels),
        "by_source": top_named_sources(sources),
        "by_hour": hours.orderBy("time"),
        "by_day": days_of(hours).orderBy("time"),
        "event_codes": top_event_codes(codes),
    }


def dashboard(entries: DataFrame, session_id: str | None = None) -> dict[str, DataFrame]:
    """The detailed report and the charts of one session, or of all."""
    rows = in_scope(entries, session_id)
    return with_charts(rows, rows, rows, rows)


def with_charts(levels: DataFrame, times: DataFrame, sources: DataFrame, codes: DataFrame) -> dict[str, DataFrame]:
    """The report and the charts, each column taken from its own frame of entries."""
    return {
        **report(levels, times, sources, codes),
        "pie": pie_slices(levels),
        "timeline": time_series(times, HOUR),
        "top_sources": source_chart(top_sources(sources)),
        "top_event_codes": code_chart(top_event_codes(codes)),
    }


def source_chart(ranking: DataFrame) -> DataFrame:
    return ranking.withColumn("label", short_label(F.col("source")))


def code_chart(ranking: DataFrame) -> DataFrame:
    return ranking.withColumn("label", code_label(F.col("event_code")))


def as_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """All parts as ``part, key, count`` rows of one result."""
    rows = None
    for part, frame in parts.items():
        if part == "counters":
            names = [name for name in frame.columns]
            pairs = ", ".join(f"'{name}', {name}" for name in names)
            frame = frame.selectExpr(f"stack({len(names)}, {pairs}) AS (key, count)")
        elif "time" in frame.columns:
            frame = frame.select(
                F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("key"), "count"
            )
        else:
            frame = frame.select(F.col(frame.columns[0]).cast("string").alias("key"), "count")
        frame = frame.select(F.lit(part).alias("part"), "key", "count")
        rows = frame if rows is None else rows.unionByName(frame)
    return rows
