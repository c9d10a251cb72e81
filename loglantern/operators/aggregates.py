"""Counts, distinct lists and top lists.

Each one is a partial and a final hash aggregate over the columns it needs, so
what is shuffled is one row per task and key, however often a key occurs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglantern.functions.levels import OTHER_LEVEL, UNKNOWN_LEVEL, level_or_unknown
from loglantern.functions.times import DAY, HOUR, time_bucket
from loglantern.operators.filters import level_matches, source_given, unless_blank, keep

# Column of the counters, levels counted in it, name of its chart slice.
COUNTERS = [
    ("error", ["Error"], "Error"),
    ("warning", ["Warning"], "Warning"),
    ("information", ["Information"], "Information"),
    ("audit_success", ["AuditSuccess"], "Audit Success"),
    ("audit_failure", ["AuditFailure"], "Audit Failure"),
    ("other", [OTHER_LEVEL, UNKNOWN_LEVEL], "Other"),
]


# Of a row that stands for several entries: for how many.
WEIGHT = "entries"


def row_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"))


def tally(rows: DataFrame) -> Column:
    """The number of entries, which a row of partial counts stands for several of."""
    return F.sum(WEIGHT) if WEIGHT in rows.columns else F.count(F.lit(1))


def _counted(rows: DataFrame, *keys: str | Column) -> DataFrame:
    return rows.groupBy(*keys).agg(tally(rows).alias("count"))


def level_counts(entries: DataFrame) -> DataFrame:
    """Rows per level; a null level counts as 'Unknown'."""
    return _counted(entries, level_or_unknown(F.col("level")).alias("level"))


def level_counters(entries: DataFrame) -> DataFrame:
    """One row of counters, added up from the counts by level."""
    by_level = level_counts(entries)

    def of(levels: list[str]) -> Column:
        return F.coalesce(F.sum(F.when(F.col("level").isin(levels), F.col("count"))), F.lit(0))

    total = F.coalesce(F.sum("count"), F.lit(0))
    return by_level.agg(
        total.cast("bigint").alias("total"),
        *[of(levels).cast("bigint").alias(name) for name, levels, _ in COUNTERS],
    )


def pie_slices(entries: DataFrame) -> DataFrame:
    """The counters as rows, empty slices left out."""
    name = reduce(
        lambda c, row: c.when(F.col("level").isin(row[1]), row[2]),
        COUNTERS[1:],
        F.when(F.col("level").isin(COUNTERS[0][1]), COUNTERS[0][2]),
    )
    return (
        level_counts(entries)
        .select(name.alias("name"), "count")
        .where("name IS NOT NULL")
        .groupBy("name")
        .agg(F.sum("count").alias("count"))
        .where("count > 0")
    )


def level_count(entries: DataFrame, level: str) -> DataFrame:
    """Rows of one level, case ignored."""
    return row_count(entries.where(level_matches(level)))


def session_level_counts(entries: DataFrame, level: str) -> DataFrame:
    """Rows of one level, case ignored, per session."""
    return _counted(entries.where(level_matches(level)), "session_id")


def _ranked(counts: DataFrame, key: str, top: int) -> DataFrame:
    return counts.orderBy(F.desc("count"), F.asc(key)).limit(top)


def top_sources(entries: DataFrame, top: int = 10) -> DataFrame:
    """Most frequent sources; the empty source takes part, null does not."""
    rows = entries.where(F.col("source").isNotNull())
    return _ranked(_counted(rows, "source"), "source", top)


def top_named_sources(entries: DataFrame, top: int = 15) -> DataFrame:
    """Most frequent sources of the detailed report: neither null nor empty."""
    return _ranked(_counted(entries.where(source_given()), "source"), "source", top)


def top_event_codes(entries: DataFrame, top: int = 10) -> DataFrame:
    rows = entries.where(F.col("event_code").isNotNull())
    return _ranked(_counted(rows, "event_code"), "event_code", top)


def hourly_counts(entries: DataFrame) -> DataFrame:
    rows = entries.where(F.col("ts").isNotNull())
    return _counted(rows, time_bucket(F.col("ts"), HOUR).alias("time"))


def daily_counts(entries: DataFrame) -> DataFrame:
    rows = entries.where(F.col("ts").isNotNull())
    return _counted(rows, time_bucket(F.col("ts"), DAY).alias("time"))


def days_of(hourly: DataFrame) -> DataFrame:
    """Daily counts added up from hourly ones, without reading the entries again."""
    return hourly.groupBy(time_bucket(F.col("time"), DAY).alias("time")).agg(
        F.sum("count").alias("count")
    )


def sessions(entries: DataFrame) -> DataFrame:
    """Session ids, latest first."""
    return (
        entries.where(F.col("session_id").isNotNull())
        .select("session_id")
        .distinct()
        .orderBy(F.desc("session_id"))
    )


def distinct_sources(entries: DataFrame, session_id: str | None = None) -> DataFrame:
    return (
        keep(entries, unless_blank(session_id))
        .where(F.col("source").isNotNull())
        .select("source")
        .distinct()
        .orderBy("source")
    )


def distinct_event_codes(
    entries: DataFrame, session_id: str | None = None, max_count: int = 100
) -> DataFrame:
    """The lowest event codes in use."""
    return (
        keep(entries, unless_blank(session_id))
        .where(F.col("event_code").isNotNull())
        .select("event_code")
        .distinct()
        .orderBy("event_code")
        .limit(max_count)
    )


def max_timestamp(entries: DataFrame) -> DataFrame:
    return entries.agg(F.max("ts").alias("ts"))


def has_records(entries: DataFrame) -> DataFrame:
    """One row telling whether there is any entry. The look is taken at once and stops
    at the first entry found."""
    return entries.sparkSession.range(1).select(F.lit(not entries.isEmpty()).alias("has_records"))


def history_summary(entries: DataFrame) -> DataFrame:
    """Number of sessions, counts by level as one text, and their total.

    Sessions and levels are counted apart, each from its own column. The text is
    built from the counts by level, a handful of rows.
    """
    by_level = level_counts(entries).withColumn("sessions", F.lit(None).cast("bigint"))
    by_session = (
        entries.where(F.col("session_id").isNotNull())
        .select("session_id")
        .distinct()
        .agg(F.count(F.lit(1)).alias("sessions"))
        .select(
            F.lit(None).cast("string").alias("level"),
            F.lit(None).cast("bigint").alias("count"),
            "sessions",
        )
    )
    item = F.concat(F.col("level"), F.lit(": "), F.col("count").cast("string"))
    return (
        by_level.unionByName(by_session)
        .agg(
            F.max("sessions").alias("sessions"),
            F.concat_ws(", ", F.array_sort(F.collect_list(item))).alias("statistics"),
            F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("total"),
        )
    )
