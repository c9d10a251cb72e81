"""Partial counts of stored entries, which add up to the dashboard.

A part of a store is counted once, when it is written: its entries by session and level;
hour and level; source; and event code. These counts add up over any set of parts, so the dashboard
of all entries or of a session needs no entry again, and pages are found by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglantern.functions.levels import level_or_unknown
from loglantern.functions.times import hour_start
from loglantern.operators.aggregates import WEIGHT
from loglantern.operators.filters import in_scope
from loglantern.plans.dashboard import report, with_charts

# What is counted, and the column of an entry it stands for.
KINDS = {"level": "level", "hour": "ts", "source": "source", "code": "event_code"}

ROLLUP_SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("source", T.StringType()),
        T.StructField("event_code", T.IntegerType()),
        T.StructField(WEIGHT, T.LongType()),
        T.StructField("ingest_date", T.DateType()),
        T.StructField("part", T.StringType()),
    ]
)


def rollup(entries: DataFrame, *by: str) -> DataFrame:
    """The counts of the entries, for each value of the columns ``by``; the entries are read
    once and added up before they are shuffled."""
    values: dict[str, Column] = {"level": level_or_unknown(F.col("level")), "hour": hour_start(F.col("ts")), "source": F.col("source"), "code": F.col("event_code")}
    kinds = {f.name: f.dataType for f in ROLLUP_SCHEMA}

    def row(kind: str) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            *(value(kind, k).cast(kinds[column]).alias(column) for k, column in KINDS.items()),
        )

    def value(kind: str, k: str) -> Column:
        if (kind, k) == ("hour", "level"):
            return F.col("level")  # as it is: pages are filtered by it
        return values[k] if k == kind else F.lit(None)

    named = entries.select(*by, "session_id", F.explode(F.array(*map(row, KINDS))).alias("row")).select(*by, "session_id", "row.*")
    given = F.col("kind") == "hour"  # also without a time
    for kind, column in KINDS.items():
        given = given | ((F.col("kind") == kind) & F.col(column).isNotNull())
    counted = named.where(given).groupBy("session_id", "kind", *KINDS.values(), *by).agg(F.count(F.lit(1)).alias(WEIGHT))
    return counted.select(*[n for n in ROLLUP_SCHEMA.names if n in counted.columns])


def of_kind(rollups: DataFrame, kind: str) -> DataFrame:
    """The counts of a kind, added up, in the form of weighted entries."""
    column = KINDS[kind]
    return rollups.where(F.col("kind") == kind).groupBy(column).agg(F.sum(WEIGHT).alias(WEIGHT))


def report_from_rollups(rollups: DataFrame, session_id: str | None = None) -> dict[str, DataFrame]:
    """The detailed report of all times, as ``detailed_report`` gives it."""
    rows = in_scope(rollups, session_id)
    return report(*(of_kind(rows, kind) for kind in KINDS))


def dashboard_from_rollups(rollups: DataFrame, session_id: str | None = None) -> dict[str, DataFrame]:
    """The dashboard, as ``dashboard`` gives it."""
    rows = in_scope(rollups, session_id)
    return with_charts(*(of_kind(rows, kind) for kind in KINDS))
