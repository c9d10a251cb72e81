"""Projections between raw records, log entries and stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglantern.functions.levels import normalize_level
from loglantern.functions.text import (
    json_record,
    render_json_line,
    render_line,
    whole_number,
)
from loglantern.functions.times import DAY_FIRST_FORMAT, parse_provider_time
from loglantern.schema import ENTRY_COLUMNS

FORMATS = ("txt", "json")


def entry_columns(rows: DataFrame) -> DataFrame:
    """Stored rows to log entries."""
    return rows.select(*ENTRY_COLUMNS)


def _integer(records: DataFrame, name: str) -> Column:
    """A column as INT: as it is when already integral, parsed when text."""
    if isinstance(records.schema[name].dataType, T.IntegralType):
        return F.col(name).try_cast("int")
    return whole_number(F.col(name).cast("string"))


def raw_level(records: DataFrame, fuzzy: str = "compat") -> Column:
    return normalize_level(_integer(records, "event_type"), F.col("type"), fuzzy)


def raw_to_entries(
    records: DataFrame, fuzzy: str = "compat", zone: str = "UTC", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Raw provider records to log entries, every field normalised.

    ``time_generated`` may be a wall clock already or provider text, which is
    brought to the wall clock of ``zone``.
    """
    ts = F.col("time_generated")
    if isinstance(records.schema["time_generated"].dataType, T.StringType):
        ts = parse_provider_time(ts, zone)
    return records.select(
        *keep,
        ts.alias("ts"),
        raw_level(records, fuzzy).alias("level"),
        F.col("message"),
        _integer(records, "event_code").alias("event_code"),
        F.col("source_name").alias("source"),
    )


def stamp_entries(entries: DataFrame, created_at: Column, session_id: str | Column) -> DataFrame:
    """Log entries to rows to be stored, without their ids."""
    session = session_id if isinstance(session_id, Column) else F.lit(session_id)
    return entries.select(
        *ENTRY_COLUMNS, created_at.alias("created_at"), session.alias("session_id")
    )


def grid_view(entries: DataFrame) -> DataFrame:
    """The columns of the history grid, times as day-first text."""
    return entries.select(
        F.date_format("ts", DAY_FIRST_FORMAT).alias("timestamp"),
        "event_code",
        "level",
        "source",
        "message",
    )


def check_format(fmt: str) -> str:
    """The lower-case name of an output format; unknown names are refused."""
    name = (fmt or "").lower()
    if name not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(FORMATS)}")
    return name


def entry_line(fmt: str = "txt", legacy_json: bool = False, zone: str | None = None) -> Column:
    """The output line of an entry in a format."""
    fields = [F.col(name) for name in ENTRY_COLUMNS]
    if check_format(fmt) == "txt":
        return render_line(*fields)
    if legacy_json:
        return render_json_line(*fields, zone=zone)
    return json_record(*fields, zone=zone)


def entry_lines(
    entries: DataFrame, fmt: str = "txt", legacy_json: bool = False, zone: str | None = None
) -> DataFrame:
    return entries.select(entry_line(fmt, legacy_json, zone).alias("line"))
