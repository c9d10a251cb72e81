"""Reading raw provider records from files and file streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglantern.functions.levels import DEFAULT_CHANNELS, default_levels, level_priority
from loglantern.functions.text import trim_blanks
from loglantern.functions.times import cut_to_second
from loglantern.operators.filters import channel_is
from loglantern.operators.projections import raw_level, raw_to_entries
from loglantern.schema import RAW_SCHEMA, ntz

# Levels are looked for in this many records of a channel.
LEVEL_SAMPLE_ROWS = 1001


def read_records(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "parquet",
    schema: T.StructType = RAW_SCHEMA,
    skip_unreadable: bool = False,
    **options: str,
) -> DataFrame:
    """Raw records from Parquet, JSON or CSV files, the schema given, not inferred.

    ``skip_unreadable`` goes on with what can be read when files are damaged or
    vanish meanwhile.
    """
    tolerant = str(skip_unreadable).lower()
    return (
        spark.read.format(fmt)
        .schema(schema)
        .options(ignoreMissingFiles=tolerant, ignoreCorruptFiles=tolerant, **options)
        .load(path)
    )


def stream_records(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType = RAW_SCHEMA,
    skip_unreadable: bool = False,
    **options: str,
) -> DataFrame:
    """Raw records of a growing directory. Each file is read once; the position
    is kept in the checkpoint. ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``
    bound a batch. ``skip_unreadable`` gives up files that are damaged or vanish
    before they are read; by default these fail the batch, which can be tried again."""
    tolerant = str(skip_unreadable).lower()
    return (
        spark.readStream.format(fmt)
        .schema(schema)
        .options(ignoreMissingFiles=tolerant, ignoreCorruptFiles=tolerant, **options)
        .load(path)
    )


def _or_default(names: DataFrame, column: str, values: list[str]) -> DataFrame:
    """The few distinct names found, or the usual ones when there are none: in one
    plan, so the records are read once."""
    found = names.agg(F.collect_set(column).alias("found"))
    usual = F.array(*map(F.lit, values))
    return found.select(F.explode(F.when(F.size("found") > 0, F.col("found")).otherwise(usual)).alias(column))


def channels(records: DataFrame) -> DataFrame:
    """Channel names in use, in order; the usual three when there are none."""
    names = records.select("logfile").where(trim_blanks(F.col("logfile")) != "").distinct()
    return _or_default(names, "logfile", DEFAULT_CHANNELS).orderBy("logfile")


def channel_records(records: DataFrame, channel: str) -> DataFrame:
    if not channel or not channel.strip():
        raise ValueError("channel must not be blank")
    return records.where(channel_is(channel))


def channel_scan(
    records: DataFrame, channel: str, fuzzy: str = "compat", zone: str = "UTC"
) -> DataFrame:
    """The normalised entries of one channel."""
    return raw_to_entries(channel_records(records, channel), fuzzy, zone)


def after_mark(
    records: DataFrame, mark: datetime | None, column: str = "time_generated"
) -> DataFrame:
    """Records newer than the mark, which counts by whole seconds."""
    if mark is None:
        return records
    return records.where(F.col(column) > ntz(cut_to_second(mark)))


def advance_mark(
    records: DataFrame, mark: datetime | None, column: str = "time_generated"
) -> datetime | None:
    """The latest time seen; never goes back."""
    latest = records.agg(F.max(column)).first()[0]
    return max((t for t in (mark, latest) if t is not None), default=None)


def levels_available(
    records: DataFrame,
    channel: str,
    sample_rows: int | None = None,
    fuzzy: str = "compat",
) -> DataFrame:
    """Levels in use in a channel, by priority; its usual ones when it is empty.

    All records are looked at; ``sample_rows`` (such as ``LEVEL_SAMPLE_ROWS``) looks
    at so many only, whichever come first.
    """
    rows = channel_records(records, channel)
    if sample_rows is not None:
        rows = rows.select("event_type", "type").limit(sample_rows)
    levels = rows.select(raw_level(records, fuzzy).alias("level")).distinct()
    return _or_default(levels, "level", default_levels(channel)).orderBy(level_priority(F.col("level")), "level")
