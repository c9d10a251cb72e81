"""Schemas of the raw provider records and of the stored log entries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.LongType()),
        T.StructField("logfile", T.StringType()),
        T.StructField("time_generated", T.TimestampNTZType()),
        T.StructField("event_type", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("event_code", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)

# The same records as a provider prints them: every field is still text.
RAW_TEXT_SCHEMA = T.StructType(
    [T.StructField("record_id", T.LongType())]
    + [T.StructField(f.name, T.StringType()) for f in RAW_SCHEMA.fields[1:]]
)

# One log entry; two entries are the same when all five fields are the same.
ENTRY_COLUMNS = ("ts", "level", "message", "event_code", "source")

ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("event_code", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("session_id", T.StringType()),
    ]
)

# Directory columns of the stored table.
STORE_PARTITIONS = ("ingest_date", "part")

STORE_SCHEMA = T.StructType(
    ENTRY_SCHEMA.fields
    + [
        T.StructField("ingest_date", T.DateType()),
        T.StructField("load_id", T.StringType()),
    ]
)

# The files of the table also tell the part they belong to; their order is that of writing.
FILE_SCHEMA = T.StructType(
    ENTRY_SCHEMA.fields
    + [
        T.StructField("load_id", T.StringType()),
        T.StructField("ingest_date", T.DateType()),
        T.StructField("part", T.StringType()),
    ]
)

# Stands for a provider time that is missing or cannot be read.
MISSING_TIME = datetime(1, 1, 1)


def ntz(value: datetime | str | Column) -> Column:
    """A wall-clock literal; unlike ``lit(datetime)`` no time zone is applied."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            raise ValueError("expected a wall-clock time without a time zone")
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")
