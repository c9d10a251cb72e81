"""Streaming transformations: raw records to new entries, and live series."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglantern.functions.keys import entry_fingerprint
from loglantern.functions.times import (
    DAY,
    HOUR,
    bucket_label,
    event_time,
    local_now,
    time_bucket,
    time_range,
)
from loglantern.operators.aggregates import session_level_counts
from loglantern.operators.filters import level_matches, recent
from loglantern.operators.projections import raw_to_entries
from loglantern.schema import ENTRY_COLUMNS, ntz
from loglantern.sources.records import channel_records


# Wall clocks may be set back by so much; entries stamped afterwards are not late.
CLOCK_SHIFT = timedelta(hours=2)

# By this name Spark keeps, with an event-time column, how long after it state goes.
DELAY_KEY = "spark.watermarkDelayMs"


def _seconds(span: timedelta) -> str:
    return f"{span // timedelta(seconds=1)} seconds"


def _fold_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop copies inside each Arrow batch, so that a hot entry is not shuffled
    once for every copy of it."""
    for batch in batches:
        rows = pa.table({"key": batch.column("fp"), "row": pa.array(np.arange(batch.num_rows))})
        first = rows.group_by("key").aggregate([("row", "min")]).column("row_min")
        yield batch if len(first) == batch.num_rows else batch.take(first.combine_chunks())


def new_entries(
    entries: DataFrame,
    span: timedelta | str,
    now: datetime | Column | None = None,
    fold_copies: bool = True,
) -> DataFrame:
    """Drop entries seen before, over all batches of the stream.

    State is one fingerprint per entry. It goes when the watermark is a span past the
    entry's own time, also if that is still to come; the recency filter of ``span`` refuses
    every repeat by then. The watermark follows the clock: an entry dated ahead counts as
    of now for it, as it would otherwise push out entries still to come.
    """
    if isinstance(span, str):
        span = time_range(span)
    clock = local_now() if now is None else ntz(now)
    own = event_time(F.col("ts"))
    keyed = entries.withColumns(
        {
            "fp": F.unhex(entry_fingerprint()),
            "event_time": own,
            "reached": F.least(own, event_time(clock)),
        }
    )
    if fold_copies:
        keyed = keyed.mapInArrow(_fold_copies, keyed.schema)
    delay = span + CLOCK_SHIFT
    watched = keyed.withWatermark("reached", _seconds(delay))
    # State goes by the entry's own time, the watermark by the time that is reached.
    timed = F.col("event_time").alias("event_time", metadata={DELAY_KEY: delay // timedelta(milliseconds=1)})
    return (
        watched.select(*entries.columns, "fp", timed)
        .dropDuplicatesWithinWatermark(["fp"])
        .drop("fp", "event_time")
    )


def monitored_entries(
    records: DataFrame,
    channel: str,
    level: str,
    span: timedelta | str,
    now: datetime | Column | None = None,
    zone: str | None = None,
    fuzzy: str = "compat",
    fold_copies: bool = True,
) -> DataFrame:
    """What a monitor keeps: recent new entries of one channel and level.

    The clock is that of ``zone``, by default the session's, read anew for every
    batch; ``now`` sets it fixed.
    """
    if now is None:
        now = local_now(zone)
    zone = zone or records.sparkSession.conf.get("spark.sql.session.timeZone")
    entries = raw_to_entries(channel_records(records, channel), fuzzy, zone)
    kept = entries.where(recent(span, now) & level_matches(level))
    return new_entries(kept, span, now, fold_copies).select(*ENTRY_COLUMNS)


def live_level_count(entries: DataFrame, level: str) -> DataFrame:
    """How many entries of one level each session of a stream has so far: one row of
    state per session. Use output mode update or complete."""
    return session_level_counts(entries, level)


def live_series(
    entries: DataFrame, width: timedelta = HOUR, lateness: timedelta | None = None
) -> DataFrame:
    """The time series of a stream.

    Without ``lateness`` every bucket is kept as state, one row each, and late
    entries always count; use output mode update or complete. With it, whole
    hours or days are final, and sent in append mode, once they are that late.
    """
    timed = entries.where(F.col("ts").isNotNull())
    if lateness is None:
        counted = timed.groupBy(time_bucket(F.col("ts"), width).alias("time")).agg(
            F.count(F.lit(1)).alias("count")
        )
    else:
        if width not in (HOUR, DAY):
            raise ValueError("final buckets are whole hours or whole days")
        start = F.make_dt_interval(
            F.lit(0), F.lit(0), F.lit(0), F.unix_seconds("window.start").cast("decimal(18,6)")
        )
        counted = (
            timed.select(event_time(F.col("ts")).alias("event_time"))
            .withWatermark("event_time", _seconds(lateness))
            .groupBy(F.window("event_time", _seconds(width)))
            .agg(F.count(F.lit(1)).alias("count"))
            .select((ntz(datetime(1970, 1, 1)) + start).alias("time"), "count")
        )
    return counted.withColumn("label", bucket_label(F.col("time"), width))
