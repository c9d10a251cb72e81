"""Fingerprint of a log entry, for keyed state and comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglantern.functions.times import wall_seconds
from loglantern.schema import ENTRY_COLUMNS


def _measured(text: Column) -> Column:
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def entry_fingerprint() -> Column:
    """SHA-256 (hex) over the five fields of an entry.

    Each field is written behind its length, and a null as a lone dash, so that
    different entries never give the same text.
    """
    ts, *rest = ENTRY_COLUMNS
    parts = [wall_seconds(F.col(ts)), *map(F.col, rest)]
    parts = [part.cast("string") for part in parts]
    return F.sha2(F.concat_ws("|", *map(_measured, parts)), 256)
