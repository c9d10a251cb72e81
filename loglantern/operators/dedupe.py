"""Exact de-duplication over the five fields of an entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglantern.schema import ENTRY_COLUMNS


def distinct_entries(entries: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Distinct entries, nulls being equal.

    Copies are folded before the shuffle, so a row that makes up a third of the
    data sends one copy per task. ``within`` names further columns, such as the
    session, inside of which entries are compared.
    """
    return entries.select(*within, *ENTRY_COLUMNS).distinct()


def first_entries(entries: DataFrame, order: str = "id") -> DataFrame:
    """Distinct entries with the lowest ``order`` value each was seen under."""
    return entries.groupBy(*ENTRY_COLUMNS).agg(F.min(order).alias(order))
