"""The stored history as one object, with the queries the application asks of it."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglantern.functions.times import HOUR
from loglantern.operators import aggregates
from loglantern.operators.filters import LogFilter, in_scope, keep, unless_blank, unless_empty
from loglantern.operators.aggregates import WEIGHT
from loglantern.operators.paging import DEFAULT_PAGE_SIZE, count_logs, get_logs, page_by_hours
from loglantern.operators.projections import entry_columns
from loglantern.operators.series import time_series
from loglantern.plans import dashboard as charts
from loglantern.plans.rollups import dashboard_from_rollups, report_from_rollups
from loglantern.sources.export import export_session
from loglantern.sources.store import EntryStore


class History:
    """Queries over a store, or over any frame of entries for reading only."""

    def __init__(self, store: EntryStore | None = None, entries: DataFrame | None = None):
        if (store is None) == (entries is None):
            raise ValueError("give either a store or a frame of entries")
        self.store = store
        self._entries = entries

    @property
    def entries(self) -> DataFrame:
        return self._entries if self.store is None else self.store.read()

    def _searched(self, filters: LogFilter | None) -> DataFrame:
        """The entries, without files that cannot hold the searched text."""
        search = filters.search if filters else None
        return self.entries if self.store is None else self.store.read(search=search)

    def save_logs(self, logs: DataFrame, session_id: str) -> int:
        return self.store.append(logs, session_id)

    def get_logs(
        self,
        page: int = 1,
        size: int = DEFAULT_PAGE_SIZE,
        filters: LogFilter | None = None,
    ) -> tuple[DataFrame, DataFrame]:
        """A page and the number of all rows. Where the store keeps partial counts and the
        filter is by level and session only, both come from the counts: the entries are read
        once, where the page is."""
        filters = filters or LogFilter()
        if self.store is None or not self.store.rollups or not filters.counted:
            return get_logs(self._searched(filters), page, size, filters)
        version = self.store.version()
        hours = filters.apply(self.store.read_rollups(version).where(F.col("kind") == "hour"))
        found = page_by_hours(filters.apply(self.store.read(version)), hours, page, size)
        return entry_columns(found), hours.agg(F.coalesce(F.sum(WEIGHT), F.lit(0)).alias("total"))

    def count_logs(self, filters: LogFilter | None = None) -> DataFrame:
        return count_logs(self._searched(filters), filters)

    def session_ids(self) -> DataFrame:
        return aggregates.sessions(self.entries)

    def distinct_sources(self, session_id: str | None = None) -> DataFrame:
        return aggregates.distinct_sources(self.entries, session_id)

    def distinct_event_codes(
        self, session_id: str | None = None, max_count: int = 100
    ) -> DataFrame:
        return aggregates.distinct_event_codes(self.entries, session_id, max_count)

    def source_options(self, session_id: str | None = None) -> DataFrame:
        return source_options(self.entries, session_id)

    def delete_old_logs(self, older_than: datetime) -> int:
        return self.store.delete_older_than(older_than)

    def clear_all_logs(self) -> int:
        return self.store.clear()

    def log_statistics(self, session_id: str | None = None) -> DataFrame:
        return aggregates.level_counts(keep(self.entries, unless_blank(session_id)))

    def logs_by_level(self, session_id: str | None = None) -> DataFrame:
        return aggregates.level_counts(keep(self.entries, unless_empty(session_id)))

    def detailed_statistics(
        self,
        session_id: str | None = None,
        start: datetime | None = None,
        end: datetime | None = None,
    ) -> dict[str, DataFrame]:
        if self.store is not None and self.store.rollups and start is None and end is None:
            return report_from_rollups(self.store.read_rollups(), session_id)
        return charts.detailed_report(self.entries, session_id, start, end)

    def time_series(
        self,
        session_id: str | None = None,
        start: datetime | None = None,
        end: datetime | None = None,
        width: timedelta = HOUR,
    ) -> DataFrame:
        return time_series(in_scope(self.entries, session_id, start, end), width)

    def top_sources(self, top: int = 10, session_id: str | None = None) -> DataFrame:
        return aggregates.top_sources(in_scope(self.entries, session_id), top)

    def top_event_codes(self, top: int = 10, session_id: str | None = None) -> DataFrame:
        return aggregates.top_event_codes(in_scope(self.entries, session_id), top)

    def dashboard(self, session_id: str | None = None) -> dict[str, DataFrame]:
        """From the partial counts where the store keeps them, else from the entries."""
        if self.store is not None and self.store.rollups:
            return dashboard_from_rollups(self.store.read_rollups(), session_id)
        return charts.dashboard(self.entries, session_id)

    def summary(self) -> DataFrame:
        return aggregates.history_summary(self.entries)

    def has_records(self) -> bool:
        return not self.entries.isEmpty()

    def export_session(
        self,
        session_id: str,
        base: str,
        fmt: str = "txt",
        legacy_json: bool = False,
        zone: str | None = None,
    ) -> str | None:
        return export_session(self.entries, session_id, base, fmt, legacy_json, zone)


def source_options(entries: DataFrame, session_id: str | None = None) -> DataFrame:
    """Choices of the source filter: the empty choice, then every source."""
    empty = entries.sparkSession.range(1).select(
        F.lit("").alias("source"), F.lit(0).alias("position")
    )
    sources = aggregates.distinct_sources(entries, session_id).withColumn("position", F.lit(1))
    return empty.unionByName(sources).orderBy("position", "source").select("source")
