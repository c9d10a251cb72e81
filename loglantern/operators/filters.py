"""Predicates over log entries, and the filter set of the history view."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglantern.functions.text import is_blank
from loglantern.functions.times import interval, local_now, time_range
from loglantern.schema import ntz

# The choice that stands for "no session filter".
ALL_SESSIONS = "All Sessions"


def level_is(level: str) -> Column:
    """Stored-history match: exact, case counts."""
    return F.col("level") == level


def level_matches(level: str) -> Column:
    """Monitoring match: upper-cased on both sides; a blank argument is refused."""
    if is_blank(level):
        raise ValueError("level must not be blank")
    return F.upper("level") == level.upper()


def since(start: datetime | str | Column) -> Column:
    return F.col("ts") >= ntz(start)


def until(end: datetime | str | Column) -> Column:
    return F.col("ts") <= ntz(end)


def session_is(session_id: str) -> Column:
    return F.col("session_id") == session_id


def event_code_is(event_code: int) -> Column:
    return F.col("event_code") == F.lit(event_code).cast("int")


def source_is(source: str) -> Column:
    return F.col("source") == source


def source_given() -> Column:
    """Source is neither null nor empty."""
    return F.col("source").isNotNull() & (F.col("source") != "")


def channel_is(channel: str) -> Column:
    return F.col("logfile") == channel


def recent(span: timedelta | str, now: datetime | str | Column | None = None) -> Column:
    """Entries of the last ``span``; no upper bound, entries without time excluded.

    ``span`` may be the name of a range. Without ``now`` the session's wall clock
    is used, which in a stream is the recorded time of each batch.
    """
    if isinstance(span, str):
        span = time_range(span)
    clock = local_now() if now is None else ntz(now)
    return F.col("ts").isNotNull() & (F.col("ts") >= clock - interval(span))


def like_pattern(text: str) -> str:
    """Regular expression of ``LIKE '%text%'``, case of ASCII letters ignored.

    ``%`` and ``_`` in the text stay wildcards and nothing escapes them.
    """
    wild = {"%": ".*", "_": "."}
    parts = [wild.get(c) or re.escape(c) for c in text.strip("%")]
    return "(?is)" + "".join(parts)


def message_contains(text: str) -> Column:
    """Message search. Java's ``(?i)`` folds ASCII letters only, as the search must.

    For plain ASCII text a cheaper test goes first. It lets through all matches,
    and beyond them only what Unicode lower-casing turns into ASCII letters.
    """
    message = F.col("message")
    exact = message.rlike(like_pattern(text))
    if text.isascii() and not set(text) & {"%", "_"}:
        return F.contains(F.lower(message), F.lit(text.lower())) & exact
    return exact


def _named_session(session_id: str | None) -> str | None:
    return None if session_id == ALL_SESSIONS else session_id


def unless_blank(session_id: str | None) -> list[Column]:
    """Session predicate of the history queries: blank arguments filter nothing."""
    session_id = _named_session(session_id)
    return [] if is_blank(session_id) else [session_is(session_id)]


def unless_empty(session_id: str | None) -> list[Column]:
    """Session predicate of the dashboard queries: only null and "" filter nothing."""
    session_id = _named_session(session_id)
    return [] if not session_id else [session_is(session_id)]


def keep(entries: DataFrame, conditions: list[Column]) -> DataFrame:
    return entries.where(reduce(and_, conditions)) if conditions else entries


def in_scope(
    entries: DataFrame,
    session_id: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Session and time scope of the dashboard queries."""
    conditions = unless_empty(session_id)
    if start is not None:
        conditions.append(since(start))
    if end is not None:
        conditions.append(until(end))
    return keep(entries, conditions)


@dataclass(frozen=True)
class LogFilter:
    """The optional filters of the history view; absent ones add no predicate."""

    level: str | None = None
    start: datetime | None = None
    end: datetime | None = None
    session_id: str | None = None
    search: str | None = None
    event_code: int | None = None
    source: str | None = None

    def scoped(
        self,
        level: str | None = None,
        start: datetime | None = None,
        end: datetime | None = None,
        session_id: str | None = None,
    ) -> LogFilter:
        """Replace level, times and session together; the other filters stay."""
        return replace(self, level=level, start=start, end=end, session_id=session_id)

    def cleared(self) -> LogFilter:
        """Drop level, search, event code and source; session and times stay."""
        return replace(self, level=None, search=None, event_code=None, source=None)

    @property
    def active(self) -> bool:
        """True when a search, event code or source is set."""
        return not is_blank(self.search) or self.event_code is not None or not is_blank(self.source)

    @property
    def counted(self) -> bool:
        """True when at most level and session are set, by which partial counts are kept."""
        return not self.active and self.start is None and self.end is None

    def conditions(self) -> list[Column]:
        found = []
        if not is_blank(self.level):
            found.append(level_is(self.level))
        if self.start is not None:
            found.append(since(self.start))
        if self.end is not None:
            found.append(until(self.end))
        found += unless_blank(self.session_id)
        if not is_blank(self.search):
            found.append(message_contains(self.search))
        if self.event_code is not None:
            found.append(event_code_is(self.event_code))
        if not is_blank(self.source):
            found.append(source_is(self.source))
        return found

    def apply(self, entries: DataFrame) -> DataFrame:
        return keep(entries, self.conditions())
