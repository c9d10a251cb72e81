"""Writing entries as text or JSON lines."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from loglantern.functions.text import FILE_NAME_STOPS, is_blank
from loglantern.operators.filters import ALL_SESSIONS, session_is
from loglantern.operators.paging import newest_first
from loglantern.operators.projections import check_format, entry_lines


def dated_path(base: str, fmt: str, now: datetime | None = None) -> str:
    """``<base>/<day>/output_<time>.<format>``, in UTC."""
    if is_blank(fmt):
        raise ValueError("format must not be blank")
    now = now or datetime.now(timezone.utc)
    return f"{base}/{now:%Y%m%d}/output_{now:%Y%m%d_%H%M%S}.{fmt}"


def session_path(base: str, session_id: str, fmt: str) -> str:
    return f"{base}/{re.sub(FILE_NAME_STOPS, '_', session_id)}.{fmt}"


def write_lines(
    entries: DataFrame,
    path: str,
    fmt: str = "txt",
    legacy_json: bool = False,
    zone: str | None = None,
    mode: str = "overwrite",
) -> str:
    """Write one line per entry to a directory of text files.

    JSON comes as one valid object per line. ``legacy_json`` gives the older
    form, text lines with an indented object in them.
    """
    line_end = "\r\n" if legacy_json else "\n"
    entry_lines(entries, fmt, legacy_json, zone).write.mode(mode).text(path, lineSep=line_end)
    return path


def save_view(
    entries: DataFrame,
    base: str,
    fmt: str = "txt",
    legacy_json: bool = False,
    zone: str | None = None,
    now: datetime | None = None,
) -> str:
    """Write the entries on view, newest first, under the dated path and return where.

    The sort is by ranges, as for a session. A path that is there already is an error and
    stays as it is; no entries make an export without lines.
    """
    path = dated_path(base, fmt, now)
    rows = entries.orderBy(*newest_first(entries))
    return write_lines(rows, path, check_format(fmt), legacy_json, zone, mode="error")


def session_rows(entries: DataFrame, session_id: str | None) -> DataFrame:
    """The entries of one session, newest first."""
    if not session_id or session_id == ALL_SESSIONS:
        raise ValueError("select a specific session to export")
    rows = entries.where(session_is(session_id))
    return rows.orderBy(*newest_first(rows))


def export_session(
    entries: DataFrame,
    session_id: str | None,
    base: str,
    fmt: str = "txt",
    legacy_json: bool = False,
    zone: str | None = None,
) -> str | None:
    """Write one session, newest first, and return where; nothing when it is empty.

    The sort is by ranges, so the part files follow each other in order and no
    task holds more than its range.
    """
    check_format(fmt)
    rows = session_rows(entries, session_id)
    if entries.where(session_is(session_id)).isEmpty():
        return None
    return write_lines(rows, session_path(base, session_id, fmt), fmt, legacy_json, zone)
