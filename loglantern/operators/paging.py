"""Ordering and paging of the history."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from loglantern.functions.keys import entry_fingerprint
from loglantern.functions.levels import level_priority
from loglantern.operators.aggregates import WEIGHT, row_count
from loglantern.operators.filters import LogFilter
from loglantern.operators.projections import entry_columns
from loglantern.schema import ENTRY_COLUMNS, ntz

# --- fixed values -----------------------------------------------------------

PAGE_SIZES = (25, 50, 100, 200, 500)
DEFAULT_PAGE_SIZE = 50
MAX_PAGE_SIZE = 10_000  # a page passes through the driver by its keys

# ----------------------------------------------------------------------------

# No task keeps more rows than this for a page; the rows before it are counted away.
TOP_ROWS = 100_000
# Buckets a counting pass splits its range into.
FAN_OUT = 20_000
# Characters by which the beginning of a load's name grows from pass to pass.
NAME_STEP = 2


def tie_break(rows: DataFrame) -> list[str]:
    """Columns that order rows of one time: the id, in a store behind the load."""
    return [name for name in ("load_id", "id") if name in rows.columns]


def newest_first(rows: DataFrame) -> list[Column]:
    """Latest time first, entries without time last, ties by latest id."""
    return [F.desc_nulls_last("ts"), *map(F.desc, tie_break(rows))]


def page_count(total: Column, size: int = DEFAULT_PAGE_SIZE) -> Column:
    """Number of pages; no rows still make one page."""
    return F.greatest(F.lit(1), F.ceil(total / F.lit(size))).cast("bigint")


def _check_page(page: int, size: int) -> None:
    if page < 1:
        raise ValueError("pages are counted from 1")
    if not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"a page holds 1 to {MAX_PAGE_SIZE} rows")


def page_rows(
    rows: DataFrame,
    page: int = 1,
    size: int = DEFAULT_PAGE_SIZE,
    top_rows: int = TOP_ROWS,
) -> DataFrame:
    """The rows of one page, newest first; empty past the end.

    Jobs run at once find the page by time and tie-break columns alone; the page
    is then read with its bounds pushed to the scan, so that messages are read
    only where the page can be. Entries without a tie-break column are
    sorted as they are, ties by their fingerprint.
    """
    _check_page(page, size)
    return _page_at(rows, (page - 1) * size, size, top_rows)


def _page_at(rows: DataFrame, skip: int, size: int, top_rows: int) -> DataFrame:
    ties = tie_break(rows)
    if not ties:
        ties = [entry_fingerprint()] if set(ENTRY_COLUMNS) <= set(rows.columns) else []
        return rows.orderBy(*newest_first(rows), *ties).offset(skip).limit(size)
    keys, left = _seek(rows.select("ts", *ties), skip, size, top_rows)
    found = keys.orderBy(*newest_first(rows)).offset(left).limit(size).collect()
    if not found:
        return rows.limit(0)
    first, last = found[0], found[-1]
    in_page = _behind(rows, first["ts"], [first[n] for n in ties], inclusive=True)
    in_page &= ~_behind(rows, last["ts"], [last[n] for n in ties])
    if last["ts"] is not None:
        # Said once more on their own, as bounds the scan can use.
        in_page &= (F.col("ts") >= ntz(last["ts"])) & (F.col("ts") <= ntz(first["ts"]))
    # No more rows than that are left; the limit makes it a top-k, not a global sort.
    return rows.where(in_page).orderBy(*newest_first(rows)).limit(size)


def page_by_hours(
    rows: DataFrame,
    hours: DataFrame,
    page: int = 1,
    size: int = DEFAULT_PAGE_SIZE,
    top_rows: int = TOP_ROWS,
) -> DataFrame:
    """The same page, found by counts: ``hours`` has the start of an hour as ``ts`` (null:
    without time) and how many of the rows lie in it.

    The counts tell the hours of the page, at any depth, so the rows are read once, in
    these hours alone. Where so many rows lie before the page in its first hour that a task
    should not keep them, it is looked for in there as ``page_rows`` does.
    """
    _check_page(page, size)
    skip = (page - 1) * size
    day = F.to_date("ts")
    n = F.sum(WEIGHT).alias("n")
    days = hours.groupBy(day.alias("start")).agg(n).orderBy(F.desc_nulls_last("start")).collect()
    begin, end, before = _covering(days, skip, size)
    if begin == end:
        return rows.limit(0)
    near = [d.start for d in days[begin:end]]
    inside = (day >= F.lit(near[-1] or near[0])) & (day <= F.lit(near[0])) if near[0] else F.lit(False)
    if near[0] and near[-1] is None:
        inside = day <= F.lit(near[0])
    hour = hours.where(inside | day.isNull() if near[-1] is None else inside)
    found = hour.groupBy(F.col("ts").alias("start")).agg(n).orderBy(F.desc_nulls_last("start")).collect()
    first, last, ahead = _covering(found, skip - before, size)
    high, low = found[first].start, found[last - 1].start
    ts = F.col("ts")
    timed = ts < ntz(high + timedelta(hours=1)) if high is not None else F.lit(False)
    held = timed | ts.isNull() if low is None else timed & (ts >= ntz(low))
    skip -= before + ahead
    rows = rows.where(held)
    if skip + size <= max(top_rows, size):
        return rows.orderBy(*newest_first(rows)).offset(skip).limit(size)
    return _page_at(rows, skip, size, top_rows)


def _covering(counts: list[Row], skip: int, size: int) -> tuple[int, int, int]:
    """The ranges, in order, that rows ``skip`` to ``skip + size`` lie in: the first, the one
    behind the last, and the rows before the first."""
    begin = before = 0
    while begin < len(counts) and before + counts[begin].n <= skip:
        before += counts[begin].n
        begin += 1
    end, reach = begin, before
    while end < len(counts) and reach < skip + size:
        reach += counts[end].n
        end += 1
    return begin, end, before


def page_after(
    rows: DataFrame, last: Mapping[str, object] | Row, size: int = DEFAULT_PAGE_SIZE
) -> DataFrame:
    """The page behind ``last``, a row with the time and the tie-break columns.

    The bound reaches the scan, so going on costs the same at any depth.
    """
    _check_page(1, size)
    return (
        rows.where(_behind(rows, last["ts"], [last[name] for name in tie_break(rows)]))
        .orderBy(*newest_first(rows))
        .limit(size)
    )


def _behind(
    rows: DataFrame, last_ts: datetime | None, ties: list, inclusive: bool = False
) -> Column:
    """Rows that come after one with this time and these tie-break values."""
    lower, same = F.lit(False), F.lit(True)
    for name, value in zip(tie_break(rows), ties):
        lower = lower | (same & (F.col(name) < value))
        same = same & (F.col(name) == value)
    if inclusive:
        lower = lower | same
    ts = F.col("ts")
    if last_ts is None:
        return ts.isNull() & lower
    mark = ntz(last_ts)
    return ts.isNull() | (ts < mark) | ((ts == mark) & lower)


def get_logs(
    entries: DataFrame,
    page: int = 1,
    size: int = DEFAULT_PAGE_SIZE,
    filters: LogFilter | None = None,
) -> tuple[DataFrame, DataFrame]:
    """One page of the filtered history, and the number of all rows in it."""
    rows = (filters or LogFilter()).apply(entries)
    return entry_columns(page_rows(rows, page, size)), row_count(rows)


def count_logs(entries: DataFrame, filters: LogFilter | None = None) -> DataFrame:
    """The number of all rows in the filtered history, without looking for a page."""
    return row_count((filters or LogFilter()).apply(entries))


def sort_page(page: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Sort the rows of one page by a column."""
    return page.orderBy(F.asc(column) if ascending else F.desc(column))


def severity_order() -> list[Column]:
    return [level_priority(F.col("level")), F.asc("level")]


# --- finding a page -----------------------------------------------------------
#
# Rows are ordered by time and tie-break. One pass counts the rows of every day,
# which tells the days the page lies in; for most pages a top-k over the keys of
# those days does the rest. Where too many rows of the first day come before the
# page, further passes count the rows in each of FAN_OUT equal ranges of that day,
# then inside the range the page begins in, and so on. When one single time holds
# too many rows, the ids under it are split the same way. Every pass reads a narrow
# column, with its bounds pushed to the scan, and returns counts only.

_EPOCH = datetime(1970, 1, 1)
_MICRO = timedelta(microseconds=1)
_DAY = timedelta(days=1) // _MICRO


def _number(value: datetime | int) -> int:
    return (value - _EPOCH) // _MICRO if isinstance(value, datetime) else value


def _time_ranges(step: int, offset: int) -> Column:
    window = F.window("ts", f"{step} microseconds", startTime=f"{offset} microseconds")
    return window.getField("start")


def _id_ranges(step: int, offset: int) -> Column:
    return F.col("id") - F.pmod(F.col("id") - F.lit(offset), F.lit(step))


def _time_literal(number: int) -> Column:
    return ntz(_EPOCH + number * _MICRO)


def _descend(
    rows: DataFrame,
    column: str,
    ranges: Callable[[int, int], Column],
    literal: Callable[[int], Column],
    low: int,
    high: int,
    skip: int,
    fits: Callable[[int], bool],
) -> tuple[int, int]:
    """Lower ``high`` to the end of the range the row at ``skip`` lies in.

    Stops when the rows still to skip fit or the range is one single value.
    """
    while not fits(skip) and low < high:
        step = -(-(high - low + 1) // FAN_OUT)
        inside = (F.col(column) >= literal(low)) & (F.col(column) <= literal(high))
        counts = (
            rows.where(inside)
            .groupBy(ranges(step, (high + 1) % step).alias("start"))
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("start"))
            .collect()
        )
        for start, n in counts:
            if skip < n:
                break
            skip -= n
        low, high = max(low, _number(start)), _number(start) + step - 1
    return high, skip


def _find_load(rows: DataFrame, skip: int) -> tuple[str, int]:
    """The load that the row at ``skip`` lies in, latest first, and how many of its rows
    come before. Loads are counted by the beginnings of their names, a little longer
    each time, so that the driver never sees all of them."""
    start = ""
    while True:
        head = F.substring("load_id", 1, len(start) + NAME_STEP)
        counts = (
            rows.where(F.startswith("load_id", F.lit(start)))
            .groupBy(head.alias("start"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("load_id").alias("low"), F.max("load_id").alias("high"))
            .orderBy(F.desc("start"))
            .collect()
        )
        for start, n, low, high in counts:
            if skip < n:
                break
            skip -= n
        if low == high:
            return low, skip


def _top_ties(rows: DataFrame, skip: int, fits: Callable[[int], bool]) -> tuple[Column, int]:
    """For rows of one time: those to begin at, and how many of them to skip."""
    ids = rows
    ahead = F.lit(False)
    if "load_id" in tie_break(rows):
        load = F.col("load_id")
        load_id, skip = _find_load(rows, skip)
        ahead = load < load_id
        ids = rows.where(load == load_id)
    low, high = ids.agg(F.min("id"), F.max("id")).first()
    high, skip = _descend(ids, "id", _id_ranges, F.lit, low, high, skip, fits)
    begin = F.col("id") <= high
    return (begin if ids is rows else ahead | ((load == load_id) & begin)), skip


def _seek(keys: DataFrame, skip: int, size: int, top_rows: int) -> tuple[DataFrame, int]:
    """Cut the keys down to a range holding the page; how many of them to skip."""

    def fits(left: int) -> bool:
        return left + size <= max(top_rows, size)

    ts = F.col("ts")
    timed = keys.where(ts.isNotNull())
    days = (
        timed.groupBy(_time_ranges(_DAY, 0).alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("day"))
        .collect()
    )
    position = 0
    while position < len(days) and skip >= days[position].n:
        skip -= days[position].n
        position += 1
    if position == len(days):
        untimed = keys.where(ts.isNull())
        if skip >= untimed.count():
            return keys.limit(0), 0
        begin, skip = _top_ties(untimed, skip, fits)
        return untimed.where(begin), skip

    # The days from here on that are sure to hold the page; none may remain.
    reach, end = 0, position
    while end < len(days) and reach < skip + size:
        reach += days[end].n
        end += 1
    enough = reach >= skip + size
    tail = ts >= ntz(days[end - 1].day) if enough else ts.isNull()

    low = _number(days[position].day)
    high, skip = _descend(
        timed, "ts", _time_ranges, _time_literal, low, low + _DAY - 1, skip, fits
    )
    begin = _time_literal(high)
    ahead = ts <= begin
    if not fits(skip):
        same, skip = _top_ties(timed.where(ts == begin), skip, fits)
        ahead = (ts < begin) | ((ts == begin) & same)
    return keys.where(ahead & tail if enough else ahead | tail), skip
