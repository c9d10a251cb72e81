"""Every operator as a query over the given tables, with the SQL that checks it.

``QUERIES`` and ``ORACLES`` share their keys. In the SQL, ``e`` is the table of
stored entries and ``r`` that of raw records.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglantern.functions import levels as lv
from loglantern.functions.keys import entry_fingerprint
from loglantern.functions.text import code_label, safe_file_name, short_label, whole_number
from loglantern.functions.times import (
    DAY,
    HOUR,
    TIME_RANGES,
    day_start,
    json_time,
    parse_json_time,
    parse_provider_time,
    session_name,
)
from loglantern.operators import aggregates as agg
from loglantern.operators import filters as fl
from loglantern.operators import paging
from loglantern.operators import projections as pr
from loglantern.operators.dedupe import distinct_entries, first_entries
from loglantern.operators.series import time_series
from loglantern.plans import dashboard as charts
from loglantern.plans.adapter import ENTRIES_SQL, EVENTS_SCHEMA, RAW_SQL, entries_of, event_stream, events, raw_of
from loglantern.plans.history import History, source_options
from loglantern.plans.rollups import dashboard_from_rollups
from loglantern.schema import ENTRY_COLUMNS
from loglantern.sources import export, records
from loglantern.sources.shared import new_dir
from loglantern.sources.store import EntryStore, deleted_count, survivors
from loglantern.streaming.live import live_level_count, live_series, new_entries
from loglantern.streaming.monitor import Monitor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SESSION = "Session_20240115_000000_System"
NOW = datetime(2024, 1, 20, 12)
START, END = datetime(2024, 1, 10), datetime(2024, 1, 20, 18, 30)
MARK = datetime(2024, 1, 15, 12, 0, 0, 750000)
CUTOFF = datetime(2024, 1, 15, 6, 30)

FIVE = ", ".join(ENTRY_COLUMNS)


def _entries(name: str, sql: str):
    """Register a query over the stored entries."""

    def register(fn: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(entries_of(events(spark, sf_dir)))
        ORACLES[name] = f"WITH e AS ({ENTRIES_SQL}) {sql}"
        return fn

    return register


def _raw(name: str, sql: str):
    """Register a query over the raw records."""

    def register(fn: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(raw_of(events(spark, sf_dir)))
        ORACLES[name] = f"WITH r AS ({RAW_SQL}) {sql}"
        return fn

    return register


def _stamp(ts: datetime) -> str:
    return f"TIMESTAMP '{ts.isoformat(sep=' ')}'"


# --- level rules as SQL -----------------------------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(key: str, table: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in table.items())


def _any_word(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(trim(type)), {_quoted(w)})" for w in words) + ")"


def level_sql(fuzzy: str = "compat") -> str:
    audit = _any_word(lv.AUDIT_WORDS)
    outcomes = [
        f"WHEN {audit} AND {_any_word(lv.SUCCESS_WORDS)} THEN 'AuditSuccess'",
        f"WHEN {audit} AND {_any_word(lv.FAILURE_WORDS)} THEN 'AuditFailure'",
    ]
    if fuzzy == "fixed":
        outcomes.reverse()
    exact = [
        f"WHEN trim(type) IN ({', '.join(map(_quoted, names))}) THEN '{level}'"
        for level, names in lv.LEVEL_NAMES.items()
    ]
    words = [
        f"WHEN {_any_word(ws)} THEN '{level}'"
        for level, ws in [
            ("Error", lv.ERROR_WORDS),
            ("Warning", lv.WARNING_WORDS),
            ("Information", lv.INFORMATION_WORDS),
        ]
    ]
    number = f"{_case('TRY_CAST(trim(type) AS INT)', lv.TYPE_NUMBER_LEVELS)} ELSE 'Other' END"
    return (
        f"coalesce({_case('event_type', lv.EVENT_TYPE_LEVELS)} END, "
        "CASE WHEN type IS NULL OR trim(type) = '' THEN 'Unknown' "
        f"WHEN regexp_matches(trim(type), '^[+-]?[0-9]+$') THEN {number} "
        + " ".join(exact + outcomes + words)
        + " ELSE 'Other' END)"
    )


LEVEL_SQL = level_sql()
CODE_SQL = "CASE WHEN regexp_matches(event_code, '^[0-9]+$') THEN CAST(event_code AS INT) END"
PRIORITY_SQL = (
    "CASE level WHEN 'Error' THEN 1 WHEN 'Warning' THEN 2 WHEN 'Information' THEN 3 "
    "WHEN 'AuditFailure' THEN 4 WHEN 'AuditSuccess' THEN 5 ELSE 99 END"
)
NEW_ENTRY_SQL = (
    f"SELECT time_generated AS ts, {LEVEL_SQL} AS level, message, {CODE_SQL} AS event_code, "
    "source_name AS source FROM r"
)

# --- sources ----------------------------------------------------------------


@_raw("channels", "SELECT DISTINCT logfile FROM r WHERE trim(logfile) <> ''")
def _channels(r):
    return records.channels(r)


@_raw("channel_scan", f"{NEW_ENTRY_SQL} WHERE logfile = 'System'")
def _channel_scan(r):
    return records.channel_scan(r, "System")


@_raw(
    "incremental_scan",
    "SELECT record_id, time_generated FROM r "
    f"WHERE time_generated > date_trunc('second', {_stamp(MARK)})",
)
def _incremental_scan(r):
    return records.after_mark(r, MARK).select("record_id", "time_generated")


@_raw("levels_available", f"SELECT DISTINCT {LEVEL_SQL} AS level FROM r WHERE logfile = 'Security'")
def _levels_available(r):
    return records.levels_available(r, "Security")


@_raw(
    "default_levels",
    "SELECT DISTINCT logfile, unnest(CASE WHEN upper(logfile) = 'SECURITY' "
    "THEN ['AuditSuccess', 'AuditFailure'] ELSE ['Error', 'Warning', 'Information'] END) AS level "
    "FROM r",
)
def _default_levels(r):
    names = records.channels(r)
    return names.select("logfile", F.explode(lv.default_levels_of(F.col("logfile"))).alias("level"))


# --- projections and level rules ---------------------------------------------


@_raw("raw_to_entries", NEW_ENTRY_SQL)
def _raw_to_entries(r):
    return pr.raw_to_entries(r)


@_raw("level_normalize", f"SELECT record_id, event_type, type, {LEVEL_SQL} AS level FROM r")
def _level_normalize(r):
    return r.select("record_id", "event_type", "type", pr.raw_level(r).alias("level"))


@_raw(
    "level_normalize_fixed",
    f"SELECT record_id, type, {level_sql('fixed')} AS level FROM r",
)
def _level_normalize_fixed(r):
    return r.select("record_id", "type", pr.raw_level(r, "fixed").alias("level"))


@_raw(
    "level_priority_order",
    f"SELECT level, {PRIORITY_SQL} AS priority "
    f"FROM (SELECT DISTINCT {LEVEL_SQL} AS level FROM r)",
)
def _level_priority_order(r):
    found = r.select(pr.raw_level(r).alias("level")).distinct()
    return found.withColumn("priority", lv.level_priority(F.col("level"))).orderBy(
        *paging.severity_order()
    )


@_raw(
    "provider_time",
    "SELECT record_id, CASE record_id % 5 "
    "WHEN 0 THEN time_generated - INTERVAL 60 MINUTE "
    "WHEN 1 THEN time_generated + INTERVAL 300 MINUTE "
    "WHEN 2 THEN time_generated ELSE TIMESTAMP '0001-01-01 00:00:00' END AS ts FROM r",
)
def _provider_time(r):
    offset = F.expr(
        "CASE record_id % 5 WHEN 0 THEN '+060' WHEN 1 THEN '-300' WHEN 2 THEN '+***' "
        "WHEN 3 THEN 'garbage' END"
    )
    text = F.concat(F.date_format("time_generated", "yyyyMMddHHmmss.SSSSSS"), offset)
    return r.select("record_id", parse_provider_time(text).alias("ts"))


@_raw(
    "event_code_parse",
    f"SELECT record_id, CASE record_id % 5 WHEN 0 THEN {CODE_SQL} WHEN 1 THEN -{CODE_SQL} "
    f"WHEN 2 THEN {CODE_SQL} END AS event_code FROM r",
)
def _event_code_parse(r):
    text = F.expr(
        "CASE record_id % 5 WHEN 0 THEN concat(' ', event_code, ' ') "
        "WHEN 1 THEN concat('-', event_code) WHEN 2 THEN concat('+', event_code) "
        "WHEN 3 THEN concat(event_code, '.5') ELSE concat('9', event_code, '0000000000') END"
    )
    return r.select("record_id", whole_number(text).alias("event_code"))


@_entries("entry_columns", f"SELECT {FIVE} FROM e")
def _entry_columns(e):
    return pr.entry_columns(e)


@_entries(
    "stamped_entries",
    f"SELECT {FIVE}, {_stamp(NOW)} AS created_at, '{SESSION}' AS session_id FROM e",
)
def _stamped_entries(e):
    return pr.stamp_entries(e, fl.ntz(NOW), SESSION)


@_entries(
    "grid_view",
    "SELECT strftime(ts, '%d.%m.%Y %H:%M:%S') AS timestamp, event_code, level, source, message FROM e",
)
def _grid_view(e):
    return pr.grid_view(e)


# --- filters ----------------------------------------------------------------


@_entries("filter_level_exact", "SELECT * FROM e WHERE level = 'Error'")
def _filter_level_exact(e):
    return fl.LogFilter(level="Error").apply(e)


@_entries("filter_level_ci", "SELECT * FROM e WHERE upper(level) = upper('auditSUCCESS')")
def _filter_level_ci(e):
    return e.where(fl.level_matches("auditSUCCESS"))


@_entries("filter_time_range", f"SELECT * FROM e WHERE ts >= {_stamp(START)} AND ts <= {_stamp(END)}")
def _filter_time_range(e):
    return fl.LogFilter(start=START, end=END).apply(e)


@_entries("filter_last_24h", f"SELECT * FROM e WHERE ts >= {_stamp(NOW - DAY)}")
def _filter_last_24h(e):
    return e.where(fl.recent("Last 24 hours", NOW))


@_entries(
    "filter_named_ranges",
    " UNION ALL ".join(
        f"SELECT '{name}' AS name, count(*) AS total FROM e WHERE ts >= {_stamp(NOW - span)}"
        for name, span in TIME_RANGES.items()
    ),
)
def _filter_named_ranges(e):
    counted = e.agg(*[F.count_if(fl.recent(name, NOW)).alias(name) for name in TIME_RANGES])
    pairs = ", ".join(f"'{name}', `{name}`" for name in TIME_RANGES)
    return counted.selectExpr(f"stack({len(TIME_RANGES)}, {pairs}) AS (name, total)")


@_entries("filter_session", f"SELECT * FROM e WHERE session_id = '{SESSION}'")
def _filter_session(e):
    return fl.LogFilter(session_id=SESSION).apply(e)


@_entries("filter_all_sessions", "SELECT id, session_id FROM e")
def _filter_all_sessions(e):
    return fl.in_scope(e, fl.ALL_SESSIONS).select("id", "session_id")


@_entries("filter_event_code", "SELECT * FROM e WHERE event_code = 42")
def _filter_event_code(e):
    return fl.LogFilter(event_code=42).apply(e)


@_entries("filter_source", "SELECT * FROM e WHERE source = 'svc-7'")
def _filter_source(e):
    return fl.LogFilter(source="svc-7").apply(e)


@_entries(
    "filter_not_null",
    "SELECT id FROM e WHERE session_id IS NOT NULL AND source IS NOT NULL "
    "AND event_code IS NOT NULL AND ts IS NOT NULL",
)
def _filter_not_null(e):
    guarded = [F.col(c).isNotNull() for c in ("session_id", "source", "event_code", "ts")]
    return fl.keep(e, guarded).select("id")


@_entries("filter_source_given", "SELECT id, source FROM e WHERE source IS NOT NULL AND source <> ''")
def _filter_source_given(e):
    return e.where(fl.source_given()).select("id", "source")


@_entries("search_message", "SELECT * FROM e WHERE message ILIKE '%BY user 1%'")
def _search_message(e):
    return fl.LogFilter(search="BY user 1").apply(e)


@_entries("search_wildcards", "SELECT * FROM e WHERE message ILIKE '%VIEW%user _2 {\"K\": 1%'")
def _search_wildcards(e):
    return fl.LogFilter(search='VIEW%user _2 {"K": 1').apply(e)


@_entries(
    "filter_combined",
    f"SELECT * FROM e WHERE level = 'Information' AND ts >= {_stamp(START)} AND ts <= {_stamp(END)} "
    "AND message ILIKE '%user%' AND event_code = 42",
)
def _filter_combined(e):
    return fl.LogFilter("Information", START, END, search="USER", event_code=42).apply(e)


# --- order and paging -------------------------------------------------------

NEWEST = "ORDER BY ts DESC NULLS LAST, id DESC"


@_entries("page_newest", f"SELECT {FIVE} FROM e WHERE level = 'Error' {NEWEST} LIMIT 50 OFFSET 50")
def _page_newest(e):
    return paging.get_logs(e, page=2, filters=fl.LogFilter(level="Error"))[0]


@_entries("page_total", "SELECT count(*) AS total FROM e WHERE level = 'Error'")
def _page_total(e):
    return paging.count_logs(e, fl.LogFilter(level="Error"))


@_entries(
    "page_count",
    "SELECT source, CAST(greatest(1, ceil(count(*) / 50.0)) AS BIGINT) AS pages FROM e GROUP BY source",
)
def _page_count(e):
    counted = e.groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    return counted.select("source", paging.page_count(F.col("total")).alias("pages"))


@_entries("page_deep", f"SELECT * FROM e {NEWEST} LIMIT 50 OFFSET 800")
def _page_deep(e):
    return paging.page_rows(e, page=17, size=50, top_rows=60)


@_entries("page_deep_default", f"SELECT * FROM e {NEWEST} LIMIT 50 OFFSET 900")
def _page_deep_default(e):
    return paging.page_rows(e, page=19, size=50)


@_entries(
    "page_after",
    "SELECT * FROM e WHERE ts < TIMESTAMP '2024-01-15 12:00:00' "
    "OR (ts = TIMESTAMP '2024-01-15 12:00:00' AND id < 5000) OR ts IS NULL "
    f"{NEWEST} LIMIT 50",
)
def _page_after(e):
    return paging.page_after(e, {"ts": datetime(2024, 1, 15, 12), "id": 5000})


@_entries(
    "page_sort_by_source",
    f"SELECT * FROM (SELECT {FIVE} FROM e {NEWEST} LIMIT 100) ORDER BY source",
)
def _page_sort_by_source(e):
    return paging.sort_page(paging.get_logs(e, size=100)[0], "source")


# --- aggregates -------------------------------------------------------------

BY_LEVEL = "SELECT coalesce(level, 'Unknown') AS level, count(*) AS count FROM e GROUP BY 1"


@_entries("level_counts", BY_LEVEL)
def _level_counts(e):
    return agg.level_counts(e)


@_entries(
    "level_counts_session",
    "SELECT coalesce(level, 'Unknown') AS level, count(*) AS count FROM e "
    f"WHERE session_id = '{SESSION}' GROUP BY 1",
)
def _level_counts_session(e):
    return agg.level_counts(fl.keep(e, fl.unless_empty(SESSION)))


COUNTERS_SQL = (
    "SELECT count(*) AS total, count(*) FILTER (level = 'Error') AS error, "
    "count(*) FILTER (level = 'Warning') AS warning, "
    "count(*) FILTER (level = 'Information') AS information, "
    "count(*) FILTER (level = 'AuditSuccess') AS audit_success, "
    "count(*) FILTER (level = 'AuditFailure') AS audit_failure, "
    "count(*) FILTER (coalesce(level, 'Unknown') IN ('Other', 'Unknown')) AS other FROM e"
)


@_entries("level_counters", COUNTERS_SQL)
def _level_counters(e):
    return agg.level_counters(e)


PIE_SQL = (
    "SELECT CASE level WHEN 'AuditSuccess' THEN 'Audit Success' WHEN 'AuditFailure' "
    "THEN 'Audit Failure' ELSE coalesce(level, 'Other') END AS name, count(*) AS count FROM e "
    "WHERE coalesce(level, 'Other') IN "
    "('Error', 'Warning', 'Information', 'AuditSuccess', 'AuditFailure', 'Other') GROUP BY 1"
)


@_entries("pie_slices", PIE_SQL)
def _pie_slices(e):
    return agg.pie_slices(e)


@_entries("level_count_ci", "SELECT count(*) AS total FROM e WHERE upper(level) = 'WARNING'")
def _level_count_ci(e):
    return agg.level_count(e, "warning")


TOP_NAMED = (
    "SELECT source, count(*) AS count FROM e WHERE source <> '' GROUP BY 1 "
    "ORDER BY count(*) DESC, source LIMIT 15"
)
TOP_SOURCES = (
    "SELECT source, count(*) AS count FROM e WHERE source IS NOT NULL GROUP BY 1 "
    "ORDER BY count(*) DESC, source LIMIT 10"
)
TOP_CODES = (
    "SELECT event_code, count(*) AS count FROM e WHERE event_code IS NOT NULL GROUP BY 1 "
    "ORDER BY count(*) DESC, event_code LIMIT 10"
)


@_entries("top_sources_nonempty15", TOP_NAMED)
def _top_sources_nonempty15(e):
    return agg.top_named_sources(e)


@_entries("top_sources10", TOP_SOURCES)
def _top_sources10(e):
    return agg.top_sources(e)


@_entries("top_event_codes10", TOP_CODES)
def _top_event_codes10(e):
    return agg.top_event_codes(e)


def _per(unit: str) -> str:
    return (
        f"SELECT CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS time, count(*) AS count FROM e "
        "WHERE ts IS NOT NULL GROUP BY 1"
    )


@_entries("hourly_counts", _per("hour"))
def _hourly_counts(e):
    return agg.hourly_counts(e)


@_entries("daily_counts", _per("day"))
def _daily_counts(e):
    return agg.daily_counts(e)


def _series_sql(bucket: str, label: str, where: str = "TRUE") -> str:
    return (
        f"SELECT time, count(*) AS count, strftime(time, '{label}') AS label "
        f"FROM (SELECT CAST({bucket} AS TIMESTAMP) AS time FROM e WHERE ts IS NOT NULL AND {where}) "
        "GROUP BY time"
    )


def _minutes_sql(step: int) -> str:
    return (
        "make_timestamp(year(ts), month(ts), day(ts), hour(ts), "
        f"minute(ts) // {step} * {step}, 0.0)"
    )


SERIES = {
    "series_hour": (HOUR, "date_trunc('hour', ts)", "%H:%M"),
    "series_day": (DAY, "date_trunc('day', ts)", "%d %b"),
    "series_15min": (timedelta(minutes=15), _minutes_sql(15), "%H:%M"),
    "series_7min": (timedelta(minutes=7), _minutes_sql(7), "%H:%M"),
    "series_90s": (timedelta(seconds=90), _minutes_sql(1), "%H:%M"),
    "series_6h_compat": (timedelta(hours=6), "date_trunc('hour', ts)", "%H:%M"),
    "series_7d_compat": (timedelta(days=7), "date_trunc('day', ts)", "%d %b"),
}


def _register_series(name: str, width: timedelta, bucket: str, label: str) -> None:
    @_entries(name, _series_sql(bucket, label))
    def _series(e):
        return time_series(e, width)


for _name, _row in SERIES.items():
    _register_series(_name, *_row)


@_entries(
    "series_6h_aligned", _series_sql("time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')", "%H:%M")
)
def _series_6h_aligned(e):
    return time_series(e, timedelta(hours=6), aligned=True)


@_entries(
    "series_session",
    _series_sql(
        "date_trunc('hour', ts)",
        "%H:%M",
        f"session_id = '{SESSION}' AND ts >= {_stamp(START)} AND ts <= {_stamp(END)}",
    ),
)
def _series_session(e):
    return time_series(fl.in_scope(e, SESSION, START, END))


@_entries("sessions", "SELECT DISTINCT session_id FROM e WHERE session_id IS NOT NULL")
def _sessions(e):
    return agg.sessions(e)


@_entries("distinct_sources", "SELECT DISTINCT source FROM e WHERE source IS NOT NULL")
def _distinct_sources(e):
    return agg.distinct_sources(e)


@_entries(
    "distinct_event_codes100",
    "SELECT DISTINCT event_code FROM e WHERE event_code IS NOT NULL ORDER BY event_code LIMIT 100",
)
def _distinct_event_codes100(e):
    return agg.distinct_event_codes(e)


@_entries(
    "source_options",
    "SELECT '' AS source UNION ALL SELECT source FROM "
    "(SELECT DISTINCT source FROM e WHERE source IS NOT NULL)",
)
def _source_options(e):
    return source_options(e)


@_entries(
    "history_summary",
    "SELECT (SELECT count(DISTINCT session_id) FROM e) AS sessions, "
    "string_agg(level || ': ' || count, ', ' ORDER BY level || ': ' || count) AS statistics, "
    f"CAST(sum(count) AS BIGINT) AS total FROM ({BY_LEVEL})",
)
def _history_summary(e):
    return agg.history_summary(e)


@_entries("has_records", "SELECT count(*) > 0 AS has_records FROM e")
def _has_records(e):
    return agg.has_records(e)


@_entries("max_timestamp", "SELECT max(ts) AS ts FROM e")
def _max_timestamp(e):
    return agg.max_timestamp(e)


@_entries(
    "running_session_count",
    "SELECT session_id, count(*) AS count FROM "
    f"(SELECT DISTINCT session_id, {FIVE} FROM (SELECT * FROM e UNION ALL SELECT * FROM e WHERE id % 4 = 0)) "
    "WHERE upper(level) = 'ERROR' GROUP BY 1",
)
def _running_session_count(e):
    copies = e.unionAll(e.where("id % 4 = 0"))
    return agg.session_level_counts(distinct_entries(copies, ("session_id",)), "error")


# --- de-duplication -----------------------------------------------------------

TWICE = "(SELECT * FROM e UNION ALL SELECT * FROM e WHERE id % 4 = 0)"


@_entries("dedupe_entries", f"SELECT DISTINCT {FIVE} FROM {TWICE}")
def _dedupe_entries(e):
    return distinct_entries(e.unionAll(e.where("id % 4 = 0")))


@_entries("dedupe_first_seen", f"SELECT {FIVE}, min(id) AS id FROM {TWICE} GROUP BY {FIVE}")
def _dedupe_first_seen(e):
    return first_entries(e.unionAll(e.where("id % 4 = 0")))


def _measured_sql(text: str) -> str:
    return f"coalesce(length({text}) || ':' || {text}, '-')"


@_entries(
    "row_fingerprint",
    "SELECT id, sha256("
    + " || '|' || ".join(
        map(
            _measured_sql,
            ["CAST(CAST(epoch_us(ts) AS DECIMAL(18, 0)) * 0.000001 AS STRING)", "level", "message", "CAST(event_code AS STRING)", "source"],
        )
    )
    + ") AS fingerprint FROM e",
)
def _row_fingerprint(e):
    return e.select("id", entry_fingerprint().alias("fingerprint"))


# --- rendering and export -----------------------------------------------------

LINE_SQL = (
    "coalesce(strftime(ts, '%d.%m.%Y %H:%M:%S'), 'N/A') || ' ' || coalesce(level, 'N/A') || ' ' || "
    "coalesce('[' || event_code || ']', '') || ' ' || "
    "CASE WHEN source <> '' THEN '(' || source || ')' ELSE '' END || ' ' || coalesce(message, '')"
)


def _json_text_sql(column: str) -> str:
    return f"""coalesce('"' || replace(replace({column}, '\\', '\\\\'), '"', '\\"') || '"', 'null')"""


JSON_TIME_SQL = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0'"
_MEMBERS = [
    ("Timestamp", f"""coalesce('"' || {JSON_TIME_SQL} || '"', 'null')"""),
    ("Level", _json_text_sql("level")),
    ("Message", _json_text_sql("message")),
    ("EventId", "coalesce(CAST(event_code AS STRING), 'null')"),
    ("Source", _json_text_sql("source")),
]
NDJSON_SQL = (
    "'{' || " + " || ',' || ".join(f"""'"{k}":' || {v}""" for k, v in _MEMBERS) + " || '}'"
)
CRLF = "chr(13) || chr(10)"
INDENTED_SQL = (
    f"'{{' || {CRLF} || "
    + f" || ',' || {CRLF} || ".join(f"""'  "{k}": ' || {v}""" for k, v in _MEMBERS)
    + f" || {CRLF} || '}}'"
)
LEGACY_SQL = (
    "coalesce(strftime(ts, '%d.%m.%Y %H:%M:%S'), 'N/A') || ' ' || coalesce(level, 'N/A') || '   ' || "
    + INDENTED_SQL
)


@_entries("render_lines", f"SELECT id, {LINE_SQL} AS line FROM e")
def _render_lines(e):
    return e.select("id", pr.entry_line().alias("line"))


@_entries("render_json", f"SELECT id, {NDJSON_SQL} AS line FROM e")
def _render_json(e):
    return e.select("id", pr.entry_line("json").alias("line"))


@_entries("render_json_legacy", f"SELECT id, {LEGACY_SQL} AS line FROM e")
def _render_json_legacy(e):
    return e.select("id", pr.entry_line("json", legacy_json=True).alias("line"))


@_entries("json_time", f"SELECT id, {JSON_TIME_SQL} AS text, ts AS parsed FROM e")
def _json_time(e):
    text = json_time(F.col("ts"))
    return e.select("id", text.alias("text"), parse_json_time(text).alias("parsed"))


@_entries(
    "json_time_read",
    """SELECT id, CASE k WHEN 0 THEN x || '+05:30' WHEN 1 THEN x || 'Z' WHEN 2 THEN strftime(ts, '%Y-%m-%d')
                      WHEN 3 THEN strftime(ts, '%m/%d/%Y %H:%M:%S') WHEN 4 THEN strftime(ts, '%Y') ELSE x || '?' END AS text,
           CASE k WHEN 0 THEN ts - INTERVAL '330' MINUTE WHEN 1 THEN ts WHEN 2 THEN date_trunc('day', ts)
                  WHEN 3 THEN date_trunc('second', ts) END AS parsed
    FROM (SELECT id, ts, id % 6 AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS x FROM e)""",
)
def _json_time_read(e):
    whole = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = (
        F.when(F.col("id") % 6 == 0, F.concat(whole, F.lit("+05:30")))
        .when(F.col("id") % 6 == 1, F.concat(whole, F.lit("Z")))
        .when(F.col("id") % 6 == 2, F.date_format("ts", "yyyy-MM-dd"))
        .when(F.col("id") % 6 == 3, F.date_format("ts", "MM/dd/yyyy HH:mm:ss"))
        .when(F.col("id") % 6 == 4, F.date_format("ts", "yyyy"))
        .otherwise(F.concat(whole, F.lit("?")))
    )
    return e.select("id", text.alias("text"), parse_json_time(text).alias("parsed"))


@_entries(
    "chart_labels",
    "SELECT id, CASE WHEN length(message) > 20 THEN message[1:17] || '...' ELSE message END "
    "AS message_label, 'ID: ' || event_code AS code_label FROM e",
)
def _chart_labels(e):
    return e.select(
        "id",
        short_label(F.col("message")).alias("message_label"),
        code_label(F.col("event_code")).alias("code_label"),
    )


@_raw(
    "session_names",
    "SELECT DISTINCT 'Session_' || strftime(time_generated, '%Y%m%d') || '_000000_' || logfile "
    "AS session_id FROM r",
)
def _session_names(r):
    started = day_start(F.col("time_generated"))
    return r.select(session_name(started, F.col("logfile")).alias("session_id")).distinct()


@_entries(
    "safe_file_names",
    "SELECT id, regexp_replace(session_id || '/' || message, '[<>:\"/\\\\|?*]', '_', 'g') AS name FROM e",
)
def _safe_file_names(e):
    name = F.concat("session_id", F.lit("/"), "message")
    return e.select("id", safe_file_name(name).alias("name"))


SESSION_LINES = f"SELECT {LINE_SQL} AS line FROM e WHERE session_id = '{SESSION}'"


@_entries("session_export_lines", SESSION_LINES)
def _session_export_lines(e):
    return pr.entry_lines(export.session_rows(e, SESSION))


@_entries("session_export_file", SESSION_LINES)
def _session_export_file(e):
    base = new_dir(e.sparkSession, "export")
    path = export.export_session(e, SESSION, base)
    return e.sparkSession.read.text(path).withColumnRenamed("value", "line")


@_entries("view_export_file", f"SELECT {LINE_SQL} AS line FROM e WHERE level = 'Error'")
def _view_export_file(e):
    path = export.save_view(e.where(fl.level_is("Error")), new_dir(e.sparkSession, "export"))
    return e.sparkSession.read.text(path).withColumnRenamed("value", "line")


@_entries("json_export_file", f"SELECT {FIVE} FROM e")
def _json_export_file(e):
    path = export.write_lines(e, new_dir(e.sparkSession, "export"), "json")
    schema = "Timestamp string, Level string, Message string, EventId int, Source string"
    back = e.sparkSession.read.schema(schema).json(path)
    return back.select(
        parse_json_time(F.col("Timestamp")).alias("ts"),
        F.col("Level").alias("level"),
        F.col("Message").alias("message"),
        F.col("EventId").alias("event_code"),
        F.col("Source").alias("source"),
    )


# --- store --------------------------------------------------------------------


def _stored(e: DataFrame) -> EntryStore:
    store = EntryStore(e.sparkSession, new_dir(e.sparkSession, "store"))
    store.create()
    store.append(e, F.col("session_id"), F.col("created_at"), many_days=True)
    return store


STORED = f"{FIVE}, created_at, session_id"


@_entries("store_scan", f"SELECT {STORED} FROM e WHERE ts >= {_stamp(START)} AND source = 'svc-7'")
def _store_scan(e):
    rows = _stored(e).read()
    found = fl.LogFilter(start=START, source="svc-7").apply(rows)
    return found.select(*ENTRY_COLUMNS, "created_at", "session_id")


@_entries("retention_survivors", f"SELECT * FROM e WHERE created_at >= {_stamp(CUTOFF)}")
def _retention_survivors(e):
    return survivors(e, CUTOFF)


@_entries("retention_deleted_count", f"SELECT count(*) AS deleted FROM e WHERE created_at < {_stamp(CUTOFF)}")
def _retention_deleted_count(e):
    return deleted_count(e, CUTOFF)


@_entries("store_retention", f"SELECT {STORED} FROM e WHERE created_at >= {_stamp(CUTOFF)}")
def _store_retention(e):
    store = _stored(e)
    store.delete_older_than(CUTOFF)
    return store.read().select(*ENTRY_COLUMNS, "created_at", "session_id")


@_entries("store_named_table", f"SELECT {STORED} FROM e WHERE created_at >= {_stamp(CUTOFF)}")
def _store_named_table(e):
    store = EntryStore(e.sparkSession, new_dir(e.sparkSession, "store"))
    name = store.path.rsplit("/", 1)[-1].replace("-", "_")
    store.create_table(name)
    store.append(e, F.col("session_id"), F.col("created_at"), many_days=True)
    store.delete_older_than(CUTOFF)
    return e.sparkSession.table(name).select(*ENTRY_COLUMNS, "created_at", "session_id")


@_entries("store_compacted", f"SELECT {STORED}, CAST(4 AS BIGINT) AS loads, CAST(1 AS BIGINT) AS parts_a_day FROM e")
def _store_compacted(e):
    """Four loads over all days, merged to one part a day: rows, loads and ids stay."""
    store = EntryStore(e.sparkSession, new_dir(e.sparkSession, "store"))
    for i in range(4):
        store.append(e.where(F.pmod(F.xxhash64("id"), F.lit(4)) == i), F.col("session_id"), F.col("created_at"), many_days=True)
    names = store.read().select("load_id", "id").distinct().count()
    store.compact(before=datetime(2100, 1, 1).date())
    parts = [p.day for p in store.manifest.at().parts.values()]
    rows = store.read()
    named = rows.select("load_id", "id").distinct().count()
    loads = rows.select("load_id").distinct().count() if named == names else -1
    return rows.select(
        *ENTRY_COLUMNS, "created_at", "session_id",
        F.lit(loads).cast("bigint").alias("loads"), F.lit(len(parts) // max(1, len(set(parts)))).cast("bigint").alias("parts_a_day"),
    )


@_entries(
    "store_versions",
    f"SELECT 'after append' AS seen, count(*) AS n FROM e UNION ALL SELECT 'after retention', count(*) FROM e WHERE created_at >= {_stamp(CUTOFF)} "
    f"UNION ALL SELECT 'after merging', count(*) FROM e WHERE created_at >= {_stamp(CUTOFF)} UNION ALL SELECT 'after clearing', CAST(0 AS BIGINT)",
)
def _store_versions(e):
    """What readers of each version of a store see, all of it read after the last change."""
    store = EntryStore(e.sparkSession, new_dir(e.sparkSession, "store"))
    store.append(e.where("id % 2 = 0"), F.col("session_id"), F.col("created_at"), many_days=True)
    store.append(e.where("id % 2 = 1"), F.col("session_id"), F.col("created_at"), many_days=True)
    versions = {"after append": store.version()}
    store.delete_older_than(CUTOFF)
    versions["after retention"] = store.version()
    store.compact(before=datetime(2100, 1, 1).date())
    versions["after merging"] = store.version()
    store.clear()
    versions["after clearing"] = store.version()
    return reduce(DataFrame.unionByName, (store.read(v).agg(F.lit(name).alias("seen"), F.count(F.lit(1)).alias("n")) for name, v in versions.items()))


@_entries("store_clear", "SELECT count(*) AS deleted, CAST(0 AS BIGINT) AS kept FROM e")
def _store_clear(e):
    store = _stored(e)
    deleted = store.clear()
    return store.read().agg(
        F.lit(deleted).cast("bigint").alias("deleted"), F.count(F.lit(1)).alias("kept")
    )


# A text that few messages hold, and one with wildcards in it.
RARE, WILD = 'user 17 {"k": 1', "VIEW%user _2"


@_entries(
    "store_search",
    f"SELECT 'rare' AS kind, {STORED} FROM e WHERE message ILIKE '%{RARE}%' "
    f"UNION ALL SELECT 'wild' AS kind, {STORED} FROM e WHERE message ILIKE '%{WILD}%'",
)
def _store_search(e):
    """Two searches of a store through its skip index, after its parts have been merged."""
    store = EntryStore(e.sparkSession, new_dir(e.sparkSession, "store"), grams=True)
    for i in range(2):
        store.append(e.where(F.col("id") % 2 == i), F.col("session_id"), F.col("created_at"), many_days=True)
    store.compact(before=datetime(2100, 1, 1).date())
    found = [
        fl.LogFilter(search=text).apply(store.read(search=text)).select(F.lit(kind).alias("kind"), *ENTRY_COLUMNS, "created_at", "session_id")
        for kind, text in (("rare", RARE), ("wild", WILD))
    ]
    return found[0].unionByName(found[1])


# --- report and dashboard -------------------------------------------------------


def _part(name: str, key: str, sql: str) -> str:
    return f"SELECT '{name}' AS part, {key} AS key, count FROM ({sql})"


_TIME_KEY = "strftime(time, '%Y-%m-%d %H:%M:%S')"
_COUNTERS_ROWS = (
    "SELECT 'counters' AS part, key, count FROM "
    f"(UNPIVOT ({COUNTERS_SQL}) ON COLUMNS(*) INTO NAME key VALUE count)"
)
REPORT_SQL = [
    _COUNTERS_ROWS,
    _part("by_level", "level", BY_LEVEL),
    _part("by_source", "source", TOP_NAMED),
    _part("by_hour", _TIME_KEY, _per("hour")),
    _part("by_day", _TIME_KEY, _per("day")),
    _part("event_codes", "CAST(event_code AS STRING)", TOP_CODES),
]
DASHBOARD_SQL = REPORT_SQL + [
    _part("pie", "name", PIE_SQL),
    _part("timeline", _TIME_KEY, _per("hour")),
    _part("top_sources", "source", TOP_SOURCES),
    _part("top_event_codes", "CAST(event_code AS STRING)", TOP_CODES),
]


@_entries("detailed_report", " UNION ALL ".join(REPORT_SQL))
def _detailed_report(e):
    return charts.as_rows(charts.detailed_report(e))


@_entries("dashboard_bundle", " UNION ALL ".join(DASHBOARD_SQL))
def _dashboard_bundle(e):
    return charts.as_rows(charts.dashboard(e))


@_entries(
    "dashboard_from_rollups",
    f"SELECT * FROM (WITH kept AS (SELECT * FROM e WHERE created_at >= {_stamp(CUTOFF)}) "
    + " UNION ALL ".join(DASHBOARD_SQL).replace("FROM e", "FROM kept")
    + ")",
)
def _dashboard_from_rollups(e):
    """The dashboard of a store after two loads and a retention, from its partial counts."""
    store = EntryStore(e.sparkSession, new_dir(e.sparkSession, "store"), rollups=True)
    for i in range(2):
        store.append(e.where(F.col("id") % 2 == i), F.col("session_id"), F.col("created_at"), many_days=True)
    store.delete_older_than(CUTOFF)
    return charts.as_rows(dashboard_from_rollups(store.read_rollups()))


@_entries(
    "page_by_counts",
    "SELECT p.*, total FROM (SELECT ts, level, message, event_code, source FROM e WHERE level = 'Error' "
    "ORDER BY ts DESC NULLS LAST, id DESC LIMIT 50 OFFSET 50) p, (SELECT count(*) AS total FROM e WHERE level = 'Error')",
)
def _page_by_counts(e):
    """A page of a store and the total, found by its partial counts."""
    store = EntryStore(e.sparkSession, new_dir(e.sparkSession, "store"), rollups=True)
    store.append(e, F.col("session_id"), F.col("created_at"), many_days=True)
    rows, total = History(store).get_logs(2, 50, fl.LogFilter(level="Error"))
    return rows.select(*ENTRY_COLUMNS, F.lit(total.first().total).cast("bigint").alias("total"))


# --- streaming --------------------------------------------------------------------


def _monitor_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A monitor over two overlapping files, read in two batches."""
    inbox = new_dir(spark, "inbox")
    raw = raw_of(events(spark, sf_dir))
    for part in (raw.where("record_id % 3 < 2"), raw.where("record_id % 3 > 0")):
        part.write.mode("append").parquet(inbox)
    store = EntryStore(spark, new_dir(spark, "monitored"))
    watched = Monitor(
        records.stream_records(spark, inbox, maxFilesPerTrigger="1"),
        store,
        channel="System",
        level="error",
        span="Last 7 days",
        now=NOW,
        checkpoint_root=new_dir(spark, "checkpoint"),
    )
    watched.run(once=True)
    watched.close()
    return store.read().select(*ENTRY_COLUMNS)


QUERIES["monitor_stream"] = _monitor_stream
ORACLES["monitor_stream"] = (
    f"WITH r AS ({RAW_SQL}) SELECT DISTINCT {FIVE} FROM ({NEW_ENTRY_SQL} WHERE logfile = 'System') "
    f"WHERE ts >= {_stamp(NOW - timedelta(days=7))} AND upper(level) = 'ERROR'"
)


_CLOCKS = [NOW - timedelta(days=12), NOW - timedelta(days=6), NOW]
_CLOCK_SPAN = timedelta(days=3)


def _stream_new_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New entries of overlapping files while the clock moves on by spans; for the first
    clocks most entries are dated ahead."""
    inbox, path, checkpoint = new_dir(spark, "inbox"), new_dir(spark, "fresh"), new_dir(spark, "checkpoint")

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    for i, now in enumerate(_CLOCKS):
        events(spark, sf_dir).where(F.col("event_id") % 3 != i).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(EVENTS_SCHEMA).parquet(inbox)
        entries = entries_of(stream).select(*ENTRY_COLUMNS).where(fl.recent(_CLOCK_SPAN, now))
        query = (
            new_entries(entries, _CLOCK_SPAN, now)
            .writeStream.option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(keep)
            .start()
        )
        query.awaitTermination()
    return spark.read.parquet(path).select(*ENTRY_COLUMNS)


QUERIES["stream_new_entries"] = _stream_new_entries
ORACLES["stream_new_entries"] = f"WITH e AS ({ENTRIES_SQL}) " + " UNION ".join(
    f"SELECT {FIVE} FROM e WHERE id % 3 <> {i} AND ts >= {_stamp(now - _CLOCK_SPAN)}" for i, now in enumerate(_CLOCKS)
)


def _stream_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets as the stream updates them; of each, the last state counts."""
    path = new_dir(spark, "series")

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        live_series(entries_of(event_stream(spark, sf_dir)))
        .writeStream.outputMode("update")
        .option("checkpointLocation", new_dir(spark, "checkpoint"))
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    query.awaitTermination()
    states = spark.read.parquet(path)
    return states.groupBy("time", "label").agg(F.max_by("count", "batch").alias("count"))


def _stream_session_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running count over files read in batches; the last state counts."""
    inbox, path = new_dir(spark, "inbox"), new_dir(spark, "counts")
    for half in (0, 1):
        events(spark, sf_dir).where(F.col("event_id") % 2 == half).write.mode("append").parquet(inbox)

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream = spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(inbox)
    query = (
        live_level_count(entries_of(stream), "error")
        .writeStream.outputMode("update")
        .option("checkpointLocation", new_dir(spark, "checkpoint"))
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    query.awaitTermination()
    states = spark.read.parquet(path)
    return states.groupBy("session_id").agg(F.max_by("count", "batch").alias("count"))


QUERIES["stream_session_count"] = _stream_session_count
ORACLES["stream_session_count"] = (
    f"WITH e AS ({ENTRIES_SQL}) SELECT session_id, count(*) AS count FROM e WHERE upper(level) = 'ERROR' GROUP BY 1"
)

QUERIES["stream_series"] = _stream_series
ORACLES["stream_series"] = ORACLES["series_hour"]
