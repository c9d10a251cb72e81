from datetime import datetime, timezone

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from loglantern.operators.paging import newest_first
from loglantern.plans.history import History
from loglantern.schema import STORE_SCHEMA
from loglantern.sources import export, records
from loglantern.sources.store import EntryStore

NEVER = datetime(2000, 1, 1)


def utc():
    return datetime.now(timezone.utc).replace(tzinfo=None)


@pytest.fixture
def store(spark, tmp_path):
    made = EntryStore(spark, str(tmp_path / "store"))
    made.create()
    return made


def test_new_store_is_empty_and_create_keeps_rows(store, entries):
    assert store.read().schema == STORE_SCHEMA and store.read().count() == 0
    store.append(entries, "s")
    store.create()
    assert store.read().count() == entries.count()


def test_append_counts_and_stamps(store, entries):
    before = utc()
    assert store.append(entries, "Session_1") == entries.count()
    row = store.read().agg(
        F.min("created_at"), F.max("created_at"), F.count_distinct("id"), F.min("session_id")
    ).first()
    assert before <= row[0] <= row[1] <= utc()
    assert row[2] == entries.count() and row[3] == "Session_1"


def test_empty_sessions_and_nulls_survive(store, entries):
    store.append(entries.limit(3), "")
    store.append(entries.limit(2), F.lit(None).cast("string"))
    counts = {r.session_id: r["count"] for r in store.read().groupBy("session_id").count().collect()}
    assert counts == {"": 3, None: 2}


def test_repeated_load_is_stored_once(store, entries):
    at = F.lit("2024-03-01 10:00:00").cast("timestamp_ntz")
    for _ in range(2):
        store.append(entries, "s", created_at=at, load_id="load-7")
    assert store.read().count() == entries.count()
    store.append(entries, "s", created_at=at, load_id="load-8")
    assert store.read().count() == 2 * entries.count()
    assert store.read().select("load_id", "id").distinct().count() == 2 * entries.count()


@pytest.mark.parametrize(
    "cutoff",
    [
        NEVER,
        datetime(2024, 1, 10),
        datetime(2024, 1, 15, 6, 30),
        datetime(2024, 1, 15, 23, 59, 59),
        datetime(2030, 1, 1),
    ],
)
def test_retention(store, entries, cutoff):
    store.append(entries, F.col("session_id"), F.col("created_at"), many_days=True)
    store.append(
        entries.where("false").unionByName(entries.limit(20)), "t",
        F.lit("2024-01-15 01:00:00").cast("timestamp_ntz"),
    )
    all_rows = store.read().select("created_at", "message", "id").collect()
    expected = sorted((r.created_at, r.message or "", r.id) for r in all_rows if r.created_at >= cutoff)
    assert store.delete_older_than(cutoff) == len(all_rows) - len(expected)
    left = store.read().select("created_at", "message", "id").collect()
    assert sorted((r.created_at, r.message or "", r.id) for r in left) == expected
    assert store.delete_older_than(cutoff) == 0


@pytest.mark.parametrize("load_id", ["a/b", "a b", "", "ü"])
def test_load_names_are_plain(store, entries, load_id):
    with pytest.raises(ValueError):
        store.append(entries, "s", load_id=load_id)


def test_few_files(store, entries):
    store.append(entries.repartition(40), "s", few_files=True)
    files = store.read().select(F.input_file_name().alias("f")).distinct().count()
    assert files < 5 and store.read().count() == entries.count()


def test_clear(store, entries):
    store.append(entries, "s")
    assert store.clear() == entries.count()
    assert store.read().count() == 0 and store.clear() == 0
    assert store.append(entries.limit(4), "s") == 4


def test_named_table(spark, store, entries):
    for _ in range(2):
        store.create_table("stored_entries")
    try:
        rows = lambda: spark.table("stored_entries").count()
        assert spark.table("stored_entries").columns == STORE_SCHEMA.names and rows() == 0
        store.append(entries, F.col("session_id"), F.col("created_at"), many_days=True)
        assert rows() == entries.count()
        store.append(entries.limit(7), "again")
        assert rows() == entries.count() + 7
        gone = store.delete_older_than(datetime(2024, 1, 15, 6, 30))
        assert 0 < gone and rows() == entries.count() + 7 - gone
        store.clear()
        assert rows() == 0
    finally:
        spark.sql("DROP VIEW stored_entries")
        spark.sql("DROP TABLE stored_entries__parts")


def test_rows_of_a_file_lie_in_time_order(spark, store, entries):
    store.append(entries.repartition(3), "s")
    read = store.read().where("ts IS NOT NULL").select("ts", F.input_file_name().alias("f"), "id")
    by_file = {}
    for row in sorted(read.collect(), key=lambda r: (r.f, r.id)):
        by_file.setdefault(row.f, []).append(row.ts)
    assert all(times == sorted(times) for times in by_file.values())


def test_history_over_a_store(store, entries):
    history = History(store)
    assert not history.has_records()
    history.save_logs(entries, "Session_A")
    history.save_logs(entries.limit(10), "Session_B")
    assert [r[0] for r in history.session_ids().collect()] == ["Session_B", "Session_A"]
    page, total = history.get_logs(page=3, size=25)
    assert page.count() == 25 and total.first().total == entries.count() + 10
    assert history.delete_old_logs(NEVER) == 0
    assert history.clear_all_logs() == entries.count() + 10


# --- export -------------------------------------------------------------------


def test_session_export_is_in_order(spark, entries, tmp_path):
    session = "Session_20240115_000000_System"
    path = export.export_session(entries, session, str(tmp_path))
    assert path == f"{tmp_path}/{session}.txt"
    written = [
        line
        for part in sorted((tmp_path / f"{session}.txt").glob("part-*"))
        for line in part.read_text().splitlines()
    ]
    rows = entries.where(F.col("session_id") == session)
    ordered = rows.orderBy(*newest_first(rows)).select("ts").collect()
    stamps = [r.ts.strftime("%d.%m.%Y %H:%M:%S") if r.ts else "N/A" for r in ordered]
    assert len(written) == len(stamps) > 0
    assert all(line.startswith(stamp) for line, stamp in zip(written, stamps))


def test_export_needs_a_session_with_rows(entries, tmp_path):
    for session in (None, "", "All Sessions"):
        with pytest.raises(ValueError):
            export.export_session(entries, session, str(tmp_path))
    with pytest.raises(ValueError):
        export.export_session(entries, "x", str(tmp_path), "xml")
    assert export.export_session(entries, "no such session", str(tmp_path)) is None
    assert list(tmp_path.iterdir()) == []


def test_saved_view_is_in_order_under_its_dated_path(entries, tmp_path):
    now = datetime(2024, 2, 3, 4, 5, 6)
    view = entries.where(F.col("level") == "Error")
    path = export.save_view(view, str(tmp_path), now=now)
    assert path == f"{tmp_path}/20240203/output_20240203_040506.txt"
    parts = sorted((tmp_path / "20240203/output_20240203_040506.txt").glob("part-*"))
    written = [line for part in parts for line in part.read_text().splitlines()]
    ordered = view.orderBy(*newest_first(view)).select("ts").collect()
    stamps = [r.ts.strftime("%d.%m.%Y %H:%M:%S") if r.ts else "N/A" for r in ordered]
    assert len(written) == len(stamps) > 0
    assert all(line.startswith(stamp) for line, stamp in zip(written, stamps))
    with pytest.raises(AnalysisException):
        export.save_view(view.limit(1), str(tmp_path), now=now)
    assert [p for p in parts if not p.exists()] == []
    with pytest.raises(ValueError):
        export.save_view(view, str(tmp_path), "xml")
    empty = export.save_view(view.where("false"), str(tmp_path / "none"), "json", now=now)
    assert view.sparkSession.read.text(empty).count() == 0


def test_export_paths():
    now = datetime(2024, 2, 3, 4, 5, 6)
    assert export.dated_path("/b", "txt", now) == "/b/20240203/output_20240203_040506.txt"
    with pytest.raises(ValueError):
        export.dated_path("/b", " ")
    assert export.session_path("/b", 'a/b:"c"', "json") == "/b/a_b__c_.json"


# --- raw records -----------------------------------------------------------------


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_formats_of_raw_records(spark, raw, tmp_path, fmt):
    path = str(tmp_path / "raw")
    # By default the writers cut times to milliseconds and trim CSV fields.
    exact = {
        "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
    }
    raw.write.format(fmt).options(**({} if fmt == "parquet" else exact)).save(path)
    back = records.read_records(spark, path, fmt)
    # CSV has one form for empty and missing fields; both are blank to the level rules.
    want = raw.withColumn("type", F.nullif("type", F.lit(""))) if fmt == "csv" else raw
    assert sorted(back.collect(), key=str) == sorted(want.collect(), key=str)


def test_provider_text_records(spark, raw, tmp_path):
    from loglantern.operators.projections import raw_to_entries
    from loglantern.schema import RAW_TEXT_SCHEMA

    text = raw.withColumns(
        {
            "time_generated": F.concat(
                F.date_format("time_generated", "yyyyMMddHHmmss.SSSSSS"), F.lit("+000")
            ),
            "event_type": F.col("event_type").cast("string"),
        }
    )
    path = str(tmp_path / "raw")
    text.write.json(path)
    back = records.read_records(spark, path, "json", RAW_TEXT_SCHEMA)
    assert sorted(raw_to_entries(back).collect(), key=str) == sorted(
        raw_to_entries(raw).collect(), key=str
    )


def test_channels_and_levels_have_defaults(raw):
    nothing = raw.where("false")
    assert [r[0] for r in records.channels(raw).collect()] == ["Application", "Security", "System"]
    assert [r[0] for r in records.channels(nothing).collect()] == ["Application", "Security", "System"]
    for channel, levels in [
        ("security", ["AuditFailure", "AuditSuccess"]),
        ("X", ["Error", "Warning", "Information"]),
    ]:
        assert [r[0] for r in records.levels_available(nothing, channel).collect()] == levels
    every = {r[0] for r in records.levels_available(raw, "System").collect()}
    sampled = records.levels_available(raw, "System", records.LEVEL_SAMPLE_ROWS)
    assert {r[0] for r in sampled.collect()} <= every
    with pytest.raises(ValueError):
        records.channel_scan(raw, " ")


def test_mark_moves_forward_only(raw):
    assert records.advance_mark(raw.where("false"), None) is None
    latest = records.advance_mark(raw, None)
    assert latest == raw.agg(F.max("time_generated")).first()[0]
    future = datetime(2100, 1, 1)
    assert records.advance_mark(raw, future) == future
    assert records.after_mark(raw, None) is raw
    again = records.after_mark(raw, latest).collect()
    assert all(r.time_generated > latest.replace(microsecond=0) for r in again) and again
