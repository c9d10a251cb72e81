import time
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from loglantern.operators.dedupe import distinct_entries
from loglantern.operators.filters import level_matches, recent
from loglantern.operators.projections import raw_to_entries
from loglantern.operators.series import time_series
from loglantern.schema import ENTRY_COLUMNS, RAW_SCHEMA
from loglantern.sources.records import channel_records, stream_records
from loglantern.sources.shared import new_dir, shared_dir
from loglantern.sources.store import EntryStore
from loglantern.streaming.live import live_series, monitored_entries, new_entries
from loglantern.streaming.monitor import Monitor, monitor_session_id, plain_name

NOW = datetime(2024, 1, 20, 12)
WEEK = "Last 7 days"


@pytest.fixture
def inbox(spark, tmp_path):
    """A directory of raw records, its stream, and a way to drop files into it."""
    path = str(tmp_path / "inbox")

    def drop(frame):
        frame.coalesce(1).write.mode("append").parquet(path)

    (tmp_path / "inbox").mkdir()
    return drop, stream_records(spark, path)


def run(frame, checkpoint, output="append"):
    """Run a stream to its end; the rows it sent."""
    out = []

    def take(batch, _):
        out.extend(tuple(r) for r in batch.collect())

    query = (
        frame.writeStream.outputMode(output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(take)
        .start()
    )
    query.awaitTermination()
    return out, query


def watched(spark, tmp_path, stream, **options):
    store = EntryStore(spark, str(tmp_path / "store"))
    options = {"channel": "System", "level": "error", "span": WEEK, "now": NOW, **options}
    return Monitor(stream, store, checkpoint_root=str(tmp_path / "checkpoint"), **options)


def expected(raw):
    entries = raw_to_entries(channel_records(raw, "System"))
    kept = entries.where(recent(WEEK, NOW) & level_matches("error"))
    return sorted(map(str, distinct_entries(kept).collect()))


def stored(monitor):
    return sorted(map(str, monitor.store.read().select(*ENTRY_COLUMNS).collect()))


def test_overlapping_files_give_each_entry_once(raw, inbox, tmp_path):
    drop, stream = inbox
    entries = raw_to_entries(stream)
    fresh = new_entries(entries, timedelta(days=60), datetime(2024, 2, 1))
    checkpoint = str(tmp_path / "c")
    drop(raw.where("record_id < 600"))
    first, _ = run(fresh, checkpoint)
    drop(raw.where("record_id >= 400"))
    second, _ = run(fresh, checkpoint)
    assert (len(first), len(second)) == (600, 400)
    assert len(set(first + second)) == 1000


@pytest.mark.parametrize("fold_copies", [True, False])
def test_hot_copies_inside_one_batch(spark, raw, inbox, tmp_path, fold_copies):
    drop, stream = inbox
    copies = raw.where("record_id = 5").crossJoin(spark.range(500)).drop("id")
    drop(raw.where("record_id < 50").unionByName(copies))
    fresh = new_entries(raw_to_entries(stream), timedelta(days=60), datetime(2024, 2, 1), fold_copies)
    rows, _ = run(fresh, str(tmp_path / "c"))
    assert len(rows) == len(set(rows)) == 50


def test_state_is_dropped_with_age(raw, inbox, tmp_path):
    drop, stream = inbox
    span, clock = timedelta(days=2), datetime(2024, 2, 1)
    fresh = new_entries(raw_to_entries(stream), span, clock)
    checkpoint = str(tmp_path / "c")
    drop(raw.where("time_generated < '2024-01-04'"))
    _, query = run(fresh, checkpoint)
    early = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    drop(raw.where("time_generated >= '2024-01-28'"))
    _, query = run(fresh, checkpoint)
    late = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert early == raw.where("time_generated < '2024-01-04'").count()
    assert late == raw.where("time_generated >= '2024-01-28'").count()
    drop(raw.where("time_generated < '2024-01-04'"))
    again, _ = run(fresh, checkpoint)
    assert again == []


@pytest.mark.parametrize("fold_copies", [True, False])
def test_entry_dated_ahead_is_kept_once_until_its_own_time(spark, inbox, tmp_path, fold_copies):
    """The clock moves on by several spans between two copies of an entry dated ahead."""
    drop, stream = inbox
    span = timedelta(days=10)
    ahead = datetime(2024, 6, 1)

    def batch(now, times):
        rows = [(t, "ahead" if t == ahead else f"at {t}") for t in times]
        raw = spark.createDataFrame(rows, "time_generated timestamp_ntz, message string")
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in RAW_SCHEMA if f.name not in raw.columns]
        drop(raw.select("*", *missing).select(*RAW_SCHEMA.names))
        entries = raw_to_entries(stream)
        fresh = new_entries(entries.where(recent(span, now)), span, now, fold_copies)
        out, query = run(fresh.select("message"), str(tmp_path / "checkpoint"))
        state = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
        return sorted(m for (m,) in out), state[-1]

    day = datetime(2024, 2, 1)
    assert batch(day, [day, ahead, ahead]) == (["ahead", f"at {day}"], 2)
    later = datetime(2024, 3, 1)
    sent, kept = batch(later, [later, ahead])
    assert sent == [f"at {later}"] and kept == 2  # the first one's state is gone
    last = datetime(2024, 4, 10)
    sent, kept = batch(last, [last, ahead])
    assert sent == [f"at {last}"] and kept == 2
    over = datetime(2024, 7, 1)
    sent, kept = batch(over, [over, ahead])
    assert sent == [f"at {over}"] and kept == 1  # its own time has come and gone


def test_future_entries_do_not_push_others_out(raw, inbox, tmp_path):
    drop, stream = inbox
    fresh = new_entries(raw_to_entries(stream), timedelta(days=40), datetime(2024, 2, 1))
    checkpoint = str(tmp_path / "c")
    ahead = raw.limit(1).withColumn("time_generated", F.lit("2100-01-01").cast("timestamp_ntz"))
    drop(ahead)
    run(fresh, checkpoint)
    drop(raw.unionByName(ahead))
    rows, _ = run(fresh, checkpoint)
    assert len(rows) == 1000


def test_monitor_stores_what_is_new(spark, raw, inbox, tmp_path):
    drop, stream = inbox
    events = []
    monitor = watched(
        spark, tmp_path, stream,
        on_started=lambda: events.append("started"),
        on_changed=lambda batch, n: events.append(n),
        on_stopped=lambda: events.append("stopped"),
    )
    drop(raw.where("record_id < 600"))
    monitor.run(once=True)
    session = monitor.session_id
    assert session.startswith("Session_") and session.endswith("_System")
    assert stored(monitor) == expected(raw.where("record_id < 600"))

    drop(raw)
    monitor.run(resume=session, once=True)
    assert stored(monitor) == expected(raw)
    assert monitor.session_count() == monitor.running_count == len(expected(raw))
    assert {r[0] for r in monitor.store.read().select("session_id").distinct().collect()} == {session}
    time.sleep(1)
    monitor.close()
    assert events.count("started") == 2 and events.count("stopped") == 2
    assert sum(e for e in events if isinstance(e, int)) == len(expected(raw))


def test_new_session_begins_with_empty_state(spark, raw, inbox, tmp_path):
    drop, stream = inbox
    drop(raw)
    monitor = watched(spark, tmp_path, stream)
    monitor.run(once=True)
    first = monitor.session_id
    while monitor_session_id("System") == first:
        time.sleep(0.1)
    monitor.run(once=True)
    monitor.close()
    counts = {r.session_id: r["count"] for r in monitor.store.read().groupBy("session_id").count().collect()}
    assert counts == {first: len(expected(raw)), monitor.session_id: len(expected(raw))}


def test_repeated_batch_replaces_itself(spark, raw, inbox, tmp_path):
    """A batch whose commit was lost runs again after a restart."""
    drop, stream = inbox
    drop(raw)
    monitor = watched(spark, tmp_path, stream)
    monitor.run(once=True)
    before = monitor.store.read().orderBy("id").collect()
    commits = tmp_path / "checkpoint" / "monitor" / plain_name(monitor.session_id) / "commits"
    newest = max((p for p in commits.iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    newest.write_text("")  # an unfinished commit file counts as none
    newest.unlink()
    for crc in commits.glob(f".{newest.name}.crc"):
        crc.unlink()
    monitor.run(resume=monitor.session_id, once=True)
    monitor.close()
    after = monitor.store.read().orderBy("id").collect()
    strip = lambda rows: sorted(str(r.asDict() | {"id": None}) for r in rows)
    assert strip(after) == strip(before)


def test_lines_are_written_too(spark, raw, inbox, tmp_path):
    drop, stream = inbox
    drop(raw)
    lines = str(tmp_path / "lines")
    monitor = watched(spark, tmp_path, stream, lines_path=lines)
    monitor.run(once=True)
    monitor.close()
    assert spark.read.text(lines).count() == len(expected(raw)) > 0


def test_channel_names_with_slashes(spark, raw, inbox, tmp_path):
    drop, stream = inbox
    drop(raw.withColumn("logfile", F.lit("Vendor-Part/Operational (x)")))
    monitor = watched(spark, tmp_path, stream, channel="Vendor-Part/Operational (x)")
    monitor.run(once=True)
    monitor.close()
    stored_rows = monitor.session_count()
    assert stored_rows > 0
    assert monitor.store.delete_older_than(datetime(2100, 1, 1)) == stored_rows
    assert monitor.session_count() == 0
    assert plain_name("a b") != plain_name("a_b")


def test_start_and_stop(spark, raw, inbox, tmp_path):
    drop, stream = inbox
    drop(raw)
    monitor = watched(spark, tmp_path, stream)
    assert not monitor.is_monitoring
    query = monitor.start(poll="100 milliseconds")
    assert monitor.is_monitoring and monitor.start() is query
    query.processAllAvailable()
    monitor.stop()
    monitor.close()
    assert not monitor.is_monitoring
    assert stored(monitor) == expected(raw)


def test_failed_reads_are_tried_again(spark, raw, inbox, tmp_path, monkeypatch):
    drop, stream = inbox
    drop(raw)
    monitor = watched(spark, tmp_path, stream)
    tries = []
    append = monitor.store.append

    def failing(*args, **kwargs):
        tries.append(kwargs["load_id"])
        if len(tries) < 3:
            raise OSError("java.io.FileNotFoundException: share is gone")
        return append(*args, **kwargs)

    monkeypatch.setattr(monitor.store, "append", failing)
    monitor.run(once=True, retry_delay=0.1)
    assert len(set(tries[:3])) == 1 and stored(monitor) == expected(raw)

    def broken(*args, **kwargs):
        raise ValueError("no")

    monkeypatch.setattr(monitor.store, "append", broken)
    drop(raw.limit(1))
    with pytest.raises(StreamingQueryException):
        monitor.run(resume=monitor.session_id, once=True, retry_delay=0.1)
    monitor.close()


def test_vanished_files_are_not_skipped(spark, raw, inbox, tmp_path, monkeypatch):
    """A file that goes between listing and reading fails the batch; nothing is lost."""
    drop, stream = inbox
    drop(raw)
    monitor = watched(spark, tmp_path, stream)
    append, hidden = monitor.store.append, []

    def failing(*args, **kwargs):
        if hidden:
            return append(*args, **kwargs)
        for file in (tmp_path / "inbox").glob("*.parquet"):
            hidden.append((file, file.rename(tmp_path / file.name)))
        try:
            return append(*args, **kwargs)
        finally:
            for file, away in hidden:
                away.rename(file)

    monkeypatch.setattr(monitor.store, "append", failing)
    monitor.run(once=True, retry_delay=0.1)
    monitor.close()
    assert hidden and stored(monitor) == expected(raw)


def test_recency_follows_the_clock(spark, raw, inbox, tmp_path):
    drop, stream = inbox
    drop(raw)
    old = monitored_entries(stream, "System", "error", WEEK)
    assert run(old, str(tmp_path / "c1"))[0] == []
    drop(raw.withColumn("time_generated", F.localtimestamp() - F.expr("INTERVAL 1 HOUR")))
    rows, _ = run(monitored_entries(stream, "System", "error", WEEK), str(tmp_path / "c2"))
    assert rows


def test_live_series(entries, raw, inbox, tmp_path):
    drop, stream = inbox
    drop(raw.where("record_id >= 500"))
    drop(raw.where("record_id < 500"))
    live = raw_to_entries(stream)
    want = sorted(tuple(r) for r in time_series(raw_to_entries(raw)).collect())
    complete, _ = run(live_series(live), str(tmp_path / "c1"), "complete")
    assert sorted(complete) == want
    final, _ = run(
        live_series(live, timedelta(days=1), lateness=timedelta(days=60)), str(tmp_path / "c2")
    )
    assert final == []
    final, _ = run(
        live_series(live, timedelta(days=1), lateness=timedelta(hours=1)), str(tmp_path / "c3")
    )
    days = {r.time: r["count"] for r in time_series(raw_to_entries(raw), timedelta(days=1)).collect()}
    assert {t: n for t, n, _ in final} == {t: days[t] for t, _, _ in final} and final
    with pytest.raises(ValueError):
        live_series(live, timedelta(minutes=5), lateness=timedelta(hours=1))


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert new_dir(spark, "x") != new_dir(spark, "x")


def test_raw_stream_has_the_given_schema(inbox):
    assert inbox[1].schema == RAW_SCHEMA and inbox[1].isStreaming
