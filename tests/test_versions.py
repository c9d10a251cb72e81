"""Versions of a store, merging of its parts, and its partial counts."""

import threading
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loglantern.operators import paging
from loglantern.operators.filters import LogFilter
from loglantern.operators.paging import newest_first, page_by_hours
from loglantern.plans import dashboard as charts
from loglantern.plans.adapter import entries_of, events
from loglantern.plans.history import History
from loglantern.sources.manifest import SNAPSHOT_EVERY, Manifest, Part
from loglantern.sources.store import EntryStore

CUTOFF = datetime(2024, 1, 15, 6, 30)
CLOSED = date(2100, 1, 1)


@pytest.fixture
def store(spark, tmp_path):
    made = EntryStore(spark, str(tmp_path / "store"), rollups=True)
    made.create()
    return made


@pytest.fixture(scope="module")
def entries(spark, sf_dir):  # three days of them
    rows = entries_of(events(spark, sf_dir))
    return rows.where((F.col("created_at") >= "2024-01-14") & (F.col("created_at") < "2024-01-17")).coalesce(2).cache()


def fill(store, entries, loads=3):
    for i in range(loads):
        store.append(entries.where(F.col("id") % loads == i), F.col("session_id"), F.col("created_at"), many_days=True)


def seen(frame):
    return sorted(tuple(map(str, r)) for r in frame.select("load_id", "id", "ts", "message", "created_at", "session_id").collect())


def rows_of(parts):
    return sorted(map(tuple, charts.as_rows(parts).collect()), key=str)


def at(text):
    return F.lit(text).cast("timestamp_ntz")


CHANGES = {
    "append": lambda s, e: s.append(e.limit(5), "more"),
    "retention": lambda s, e: s.delete_older_than(CUTOFF),
    "compact": lambda s, e: s.compact(CLOSED),
    "clear": lambda s, e: s.clear(),
}


@pytest.mark.parametrize("change", CHANGES)
def test_earlier_versions_stay_readable(store, entries, change):
    fill(store, entries)
    frame, version, before = store.read(), store.version(), seen(store.read())
    CHANGES[change](store, entries)
    assert store.version() == version + 1
    assert seen(frame) == before and seen(store.read(version)) == before


@pytest.mark.parametrize("step", ["_write", "manifest._create", "_delete"])
@pytest.mark.parametrize("change", CHANGES)
def test_a_change_that_breaks_is_seen_whole_or_not(store, entries, monkeypatch, change, step):
    fill(store, entries, 2)
    store.grace = timedelta(0)
    before = seen(store.read())

    def broken(*args):
        raise OSError("the cluster went away")

    owner, name = (store.manifest, "_create") if "." in step else (store, step)
    raised = False
    with monkeypatch.context() as patched:
        patched.setattr(owner, name, broken)
        try:
            CHANGES[change](store, entries)
        except OSError:
            raised = True
    fresh = EntryStore(store.spark, store.path, rollups=True, grace=timedelta(0))
    if step == "manifest._create" or (step == "_write" and raised):
        assert raised and seen(fresh.read()) == before
    CHANGES[change](fresh, entries)  # again, whole
    after = seen(fresh.read())
    want = {
        "retention": [r for r in before if r[4] >= str(CUTOFF)],
        "compact": before,
        "clear": [],
    }.get(change)
    if want is not None:
        assert after == want
    else:
        assert len(after) in (len(before) + 5, len(before) + 10)
    counted = fresh.read_rollups().where("kind = 'level'").agg(F.sum("entries")).first()[0] or 0
    assert counted == len(after) == fresh.row_count()


def test_many_loads_become_few_files(store, entries):
    rows = entries.limit(80).cache()
    for i in range(20):
        store.append(rows.where(F.col("id") % 20 == i), "s", at(f"2024-03-01 10:00:{i:02d}"), load_id=f"load-{i:03d}", few_files=True)
    before, files = seen(store.read()), len(store.read().inputFiles())
    assert store.compact(before=date(2024, 3, 1)) == 20  # sizes within a factor of each other
    assert seen(store.read()) == before
    store.compact(before=date(2024, 3, 2))
    assert seen(store.read()) == before and len(store.read().inputFiles()) <= 2 < files
    assert len(store.manifest.at().parts) == 1 and store.row_count() == len(before)
    assert store.compact(before=date(2024, 3, 2)) == 0
    # a load that was merged can be repeated, and changes nothing
    assert store.append(rows.where("id % 20 = 7"), "s", at("2024-03-01 10:00:07"), load_id="load-007") >= 0
    assert seen(store.read()) == before


def test_open_days_are_merged_by_size(store, entries):
    rows = entries.limit(2).cache()
    for i in range(9):
        store.append(rows, "s", at("2024-03-01 10:00:00"), few_files=True)
    store.append(entries, "s", at("2024-03-01 10:00:00"))
    assert store.compact(before=date(2024, 3, 1), fan_in=4) == 9
    assert len(store.manifest.at().parts) == 2
    assert store.compact(before=date(2024, 3, 1), fan_in=4) == 0


def test_sweeping_leaves_what_is_live(store, entries, tmp_path):
    fill(store, entries)
    store.compact(CLOSED)
    before = seen(store.read())
    folders = lambda: {str(p.relative_to(tmp_path / "store")) for p in (tmp_path / "store").glob("ingest_date=*/part=*")}
    assert set(store.manifest.at().parts) < folders()
    assert store.vacuum(timedelta(hours=1)) == 0
    assert store.vacuum(timedelta(0)) > 0
    assert folders() == set(store.manifest.at().parts) and seen(store.read()) == before
    assert store.vacuum(timedelta(0)) == 0
    store.delete_older_than(CUTOFF)
    store.vacuum(timedelta(0))
    assert not (tmp_path / "store" / "ingest_date=2024-01-14").exists()
    fill(store, entries, 1)
    assert seen(EntryStore(store.spark, store.path).read()) == seen(store.read())


def test_writers_do_not_lose_each_other(spark, tmp_path):
    """Many writers at once: every change gets a version of its own."""
    root = str(tmp_path / "log")
    failures = []

    def work(k):
        try:
            log = Manifest(spark, root)
            for i in range(9):
                log.commit("add", lambda live: ([Part(f"ingest_date=2024-01-01/part={k}-{i}", 1)], [n for n in live if n.endswith(f"={k}-{i - 1}")]))
        except Exception as error:  # noqa: BLE001
            failures.append(error)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failures
    log = Manifest(spark, root)
    assert log.at().number == 35 > SNAPSHOT_EVERY
    assert set(log.at().parts) == {f"ingest_date=2024-01-01/part={k}-8" for k in range(4)}


def test_compaction_gives_way_to_retention(store, entries, monkeypatch):
    fill(store, entries)
    add = store._add
    other = EntryStore(store.spark, store.path, rollups=True)

    def slow(*args, **kwargs):
        made = add(*args, **kwargs)
        other.delete_older_than(CUTOFF)
        return made

    monkeypatch.setattr(store, "_add", slow)
    assert store.compact(CLOSED) == 0
    assert {r[4] >= str(CUTOFF) for r in seen(store.read())} == {True}


def test_rows_without_a_day(store, entries):
    store.append(entries, "s", F.when(F.col("id") % 2 == 0, F.col("created_at")), many_days=True)
    n = entries.count()
    assert store.read().count() == store.row_count() == n
    store.compact(CLOSED)
    store.delete_older_than(datetime(2030, 1, 1))
    assert store.read().where("created_at IS NOT NULL").count() == 0 < store.read().count() < n


@pytest.mark.parametrize("session", [None, "Session_20240115_000000_System", ""])
def test_rollups_equal_the_scan(store, entries, session):
    for change in (lambda: fill(store, entries), lambda: store.delete_older_than(CUTOFF), lambda: store.compact(CLOSED), store.clear):
        change()
        parts, scan = History(store).dashboard(session), charts.dashboard(store.read(), session)
        assert {n: p.dtypes for n, p in parts.items()} == {n: p.dtypes for n, p in scan.items()}
        assert rows_of(parts) == rows_of(scan)
        assert not any("_rollup" not in f for f in parts["by_source"].inputFiles())


@pytest.mark.parametrize("filters", [LogFilter(), LogFilter(level="Error"), LogFilter(session_id="Session_20240115_000000_System"), LogFilter(level="None")])
def test_pages_by_counts(store, entries, filters, monkeypatch):
    late = entries.limit(30).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    store.append(entries.unionByName(late), F.col("session_id"), F.col("created_at"), many_days=True)
    want = filters.apply(store.read()).orderBy(*newest_first(store.read())).collect()
    history = History(store)
    for page, size in ((1, 20), (3, 20), (2, 1), (1 + len(want) // 20, 20), (len(want) + 1, 7), (1, 500)):
        rows, total = history.get_logs(page, size, filters)
        assert total.first().total == len(want)
        part = want[(page - 1) * size : page * size]
        assert [(r.ts, r.message) for r in rows.collect()] == [(r.ts, r.message) for r in part]
        deep = page_by_hours(filters.apply(store.read()), filters.apply(store.read_rollups().where("kind = 'hour'")), page, size, top_rows=1)
        assert [(r.load_id, r.id) for r in deep.collect()] == [(r.load_id, r.id) for r in part]
    monkeypatch.setattr(paging, "_seek", None)  # no search among the entries
    assert history.get_logs(2, 5, filters)[0].count() == len(want[5:10])
