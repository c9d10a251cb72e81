import sqlite3
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loglantern.operators import filters as fl
from loglantern.operators.filters import LogFilter


def ids(frame):
    return sorted(r.id for r in frame.select("id").collect())


TEXTS = [
    "Disk FULL", "disk full", "disk_full", "50% done", "50 done", "a\\b", "Ä", "ä", "line\nbreak",
    "Kelvin", "kelvin", "a.c", "abc", "", None, "x(1)[2]", "%", "_",
]


@pytest.mark.parametrize(
    "search",
    ["disk full", "DISK", "k_f", "0%d", "%", "_", "a\\b", "\\", "ä", "Ä", "e\nb", "e_b", "Kelvin",
     "a.c", "a_c", "(1)[", "%full%", "full%%", "K"],
)
def test_search_is_like(spark, search):
    rows = list(enumerate(TEXTS))
    frame = spark.createDataFrame(rows, "id int, message string")
    # SQLite's LIKE folds ASCII letters only and knows no escape of its own.
    with sqlite3.connect(":memory:") as db:
        db.execute("CREATE TABLE t (id INT, message TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", rows)
        found = db.execute("SELECT id FROM t WHERE message LIKE ? ORDER BY id", [f"%{search}%"])
        expected = [r[0] for r in found]
    assert ids(frame.where(fl.message_contains(search))) == expected
    assert ids(LogFilter(search=search).apply(frame)) == expected


def test_level_case(spark):
    frame = spark.createDataFrame([(1, "Error"), (2, "ERROR"), (3, None)], "id int, level string")
    assert ids(LogFilter(level="Error").apply(frame)) == [1]
    assert ids(frame.where(fl.level_matches("error"))) == [1, 2]
    for blank in ("", " ", None):
        with pytest.raises(ValueError):
            fl.level_matches(blank)


def test_session_argument_rules(spark):
    frame = spark.createDataFrame(
        [(1, "s"), (2, " "), (3, ""), (4, None)], "id int, session_id string"
    )
    everything = [1, 2, 3, 4]
    for argument, history, dashboard in [
        (None, everything, everything),
        ("", everything, everything),
        (fl.ALL_SESSIONS, everything, everything),
        (" ", everything, [2]),
        ("s", [1], [1]),
    ]:
        assert ids(fl.keep(frame, fl.unless_blank(argument))) == history
        assert ids(fl.keep(frame, fl.unless_empty(argument))) == dashboard


def test_time_bounds_are_inclusive(spark):
    rows = [(i, datetime(2024, 1, 1, i)) for i in range(5)] + [(9, None)]
    frame = spark.createDataFrame(rows, "id int, ts timestamp_ntz")
    start, end = datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 3)
    assert ids(LogFilter(start=start, end=end).apply(frame)) == [1, 2, 3]
    assert ids(LogFilter(start=start).apply(frame)) == [1, 2, 3, 4]
    assert ids(LogFilter(end=end).apply(frame)) == [0, 1, 2, 3]
    assert ids(LogFilter().apply(frame)) == [0, 1, 2, 3, 4, 9]


def test_recent(spark):
    now = datetime(2024, 1, 2)
    rows = [
        (1, now - timedelta(hours=1)),
        (2, now - timedelta(hours=1, microseconds=1)),
        (3, now + timedelta(days=400)),
        (4, datetime(1, 1, 1)),
        (5, None),
    ]
    frame = spark.createDataFrame(rows, "id int, ts timestamp_ntz")
    assert ids(frame.where(fl.recent("Last hour", now))) == [1, 3]
    assert ids(frame.where(fl.recent(timedelta(hours=2), now))) == [1, 2, 3]
    assert ids(frame.where(fl.recent("Last hour"))) == []


def test_filter_set_changes():
    full = LogFilter("Error", datetime(2024, 1, 1), datetime(2024, 1, 2), "s", "text", 4, "svc")
    cleared = full.cleared()
    assert cleared == LogFilter(start=full.start, end=full.end, session_id="s")
    assert full.active and not cleared.active
    scoped = full.scoped(session_id="other")
    assert scoped == LogFilter(session_id="other", search="text", event_code=4, source="svc")
    assert not LogFilter(level="Error", search=" ", source="").active


def test_blank_filters_add_nothing():
    assert LogFilter(level=" ", session_id="", search=" ", source="").conditions() == []
    assert len(LogFilter(event_code=0).conditions()) == 1


def test_filters_reach_the_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "entries")
    rows = spark.range(10).select(
        F.col("id"),
        fl.ntz(datetime(2024, 1, 1)).alias("ts"),
        F.lit("Error").alias("level"),
        F.lit("m").alias("message"),
        F.lit(1).alias("event_code"),
        F.lit("svc").alias("source"),
        F.lit("s").alias("session_id"),
    )
    rows.write.parquet(path)
    wanted = LogFilter("Error", datetime(2023, 1, 1), None, "s", None, 1, "svc")
    wanted.apply(spark.read.parquet(path)).select("ts").explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    for part in ("EqualTo(level", "GreaterThanOrEqual(ts", "EqualTo(session_id", "EqualTo(source"):
        assert part in pushed
    assert "message" not in next(line for line in plan.splitlines() if "ReadSchema" in line)
