from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loglantern.operators import paging
from loglantern.operators.filters import LogFilter

HOT = datetime(2024, 1, 5)


def newest(rows, with_load):
    """Rows in display order, by plain Python."""

    def key(row):
        ts, load, id_ = row
        return (ts is not None, ts or datetime.min, load if with_load else "", id_)

    return sorted(rows, key=key, reverse=True)


@pytest.fixture(scope="module")
def rows():
    """A third of the rows share one time; some have none; loads repeat ids."""
    out = []
    for i in range(900):
        if i % 3 == 0:
            ts = HOT
        elif i % 20 == 1:
            ts = None
        else:
            ts = datetime(2024, 1, 1) + timedelta(seconds=i * 977, microseconds=i * 31)
        out.append((ts, f"load{i % 4}", i // 4 if i % 2 else i * 10**9))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "ts timestamp_ntz, load_id string, id long").cache()


def fetched(frame):
    return [tuple(r) for r in frame.select("ts", "load_id", "id").collect()]


@pytest.mark.parametrize("page", [1, 2, 5, 6, 10, 13, 17, 18, 19])
@pytest.mark.parametrize("top_rows", [50, 70, 100_000])
def test_pages_of_a_store(frame, rows, page, top_rows):
    expected = newest(rows, True)[(page - 1) * 50 : page * 50]
    assert fetched(paging.page_rows(frame, page, 50, top_rows)) == expected


@pytest.mark.parametrize("page", [1, 4, 9, 12])
@pytest.mark.parametrize("top_rows", [75, 100_000])
def test_pages_without_loads(spark, page, top_rows):
    rows = [(HOT if i % 2 else None, "", i) for i in range(900)]
    frame = spark.createDataFrame(rows, "ts timestamp_ntz, load_id string, id long").drop("load_id")
    expected = newest(rows, False)[(page - 1) * 75 : page * 75]
    got = paging.page_rows(frame, page, 75, top_rows).withColumn("load_id", F.lit(""))
    assert fetched(got) == expected


def test_all_pages_make_the_whole(frame, rows):
    pages = []
    for page in range(1, 6):
        pages += fetched(paging.page_rows(frame, page, 200, 250))
    assert pages == newest(rows, True)


def test_next_page_by_last_row(frame, rows):
    ordered = newest(rows, True)
    for last in (0, 49, 300, 500, 880, 899):
        ts, load, id_ = ordered[last]
        after = paging.page_after(frame, {"ts": ts, "load_id": load, "id": id_}, 40)
        assert fetched(after) == ordered[last + 1 : last + 41]


def test_empty_full_and_past_the_end(frame):
    nothing = frame.where("false")
    assert fetched(paging.page_rows(nothing)) == []
    assert fetched(paging.page_rows(nothing, 5000)) == []
    exact = frame.limit(50)
    assert len(fetched(paging.page_rows(exact, 1, 50))) == 50
    assert fetched(paging.page_rows(exact, 2, 50)) == []
    assert fetched(paging.page_rows(frame, 19, 50, 50)) == []


@pytest.mark.parametrize("page, size", [(0, 50), (-1, 50), (1, 0)])
def test_bad_pages_are_refused(frame, page, size):
    with pytest.raises(ValueError):
        paging.page_rows(frame, page, size)


def test_page_and_total(entries):
    page, total = paging.get_logs(entries, 2, 25, LogFilter(level="Error"))
    assert page.columns == ["ts", "level", "message", "event_code", "source"]
    assert page.count() == 25
    assert total.first().total == entries.where("level = 'Error'").count()
    past, same = paging.get_logs(entries, 10_000, 25, LogFilter(level="Error"))
    assert past.count() == 0 and same.first().total == total.first().total


def test_page_count(spark):
    totals = spark.createDataFrame([(0,), (1,), (50,), (51,)], "total long")
    got = [r[0] for r in totals.select(paging.page_count(F.col("total"))).collect()]
    assert got == [1, 1, 1, 2]


def test_page_reads_messages_within_bounds_only(spark, entries, tmp_path, capsys):
    path = str(tmp_path / "entries")
    entries.write.parquet(path)
    paging.page_rows(spark.read.parquet(path)).explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    assert "GreaterThanOrEqual(ts" in pushed
