from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loglantern.functions import times as tm
from loglantern.operators.series import time_series
from loglantern.schema import MISSING_TIME

MOMENTS = [
    datetime(2023, 12, 31, 23, 59, 59, 999999),
    datetime(2024, 1, 1),
    datetime(2024, 2, 29, 12, 34, 56, 1),
    datetime(1969, 12, 31, 23, 58, 1),
    datetime(1, 1, 1, 0, 13, 5),
]


def expected_bucket(ts, width):
    hour = 0 if width >= timedelta(days=1) else ts.hour
    step = width // timedelta(minutes=1)
    minute = 0 if width >= timedelta(hours=1) else ts.minute // step * step
    return datetime(ts.year, ts.month, ts.day, hour, minute)


@pytest.fixture(scope="module")
def moments(spark):
    return spark.createDataFrame([(m,) for m in MOMENTS], "ts timestamp_ntz").cache()


@pytest.mark.parametrize(
    "width",
    [
        timedelta(days=1), timedelta(days=7), timedelta(hours=30), timedelta(hours=6),
        timedelta(hours=1), timedelta(minutes=59), timedelta(minutes=45), timedelta(minutes=15),
        timedelta(minutes=7), timedelta(seconds=90), timedelta(minutes=1),
    ],
)
@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_buckets(spark, moments, width, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = moments.select("ts", tm.time_bucket(F.col("ts"), width).alias("time")).collect()
        assert {r.ts: r.time for r in got} == {m: expected_bucket(m, width) for m in MOMENTS}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_narrow_bucket_is_refused(entries):
    with pytest.raises(ValueError):
        time_series(entries, timedelta(seconds=30))


def test_aligned_bucket(moments):
    got = moments.select(tm.time_bucket(F.col("ts"), timedelta(hours=6), aligned=True).alias("t"))
    assert {r.t for r in got.collect()} == {
        datetime(2023, 12, 31, 18), datetime(2024, 1, 1), datetime(2024, 2, 29, 12),
        datetime(1969, 12, 31, 18), datetime(1, 1, 1),
    }


def test_series_counts_every_timed_row(entries):
    timed = entries.where("ts IS NOT NULL").count()
    for width in (timedelta(days=1), timedelta(hours=1), timedelta(minutes=7)):
        assert time_series(entries, width).agg(F.sum("count")).first()[0] == timed


@pytest.mark.parametrize(
    "text, zone, expected",
    [
        ("20240102030405.123456+060", "UTC", datetime(2024, 1, 2, 2, 4, 5, 123456)),
        ("20240102030405.000000-300", "UTC", datetime(2024, 1, 2, 8, 4, 5)),
        ("20240102030405.000000+000", "Europe/Berlin", datetime(2024, 1, 2, 4, 4, 5)),
        ("20240702030405.000000+000", "Europe/Berlin", datetime(2024, 7, 2, 5, 4, 5)),
        ("20240102030405.000000+***", "Europe/Berlin", datetime(2024, 1, 2, 3, 4, 5)),
        (None, "UTC", MISSING_TIME),
        ("", "UTC", MISSING_TIME),
        ("garbage", "UTC", MISSING_TIME),
        ("20241302030405.000000+000", "UTC", MISSING_TIME),
        ("20240102030405.000000", "UTC", MISSING_TIME),
    ],
)
def test_provider_time(spark, text, zone, expected):
    frame = spark.createDataFrame([(text,)], "x string")
    assert frame.select(tm.parse_provider_time(F.col("x"), zone)).first()[0] == expected


def test_json_time(spark):
    frame = spark.createDataFrame(
        [(datetime(2024, 7, 2, 3, 4, 5, 120000),), (None,)], "ts timestamp_ntz"
    )
    rows = frame.select(
        tm.json_time(F.col("ts")),
        tm.json_time(F.col("ts"), "Asia/Kolkata"),
        tm.json_time(F.col("ts"), "America/New_York"),
    ).collect()
    assert tuple(rows[0]) == (
        "2024-07-02T03:04:05.1200000",
        "2024-07-02T03:04:05.1200000+05:30",
        "2024-07-02T03:04:05.1200000-04:00",
    )
    assert tuple(rows[1]) == (None, None, None)
    texts = spark.createDataFrame([("2024-07-02T03:04:05.1200000",), ("nonsense",)], "x string")
    assert [r[0] for r in texts.select(tm.parse_json_time(F.col("x"))).collect()] == [
        datetime(2024, 7, 2, 3, 4, 5, 120000), None,
    ]


def test_json_times_of_others(spark):
    texts = {
        "2024-01-01T10:00:00+05:00": datetime(2024, 1, 1, 5),
        "2024-01-01T10:00:00Z": datetime(2024, 1, 1, 10),
        "2024-01-01": datetime(2024, 1, 1),
        "01/02/2024 10:00:00": datetime(2024, 1, 2, 10),
        "2024": None, "2024-01": None, "": None, "2024-13-01T00:00:00": None,
    }
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    assert {r[0]: r[1] for r in rows.select("x", tm.parse_json_time(F.col("x"))).collect()} == texts
    berlin = rows.where("x LIKE '%Z'").select(tm.parse_json_time(F.col("x"), "Europe/Berlin"))
    assert berlin.first()[0] == datetime(2024, 1, 1, 11)


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin", "America/New_York"])
def test_utc_now_is_the_instant(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = spark.range(1).select(tm.utc_now().alias("now"), F.unix_micros(F.current_timestamp()).alias("us")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (row.now - datetime(1970, 1, 1)) // timedelta(microseconds=1) == row.us


def test_event_time_shows_the_wall_clock(spark, moments):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = moments.select(
            F.unix_micros(tm.event_time(F.col("ts"))).alias("us"), "ts"
        ).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for row in rows:
        assert row.us == (row.ts - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def test_ranges():
    assert tm.time_range("Last 3 days") == timedelta(days=3)
    with pytest.raises(ValueError):
        tm.time_range("Last year")
