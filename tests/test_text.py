import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loglantern.functions import text as tx
from loglantern.operators import projections as pr

ENTRY = "ts timestamp_ntz, level string, message string, event_code int, source string"
TS = datetime(2024, 2, 9, 3, 4, 5)


def entry_frame(spark, *rows):
    return spark.createDataFrame(list(rows), ENTRY)


def lines(frame, *args, **kwargs):
    return [r.line for r in pr.entry_lines(frame, *args, **kwargs).collect()]


def test_text_lines(spark):
    frame = entry_frame(
        spark,
        (TS, "Error", "disk full", 7, "svc"),
        (None, None, None, None, None),
        (TS, "", "m", 0, ""),
    )
    assert lines(frame) == [
        "09.02.2024 03:04:05 Error [7] (svc) disk full",
        "N/A N/A   ",
        "09.02.2024 03:04:05  [0]  m",
    ]


def test_json_lines_are_json(spark):
    frame = entry_frame(spark, (TS, "Error", 'a "b"\n\\c', None, None))
    assert json.loads(lines(frame, "JSON")[0]) == {
        "Timestamp": "2024-02-09T03:04:05.0000000",
        "Level": "Error",
        "Message": 'a "b"\n\\c',
        "EventId": None,
        "Source": None,
    }


def test_older_json_line(spark):
    frame = entry_frame(spark, (TS, "Error", 'a "b"', 7, None))
    assert lines(frame, "json", legacy_json=True) == [
        "09.02.2024 03:04:05 Error   {\r\n"
        '  "Timestamp": "2024-02-09T03:04:05.0000000",\r\n'
        '  "Level": "Error",\r\n'
        '  "Message": "a \\"b\\"",\r\n'
        '  "EventId": 7,\r\n'
        '  "Source": null\r\n'
        "}"
    ]


@pytest.mark.parametrize(
    "plain, quoted",
    [
        ("plain <b>&'", "\"plain <b>&'\""),
        ('"\\/', '"\\"\\\\/"'),
        ("\b\t\n\f\r", '"\\b\\t\\n\\f\\r"'),
        ("\x01\x1f\x7f\u0085", '"\\u0001\\u001F\\u007F\\u0085"'),
        ("Ошибка é 審", '"Ошибка é 審"'),
        ("a b ", '"a\\u00A0b\\u2028"'),
        ("\U0001f600!", '"\\uD83D\\uDE00!"'),
        ("", '""'),
        (None, "null"),
    ],
)
def test_json_string(spark, plain, quoted):
    frame = spark.createDataFrame([(plain,)], "x string")
    assert frame.select(tx.json_string(F.col("x"))).first()[0] == quoted


@pytest.mark.parametrize("fmt", ["xml", "", None])
def test_unknown_format_is_refused(fmt):
    with pytest.raises(ValueError):
        pr.check_format(fmt)


def test_whole_numbers(spark):
    texts = ["12", " 7 ", "+3", "-4", "2147483647", "2147483648", "1.5", "1e3", "0x1", "", None]
    frame = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r[0] for r in frame.select(tx.whole_number(F.col("x"))).collect()]
    assert got == [12, 7, 3, -4, 2147483647] + [None] * 6


def test_labels(spark):
    texts = ["x" * 20, "abcdefghijklmnopqrstu", "", None]
    frame = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r[0] for r in frame.select(tx.short_label(F.col("x"))).collect()]
    assert got == ["x" * 20, "abcdefghijklmnopq...", "", None]


def test_labels_count_utf16_units(spark):
    texts = ["\U0001f600" * 10, "\U0001f600" * 11, "é" * 20, "é" * 21, "a" + "\U0001f600" * 10]
    frame = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [r[0] for r in frame.select(tx.short_label(F.col("x"))).collect()]
    smile = "\U0001f600"
    assert got == [smile * 10, smile * 8 + "...", "é" * 20, "é" * 17 + "...", "a" + smile * 8 + "..."]


def test_safe_file_name(spark):
    frame = spark.createDataFrame([('a<b>c:d"e/f\\g|h?i*j\x01k',)], "x string")
    assert frame.select(tx.safe_file_name(F.col("x"))).first()[0] == "a_b_c_d_e_f_g_h_i_j_k"
