"""The skip index of message search: no match is lost, and files without one are not read."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from loglantern.operators.filters import LogFilter, message_contains
from loglantern.plans.history import History
from loglantern.schema import ENTRY_COLUMNS
from loglantern.sources.grams import POSITIONS, gram_positions, searched_positions
from loglantern.sources.store import EntryStore

# Two letters, none, null, letters beyond ASCII and beyond 16 bits, a capital whose small
# form is longer, line ends, and what the pattern must not take as its own.
MESSAGES = ["ab", "", None, "Zażółć GĘŚLĄ", "smile 😀😃😄 end", "İstanbul", "first\nsecond LINE", "a.b*c [x] (y)", "100% of_it"]
SEARCHES = ["abc", "zażółć", "ZAżó", "😀😃😄", "stanbul", "İst", "d line", ".b*", "0% of", "fir%line", "smile%_end", "%_%", "ab", "no such text", "message 7 ", "(y)"]


@pytest.fixture(scope="module")
def rows(spark):
    """Forty files' worth of messages, the odd ones in the first."""
    odd = spark.createDataFrame([(i, m) for i, m in enumerate(MESSAGES)], "n long, message string")
    many = spark.range(1000, 5000).select(F.col("id").alias("n"), F.format_string("Message %d of host %d", F.col("id"), F.floor(F.col("id") / 100)).alias("message"))
    return odd.unionByName(many).select(
        F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("ts"), F.lit("Error").alias("level"), "message",
        F.lit(1).alias("event_code"), F.lit("s").alias("source"), "n",
    ).repartitionByRange(40, "n")


@pytest.fixture(scope="module")
def store(spark, rows, tmp_path_factory):
    made = EntryStore(spark, str(tmp_path_factory.mktemp("grams")), grams=True)
    made.append(rows.select(*ENTRY_COLUMNS), "s")
    return made


def texts(frame):
    return sorted(r.message for r in frame.select("message").collect())


@pytest.mark.parametrize("search", SEARCHES)
def test_no_match_is_lost(store, search):
    found = store.read(search=search).where(message_contains(search))
    assert texts(found) == texts(store.read().where(message_contains(search)))


def test_files_without_the_text_are_not_read(store):
    every = len(store.read().inputFiles())
    assert every >= 20
    rare = store.read(search="OF host 17")
    assert 1 <= len(rare.inputFiles()) <= every // 5
    assert rare.where(message_contains("OF host 17")).count() == 100
    assert 1 <= len(store.read(search="smile%end").inputFiles()) <= 2
    assert store.read(search="no such text").inputFiles() == []
    assert len(store.read(search="m_s").inputFiles()) == every  # no run is long enough


def test_history_searches_through_the_index(store):
    page, total = History(store).get_logs(filters=LogFilter(search="host 17"))
    assert page.count() == 50 and total.first()[0] == 100
    assert History(store).count_logs(LogFilter(search="no such text")).first()[0] == 0


def test_index_follows_merging_retention_and_earlier_parts(spark, rows, tmp_path):
    path = str(tmp_path / "store")
    entries = rows.select(*ENTRY_COLUMNS)
    EntryStore(spark, path).append(entries.where("message like '%host 17'"), "s", F.lit("2024-01-01").cast("timestamp_ntz"))
    store = EntryStore(spark, path, grams=True)
    assert store.read(search="host 17").count() == 100  # a part from before has no index: it is read
    for day in ("2024-01-01", "2024-01-03"):
        store.append(entries.where("message like '%host 1_'"), "s", F.lit(day).cast("timestamp_ntz"))
    store.compact(before=date(2100, 1, 1))
    wanted = message_contains("host 17")
    assert store.read(search="host 17").where(wanted).count() == 300
    store.delete_older_than(datetime(2024, 1, 2))
    assert store.read(search="host 17").where(wanted).count() == 100
    store.clear()
    assert store.read(search="host 17").count() == 0


def test_parts_without_runs(spark, tmp_path):
    store = EntryStore(spark, str(tmp_path / "store"), grams=True)
    entries = spark.createDataFrame([(None, "Error", m, 1, "s") for m in ("ab", "", None)], "ts timestamp_ntz, level string, message string, event_code int, source string")
    store.append(entries, "s")
    assert store.read(search="abc").where(message_contains("abc")).count() == 0
    assert store.read(search="ab").where(message_contains("ab")).count() == 1


def test_positions_are_those_of_the_runs(spark):
    frame = spark.createDataFrame([("aBcAbC",), ("ab",), (None,)], "message string")
    counts = [r.n for r in frame.select(F.size(gram_positions(F.col("message"))).alias("n")).collect()]
    assert counts[:2] == [3, 0]  # abc, bca, cab
    assert all(1 <= bit + 32768 * (bucket - 1) + 1 <= POSITIONS for bucket, bit in searched_positions(spark, "some text"))
