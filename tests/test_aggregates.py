from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loglantern.operators import aggregates as agg
from loglantern.operators.dedupe import distinct_entries, first_entries
from loglantern.plans import dashboard as charts
from loglantern.plans.history import History, source_options
from loglantern.schema import ENTRY_SCHEMA

LEVELS = ["Error", "Error", "error", "Other", "Unknown", None, "", "AuditFailure"]


@pytest.fixture(scope="module")
def few(spark):
    rows = [
        (i, datetime(2024, 1, 1, i), level, "m", i % 3, ["", None, "a"][i % 3], datetime(2024, 1, 1), "s")
        for i, level in enumerate(LEVELS)
    ]
    return spark.createDataFrame(rows, ENTRY_SCHEMA).cache()


def as_dict(frame):
    return {r[0]: r[1] for r in frame.collect()}


def test_unknown_takes_in_missing_levels(few):
    assert as_dict(agg.level_counts(few)) == Counter(
        "Unknown" if level is None else level for level in LEVELS
    )


def test_counters(few):
    row = agg.level_counters(few).first().asDict()
    assert row == {
        "total": 8, "error": 2, "warning": 0, "information": 0,
        "audit_success": 0, "audit_failure": 1, "other": 3,
    }
    assert set(agg.level_counters(few.where("false")).first()) == {0}


def test_pie_leaves_out_empty_slices(few):
    assert as_dict(agg.pie_slices(few)) == {"Error": 2, "Other": 3, "Audit Failure": 1}


def test_empty_source_counts_in_ranking_only(few):
    assert as_dict(agg.top_sources(few)) == {"": 3, "a": 2}
    assert as_dict(agg.top_named_sources(few)) == {"a": 2}


def test_ties_go_by_key(few):
    assert [r.event_code for r in agg.top_event_codes(few).collect()] == [0, 1, 2]


def test_level_count_ignores_case(few):
    assert agg.level_count(few, "ERROR").first().total == 3
    assert agg.level_count(few.where("false"), "error").first().total == 0


def test_days_come_out_of_hours(entries):
    assert as_dict(agg.days_of(agg.hourly_counts(entries))) == as_dict(agg.daily_counts(entries))


def test_counts_add_up(entries):
    total = agg.row_count(entries).first().total
    assert sum(as_dict(agg.level_counts(entries)).values()) == total
    assert agg.history_summary(entries).first().total == total
    assert agg.session_level_counts(entries, "error").agg(F.sum("count")).first()[0] == (
        agg.level_count(entries, "error").first().total
    )


def test_empty_history(entries):
    nothing = entries.where("false")
    row = agg.history_summary(nothing).first()
    assert (row.sessions, row.statistics, row.total) == (0, "", 0)
    assert not agg.has_records(nothing).first()[0]
    assert agg.max_timestamp(nothing).first()[0] is None


def test_sessions_latest_first(entries):
    got = [r[0] for r in agg.sessions(entries).collect()]
    assert got == sorted(set(got), reverse=True)


def test_event_code_list_is_cut_at_the_lowest(entries):
    got = [r[0] for r in agg.distinct_event_codes(entries, max_count=5).collect()]
    assert got == sorted(r[0] for r in entries.select("event_code").distinct().collect() if r[0] is not None)[:5]


def test_source_options_begin_with_the_empty_choice(few):
    assert [r[0] for r in source_options(few).collect()] == ["", "", "a"]


def test_dedupe_treats_nulls_as_equal_and_is_idempotent(entries):
    once = distinct_entries(entries.unionAll(entries))
    assert once.count() == distinct_entries(once).count() == entries.drop("id", "created_at", "session_id").distinct().count()
    firsts = first_entries(entries.unionAll(entries.withColumn("id", F.col("id") + 10_000)))
    assert firsts.agg(F.max("id")).first()[0] < 10_000


def test_copies_are_folded_before_the_shuffle(entries, capsys):
    distinct_entries(entries).explain()
    plan = capsys.readouterr().out
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1


def test_history_object(entries):
    history = History(entries=entries)
    assert history.has_records()
    report = history.detailed_statistics("All Sessions")
    assert report["counters"].first().total == entries.count()
    parts = history.dashboard()
    assert set(report) < set(parts)
    assert parts["top_sources"].columns == ["source", "count", "label"]
    assert charts.as_rows(parts).columns == ["part", "key", "count"]
    scoped = history.time_series("Session_20240115_000000_System")
    assert scoped.agg(F.sum("count")).first()[0] == (
        entries.where("session_id = 'Session_20240115_000000_System' AND ts IS NOT NULL").count()
    )
    with pytest.raises(ValueError):
        History()
