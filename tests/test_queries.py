"""Every registered query against DuckDB, and the driver contract."""

import pytest

import __spark_entry__ as contract
import oracle
from loglantern.plans.catalogue import ORACLES, QUERIES

SLOW_SCALE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def small(sf_dir):
    return oracle.connect(sf_dir)


@pytest.fixture(scope="module")
def larger():
    return oracle.connect(SLOW_SCALE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, small, name):
    frame = contract.queries()[name](spark, sf_dir)
    assert oracle.differences(frame, small, contract.oracle_sql()[name]) == ""


@pytest.mark.parametrize(
    "name", ["series_hour", "dashboard_bundle", "page_deep", "level_normalize", "dedupe_entries"]
)
def test_query_equals_its_sql_at_larger_scale(spark, larger, name):
    frame = contract.queries()[name](spark, SLOW_SCALE)
    assert oracle.differences(frame, larger, contract.oracle_sql()[name]) == ""


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.items() <= contract.queries().items()
    assert ORACLES.items() <= contract.oracle_sql().items()


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["time", "count", "label"]
    assert frame.count() > 0
