"""Every registered query against its DuckDB statement on the given tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from laureate.oracle import ORACLE
from laureate.queries import QUERIES
from tests.compare import assert_same, duck, plan

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = driver.queries()[name](spark, SF_DIR)
    text = plan(result)
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert unwanted not in text
    assert assert_same(result, con, driver.oracle_sql()[name]) > 0


def test_entry(spark):
    from laureate.schemas import INDEX_COLUMNS

    assert tuple(driver.entry(spark).columns) == INDEX_COLUMNS
