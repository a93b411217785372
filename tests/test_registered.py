"""Every registered query against its DuckDB counterpart."""

from __future__ import annotations

import pytest
from compare import connect, difference
from conftest import SMALL

import __spark_entry__ as driver

QUERIES, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert difference(QUERIES[name](spark, SMALL), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_counterpart(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert len(rows) == 20
    factors = [r.impact_factor for r in rows]
    assert factors == sorted(factors, reverse=True)
