"""Every catalogue query against its DuckDB oracle at the smallest scale."""

from __future__ import annotations

import pytest
from compare import SF, assert_same, tables

from corvane.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return tables()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["p_partkey", "split"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
