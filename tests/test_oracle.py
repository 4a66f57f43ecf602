"""Every query with SQL against DuckDB on the smallest data set; the others must at least return rows."""

import os

import pytest

import __spark_entry__ as entry
from barline.queries import QUERIES, oracle
from tests.oracle import compare, connect

SF = os.environ.get("BARLINE_TEST_SF", "/root/testdata/sf0.001")
SQL = oracle()
SLOW = {"wf_logreg", "meta_model", "fused_model", "threshold_sweep"}  # covered by tests of their own


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    compare(spark, con, SF, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert entry.queries().keys() >= QUERIES.keys() and entry.oracle_sql().keys() >= SQL.keys()
