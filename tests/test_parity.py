"""Every query with SQL gives what the SQL gives; every other one runs."""

import pytest

import __spark_entry__ as entry
from parity import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_same_as_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], CHECKS[name], FOLDER) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1
