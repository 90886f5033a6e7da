"""Every registered query against its SQL, on the smallest data."""

import os

import oracle
import pytest

import __spark_entry__ as entry_module

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
RELATIONAL = entry_module.QUERIES


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(FOLDER)


def test_every_query_states_its_result():
    assert set(RELATIONAL) <= set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = oracle.actual(QUERIES[name](spark, FOLDER))
    want = oracle.expected(duck, ORACLES[name])
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1], "a query that returns nothing checks nothing"


def test_entry(spark):
    df = entry_module.entry(spark)
    assert "rank" in df.columns and df.count() > 0
