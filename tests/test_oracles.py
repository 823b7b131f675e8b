"""Every named query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

BASE = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(BASE)


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], BASE) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"model_security_report"}))
def test_query_without_twin(spark, name):
    df = QUERIES[name](spark, BASE)
    assert len(set(df.columns)) == len(df.columns)
    df.count()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["o_orderkey", "score", "risk_level"] and df.count() == 1500
