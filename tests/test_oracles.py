"""Every registered query against its SQL statement on the smallest data folder."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect
from zonecraft.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
OWN = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(OWN) <= set(QUERIES) and set(OWN) <= set(SQL)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    assert compare(con, QUERIES[name](spark, FOLDER), SQL[name]) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "c_custkey" and df.count() > 0
