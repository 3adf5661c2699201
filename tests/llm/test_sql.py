"""Queries of the training-data operators against their SQL on the smallest data folder."""

import pytest

from tests.oracle import compare, connect
from zonecraft.llm import plans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query(spark, con, name):
    assert compare(con, plans.QUERIES[name](spark, FOLDER), plans.SQL[name]) == ""
