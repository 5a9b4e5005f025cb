"""Every registered query against its SQL twin at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# the filters of these leave nothing at the smallest scale
MAY_BE_EMPTY = {"page", "search_predictions"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    diff = compare(spark, con, SF, QUERIES[name], SQL[name])
    assert diff is None or (diff == "EMPTY" and name in MAY_BE_EMPTY), diff


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "news_count" in df.columns
