"""Every query against its SQL on the smallest tables."""

import pytest
from compare import connection, same

import __spark_entry__
from tessella.plans import catalog


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sf, con, name):
    same(catalog.QUERIES[name](spark, sf), con, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).columns


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
