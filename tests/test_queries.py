"""Every query with SQL gives the rows of its SQL."""

import helpers
import pytest

from gaugeworks import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return helpers.connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_agrees_with_sql(name, spark, con):
    assert not helpers.difference(catalog.QUERIES[name], catalog.SQL[name], spark, SF, con)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(name, spark):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
