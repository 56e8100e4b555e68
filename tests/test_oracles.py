import pytest
from oracle import connect, difference

from quadrille.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf001):
    return connect(sf001)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf001, con, name):
    assert difference(QUERIES[name](spark, sf001), ORACLES[name], con) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf001, name):
    assert QUERIES[name](spark, sf001).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
