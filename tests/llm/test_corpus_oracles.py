import pytest
from oracle import connect, difference

from quadrille.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf001, name):
    assert difference(QUERIES[name](spark, sf001), ORACLES[name], connect(sf001)) == ""
