import pytest
from duck import SF, same, views

from tidelog.plans.oracles import ORACLES
from tidelog.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck():
    return views(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    same(QUERIES[name](spark, SF), duck, ORACLES[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
