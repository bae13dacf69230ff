import pytest

from logloom.llm import catalog
from tests.against_sql import DATA, HAVE, connection, same

pytestmark = pytest.mark.skipif(not HAVE, reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, name):
    same(spark, connection(), catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() >= 0


def test_registered():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(catalog.SQL) <= set(e.oracle_sql())
