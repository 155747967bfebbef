import pytest

from rinkspark import catalog

from .compare import same


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, small, name):
    if name in catalog.SQL:
        same(spark, small, catalog.QUERIES[name], catalog.SQL[name])
    else:
        assert catalog.QUERIES[name](spark, small).count() >= 0


def test_sql_has_queries():
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_entry(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
