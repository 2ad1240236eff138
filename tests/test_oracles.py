"""Every registered query of the core against its SQL on the smallest tables."""

import pytest

from tests.compare import rows, views
from tests.conftest import SMALL


def _queries():
    from tessera.plans import queries

    return queries


@pytest.fixture(scope="module")
def tables():
    return views(SMALL)


@pytest.mark.parametrize("name", sorted(_queries().QUERIES))
def test_query_equals_its_sql(spark, tables, name):
    q = _queries()
    found = q.QUERIES[name](spark, SMALL).toPandas()
    wanted = tables.sql(q.SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_pages_concatenate_to_the_whole(spark):
    from tessera.operators import results

    whole = _queries().find_word(spark, SMALL).select(*results.CANONICAL_ORDER).cache()
    n = whole.count()
    pages = [results.page(whole, at, 1000).collect() for at in range(0, n, 1000)]
    assert [r for p in pages for r in p] == whole.orderBy(*results.CANONICAL_ORDER).collect()
    whole.unpersist()


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(5).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
