"""Every core query with SQL gives the same rows in DuckDB, over whole tables."""

import pytest

from lumenframe import plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, duck, same, name):
    got = plans.QUERIES[name](spark, sf)
    assert len(set(got.columns)) == len(got.columns)
    rows = got.toPandas()
    if name in plans.SQL:
        want = duck.sql(plans.SQL[name]).df()
        assert sorted(want.columns) == sorted(rows.columns)
        assert same(rows) == same(want)


def test_contract(spark, sf):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
