"""Each query of the catalogue against its SQL in DuckDB, over the smallest tables."""

import pytest

from meridian.plans.catalog_all import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, same, name):
    same(QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
