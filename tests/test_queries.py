"""Every registered query that has SQL gives the same rows as DuckDB."""

import pytest

import oracle
from tokenlake.plans import image_queries, text_queries

QUERIES = text_queries.queries() | image_queries.queries()
SQL = text_queries.oracle_sql() | image_queries.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, sf, con):
    assert oracle.compare(con, QUERIES[name](spark, sf), SQL[name]) == ""


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)
