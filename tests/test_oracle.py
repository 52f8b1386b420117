"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run and give a stable schema."""

from __future__ import annotations

import pytest

from newsloom.plans import catalog
from tests.compare import connection, rows
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, SMALL).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


#: Queries without SQL that find nothing in the smallest tables: their pages link to no articles, their items leave no pair open.
EMPTY = {"s1_article_links", "e6_review_pairs"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    """These have tests of their results elsewhere; here they give rows from the tables, the same number twice."""
    first, again = (catalog.QUERIES[name](spark, SMALL).count() for _ in range(2))
    assert first == again and (first > 0 or name in EMPTY)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
