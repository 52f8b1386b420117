"""The training-data queries that SQL can express give DuckDB's rows, over whole tables."""

from __future__ import annotations

import pytest

from newsloom.llm import entry
from tests.compare import connection, rows
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    ours, theirs = entry.QUERIES[name](spark, SMALL).toPandas(), connection(SMALL).sql(entry.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
