"""Vectorized functions work on slices of an Arrow batch, with the results of the whole."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from newsloom.functions import slices
from newsloom.operators.entities import Alias, find_mentions


def test_slices_are_bounded_by_rows_and_bytes_and_lose_nothing():
    short, long = pa.array([str(k) for k in range(1000)]), pa.array(["x" * 300_000, None, "y" * 3_000_000, ""] * 5)
    parts = [x for x, in slices.cut([short])]
    assert max(map(len, parts)) <= slices.ROWS and sum(parts, []) == short.to_pylist()
    parts = [x for x, in slices.cut([long])]
    assert sum(parts, []) == long.to_pylist()
    assert all(len(x) == 1 or sum(len(t or "") for t in x) <= slices.BYTES for x in parts)
    assert list(slices.cut([pa.array([], "string")])) == []


def test_a_function_never_sees_more_than_a_slice(spark):
    count = slices.sliced("struct<rows:int,value:bigint,names:map<string,string>>")(lambda ids: [{"rows": len(ids), "value": x, "names": [("a", str(x))]} for x in ids])
    both = slices.sliced("bigint")(lambda a, b: [None if x is None else x + y for x, y in zip(a, b)])
    rows = spark.range(0, 5000, 1, 1).withColumn("c", count("id")).withColumn("d", both(F.when(F.col("id") % 7 != 0, F.col("id")), "id")).collect()
    assert max(r.c.rows for r in rows) <= slices.ROWS
    assert all(r.c.value == r.id and r.c.names == {"a": str(r.id)} for r in rows)
    assert all(r.d == (None if r.id % 7 == 0 else 2 * r.id) for r in rows)


def test_mentions_of_more_rows_than_a_slice(spark):
    items = spark.range(0, 1500, 1, 1).select(F.when(F.col("id") != 3, F.col("id")).alias("id"), F.lit("Acme").alias("title"), F.lit(None).cast("string").alias("excerpt"), F.concat(F.lit("met "), F.when(F.col("id") % 2 == 0, "Acme").otherwise("none")).alias("body"))
    found = find_mentions(items, [Alias(1, "Acme")]).collect()
    assert len(found) == 2250 and {r.content_item_id for r in found} == {None, *range(1500)} - {3}
