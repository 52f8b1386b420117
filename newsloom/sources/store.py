"""Keyed upserts over several Parquet tables that take effect together.

A table is dealt into buckets by the hash of its keys; a batch rewrites only the buckets that it touches, beside the old
ones. What counts is the manifest with the highest number: it names the files of every bucket of every table and the last
batch. It is written under another name and renamed at the end, so that a batch that is cut off leaves nothing and one
that is repeated changes nothing. Files that no manifest names are waste, not data.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 16


class Store:
    """Tables below one folder, on any file system that Spark can reach. One writer at a time; readers see whole batches."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        found = self._files.globStatus(self._path(f"{self.root}/manifest-*.json")) or []
        names = sorted(x.getPath().getName() for x in found)
        if not names:
            return {"version": 0, "last_batch": -1, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.root}/{names[-1]}", wholetext=True).first()[0])

    def read(self, table: str, schema, manifest: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The present rows of a table, or of some of its buckets; an unknown table is empty."""
        known = (manifest or self.manifest())["tables"].get(table, {})
        paths = sorted(p for b, p in known.items() if buckets is None or int(b) in buckets)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket(self, keys: list[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, keys: list[str]) -> list[int]:
        """The buckets of rows that are dealt by these keys."""
        return [r["b"] for r in rows.select(self.bucket(keys).alias("b")).distinct().collect()]

    def upsert(self, batch_id: int, changes: dict[str, tuple[DataFrame, list[str]]], by: int | None = None) -> bool:
        """Replaces or adds the rows of each table (rows, keys) by their keys; False if the batch, or a later one, is in already.

        Rows are dealt by the first `by` keys (always as many for a table), or all. Null keys equal each other; of rows
        with one key that with the least hash counts. Only the numbers of the touched buckets come to the driver.
        """
        manifest = self.manifest()
        if batch_id <= manifest["last_batch"]:
            return False
        version = manifest["version"] + 1
        for table, (rows, keys) in changes.items():
            one = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*rows.columns)))
            new = rows.withColumn("_n", one).where("_n = 1").drop("_n").withColumn("_bucket", self.bucket(keys[:by]))
            touched = self.touched(rows, keys[:by])
            if not touched:
                continue
            old = self.read(table, rows.schema, manifest, touched)
            same = reduce(lambda a, b: a & b, (old[k].eqNullSafe(rows[k]) for k in keys))
            kept = old.join(rows, same, "left_anti").withColumn("_bucket", self.bucket(keys[:by]))
            folder = f"{self.root}/{table}/{version:012d}-{uuid.uuid4().hex}"
            kept.unionByName(new).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
            manifest["tables"].setdefault(table, {}).update({str(b): f"{folder}/_bucket={b}" for b in touched})
        self._commit({**manifest, "version": version, "last_batch": batch_id})
        return True

    def _commit(self, manifest: dict) -> None:
        final = self._path(f"{self.root}/manifest-{manifest['version']:012d}.json")
        if self._files.exists(final):
            raise RuntimeError("another writer was here")
        draft = self._path(f"{self.root}/draft-{uuid.uuid4().hex}")
        out = self._files.create(draft)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if not self._files.rename(draft, final):
            raise RuntimeError("the manifest can't be written")
