"""Incremental flows: feed windows as keyed state, run statistics with a watermark, page ingestion batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.operators import ingest
from newsloom.operators.ingest import WINDOW
from newsloom.sources.store import Store

PLAN = "source_id bigint, entry_id string, fingerprint string, is_new boolean"
STATE = "entries array<struct<id:string,fingerprint:string>>"


def feed_changes(entries: DataFrame, size: int = WINDOW) -> DataFrame:
    """A stream of feed entries -> those that are new or changed for their source.

    State per source: the last `size` entries with their fingerprints. Entries of one trigger are taken in order of
    their position; late repeats of a known fingerprint give nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(state.get[0]) if state.exists and state.get[0] is not None else {}
        rows = []
        for batch in batches:
            for entry, mark in batch.sort_values(["position", "entry_id"])[["entry_id", "fingerprint"]].itertuples(index=False):
                if known.get(entry) != mark:
                    rows.append((key[0], entry, mark, entry not in known))
                known.pop(entry, None)
                known[entry] = mark
        state.update((list(known.items())[-size:],))
        yield pd.DataFrame(rows, columns=["source_id", "entry_id", "fingerprint", "is_new"])

    return entries.groupBy("source_id").applyInPandasWithState(step, PLAN, STATE, "append", GroupStateTimeout.NoTimeout)


def run_statistics(runs: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """A stream of crawl runs -> runs and failures by status per event-time window, late rows bounded by a watermark."""
    rows = runs.withWatermark("started_at", late)
    return rows.groupBy(F.window("started_at", width).alias("w"), "status").agg(F.count("*").alias("runs")).select(F.col("w.start").alias("window_start"), "status", "runs")


RAW = "source_id bigint, identity_key string, payload_sha256 string, canonical_url string, title string, body string, action string, batch_id bigint"


def ingest_stream(articles: DataFrame, store: Store, checkpoint: str):
    """Adds the new versions of every batch to the table `raw` of a store.

    A batch reads and rewrites only the buckets of its own identities. A batch that runs again, also after a restart, is
    in the store already and adds nothing. Batch numbers belong to one checkpoint: a stream that starts over without it
    gives numbers that are taken, so it needs a new store to add other files.
    """
    keys = ["source_id", "identity_key", "payload_sha256"]

    def add(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        none = store.spark.createDataFrame([], RAW)
        raw = store.read("raw", RAW, buckets=store.touched(ingest.ingest(batch, none), keys[:2]))
        found = ingest.ingest(batch, raw).where("action <> 'skipped'").withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        store.upsert(batch_id, {"raw": (found.select(*[c.split()[0] for c in RAW.split(", ")]), keys)}, by=2)
        batch.unpersist()

    return articles.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_table_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)
