"""Streams that are started, stopped and started again from their checkpoints."""

from __future__ import annotations

from datetime import datetime

from newsloom.sources.store import Store
from newsloom.streaming import flows

ENTRY = "source_id bigint, position int, entry_id string, fingerprint string"
ARTICLE = "source_id bigint, external_id string, url string, title string, published timestamp, body string, excerpt string, topics array<string>"


def drop(spark, rows, schema, folder, name):
    """A new file in a watched folder."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def watched(spark, schema, folder):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(folder))


def test_feed_state_survives_a_restart(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        changes = flows.feed_changes(watched(spark, ENTRY, folder), size=3)
        changes.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r.source_id, r.entry_id, r.fingerprint, r.is_new) for r in spark.read.parquet(out).collect())

    drop(spark, [(1, 0, "a", "1"), (1, 1, "b", "1"), (2, 0, "a", "9")], ENTRY, folder, "one")
    first = run()
    assert first == [(1, "a", "1", True), (1, "b", "1", True), (2, "a", "9", True)]
    # Known entries give nothing, a changed one and a new one do; the window forgets what is oldest.
    drop(spark, [(1, 0, "a", "1"), (1, 1, "b", "2"), (1, 2, "c", "1"), (1, 3, "d", "1")], ENTRY, folder, "two")
    assert sorted(set(run()) - set(first)) == [(1, "b", "2", False), (1, "c", "1", True), (1, "d", "1", True)]
    drop(spark, [(1, 0, "a", "1"), (1, 1, "d", "1"), (2, 0, "a", "9")], ENTRY, folder, "three")
    assert len(run()) == 7 and run().count((1, "a", "1", True)) == 2


def test_ingestion_is_exact_over_restarts(spark, tmp_path):
    folder, store = tmp_path / "in", Store(spark, f"file://{tmp_path}/store", 4)
    article = lambda k, body: (k % 2, f"x{k}", f"https://e.example/{k}", f"Title {k}", datetime(2024, 1, 1), body, "", [])

    def run(checkpoint="state"):
        flows.ingest_stream(watched(spark, ARTICLE, folder), store, str(tmp_path / checkpoint)).awaitTermination()
        return sorted((r.title, r.body, r.action, r.batch_id) for r in store.read("raw", flows.RAW).collect())

    drop(spark, [article(1, "a"), article(2, "b"), article(2, "b")], ARTICLE, folder, "one")
    first = run()
    assert first == [("Title 1", "a", "new", 0), ("Title 2", "b", "new", 0)]
    drop(spark, [article(1, "a"), article(2, "changed"), article(3, "c")], ARTICLE, folder, "two")
    second = run()
    assert [r for r in second if r not in first] == [("Title 2", "changed", "updated", 1), ("Title 3", "c", "new", 1)]
    # Without its checkpoint the stream takes all files again, as a batch that is in the store.
    assert run("lost") == second


def test_late_runs_are_bounded(spark, tmp_path):
    folder, schema = tmp_path / "in", "id bigint, started_at timestamp, status string"
    at = lambda day, hour=0: datetime(2024, 1, day, hour)

    def run():
        counts = flows.run_statistics(watched(spark, schema, folder))
        counts.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return sorted((r.window_start.day, r.status, r.runs) for r in spark.read.schema("window_start timestamp, status string, runs bigint").parquet(str(tmp_path / "out")).collect())

    drop(spark, [(1, at(1), "failed"), (2, at(1, 5), "failed"), (3, at(2, 2), "succeeded")], schema, folder, "one")
    assert run() == [(1, "failed", 2)]
    drop(spark, [(4, at(1, 9), "failed"), (5, at(2, 3), "succeeded"), (6, at(4), "failed")], schema, folder, "two")
    assert run() == [(1, "failed", 2), (2, "succeeded", 2)]
