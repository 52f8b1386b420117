"""Discovered pages: what is stored, repeated batches, and batches that are cut off."""

from __future__ import annotations

import hashlib

import pytest

from newsloom.operators import discovery
from newsloom.sources.store import Store

CANDIDATE = "topic_id bigint, url string, title string, host string, description string, page_title string, page_description string, markdown string"
LONG = "A whole story. " * 40
FIRST = [
    (1, "https://A.example/x", "Found", "a.example", "said", "Page", None, LONG), (2, "https://a.example/x", "Other", "a.example", "", None, None, LONG + "more"),
    (1, "https://a.example/y", " ", "a.example", None, None, None, None), (3, "https://b.example/z", "Z", "b.example", None, None, None, "short"), (3, " ", "none", None, None, None, None, None),
]


def tables(store):
    rows = lambda name, schema: sorted(tuple(r) for r in store.read(name, schema).collect())
    return {"snapshots": rows("snapshots", discovery.SNAPSHOTS), "contents": rows("contents", discovery.CONTENTS), "matches": rows("matches", discovery.MATCHES)}


def test_ingest_and_enrich(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", 4)
    batch = spark.createDataFrame(FIRST, CANDIDATE)
    assert discovery.ingest(store, 0, batch)
    found = tables(store)
    assert [r[:2] for r in found["contents"]] == [("https://a.example/x", "Page"), ("https://a.example/y", "a.example"), ("https://b.example/z", "Z")]
    assert [r[4] for r in found["contents"]] == ["full", "metadata_only", "partial"]
    evidence = '{"description": "a.example", "title": "a.example", "url": "https://a.example/y"}'
    assert ("https://a.example/y", "search_result", evidence, hashlib.sha256(evidence.encode()).hexdigest()) in found["snapshots"]
    assert found["matches"] == [(1, "https://a.example/x", "new"), (1, "https://a.example/y", "new"), (2, "https://a.example/x", "new"), (3, "https://b.example/z", "new")]
    assert not discovery.ingest(store, 0, batch) and tables(store) == found
    again = [(1, "https://a.example/x", "New title", "h", "d", "P", None, "short"), (1, "https://a.example/y", "Y", "h", "d", None, None, LONG), (5, "https://b.example/z", "Z", "h", "d", None, None, None)]
    assert discovery.ingest(store, 1, spark.createDataFrame(again, CANDIDATE))
    later = tables(store)
    assert later["contents"][0] == found["contents"][0] and later["contents"][1][3:] == (LONG.strip(), "full") and later["contents"][2] == found["contents"][2]
    assert [r for r in later["matches"] if r[2] != "new"] == [(1, "https://a.example/x", "reused"), (1, "https://a.example/y", "updated"), (5, "https://b.example/z", "reused")]
    assert len(later["snapshots"]) == 4


def test_a_batch_that_is_cut_off_leaves_nothing(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/store"
    batch = spark.createDataFrame(FIRST, CANDIDATE)
    for cut in ("commit", "second table"):
        with monkeypatch.context() as patch:
            if cut == "commit":
                patch.setattr(Store, "_commit", lambda self, manifest: (_ for _ in ()).throw(OSError("gone")))
            else:
                plain = Store.read
                patch.setattr(Store, "read", lambda self, table, *a: (_ for _ in ()).throw(OSError("gone")) if table == "contents" and a[1:] else plain(self, table, *a))
            with pytest.raises(OSError):
                discovery.ingest(Store(spark, root, 4), 0, batch)
        assert tables(Store(spark, root, 4)) == {"snapshots": [], "contents": [], "matches": []}
    assert discovery.ingest(Store(spark, root, 4), 0, batch)
    assert len(tables(Store(spark, root, 4))["contents"]) == 3


def test_null_and_repeated_keys(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", 2)
    frame = lambda *rows: spark.createDataFrame(list(rows), "k string, v int")
    assert store.upsert(3, {"t": (frame((None, 1), ("a", 2), ("b", 3)), ["k"])})
    assert not store.upsert(2, {"t": (frame(("c", 9)), ["k"])})
    assert store.upsert(4, {"t": (frame((None, 5), ("a", 6), ("a", 6)), ["k"]), "empty": (frame(), ["k"])})
    assert sorted(map(tuple, store.read("t", "k string, v int").collect()), key=str) == [("a", 6), ("b", 3), (None, 5)]
    assert store.read("empty", "k string, v int").count() == 0
