"""Small sources beside a corpus of billions of words reach their targets."""

from __future__ import annotations

import pytest

from newsloom.llm import mixing


@pytest.mark.parametrize("hot", [1_500_000_000, 40_000_000])
def test_tiny_sources_in_a_large_corpus(spark, hot):
    small = [10_361, 16_455, 33_876, 39_342, 500_000, 120]
    rows = [(f"s{k:02}", n) for k, n in enumerate(small)] + [("t0", hot), ("t1", hot), ("t2", hot)]
    sources = mixing.targets(spark.createDataFrame([(*row, 1) for row in rows], "source string, size bigint, m bigint"))
    spans = mixing.shares(sources, mixing.block_words(sum(n for _, n in rows))).cache()
    slots = -(-spans.first()["all_parts"] // mixing.PARTS)
    taken = {r["place"]: r["count"] for r in mixing.schedule(spans, slots).groupBy("place").count().collect()}
    for r in spans.collect():
        words = taken.get(r["place"], 0) * r["source_size"] / r["blocks"]
        assert abs(words - r["target"]) <= max(0.01 * r["target"], 150), (r, words)
