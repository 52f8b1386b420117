"""The pipeline's near-duplicate stage against all pairs: copies of 0.8 to 0.95 go, others stay."""

from __future__ import annotations

import random

import numpy as np
import pytest

from newsloom import session
from newsloom.llm import simhash
from newsloom.llm.shared import maybe_in
from newsloom.operators.graph import linked

WORDS = [f"w{k}" for k in range(3000)]


def jaccard(a: str, b: str) -> float:
    one, two = (set(simhash._shingles(x, 5).tolist()) for x in (a, b))
    return len(one & two) / len(one | two)


def planted(low: float, high: float, r: random.Random) -> tuple[str, str]:
    """A text and a copy whose five-word Jaccard lies between the bounds."""
    while True:
        words = r.choices(WORDS, k=r.randint(100, 400))
        copy = list(words)
        for at in r.sample(range(len(copy)), r.randint(1, 12)):
            copy[at] = r.choice(WORDS)
        if low <= jaccard(" ".join(words), " ".join(copy)) <= high:
            return " ".join(words), " ".join(copy)


def test_planted_copies(spark):
    r = random.Random(4)
    near = [planted(low, low + 0.05, r) for low in (0.8, 0.85, 0.9) for _ in range(60)]
    far = [planted(0.6, 0.78, r) for _ in range(60)]
    rows = [(2 * k + j, text) for k, pair in enumerate(near + far) for j, text in enumerate(pair)]
    kept = {x.doc_id for x in simhash.keep_one_per_group(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    gone = [2 * k + 1 not in kept for k in range(len(near))]
    print([sum(gone[a : a + 60]) for a in (0, 60, 120)])
    assert {x for x, _ in rows[2 * len(near) :]} <= kept and all(2 * k in kept for k in range(len(near)))
    assert sum(gone[:60]) >= 58 and all(gone[60:])


@pytest.mark.parametrize("small", [256, 4])
def test_large_groups_join_as_all_pairs_do(spark, small):
    r = random.Random(small)
    base = r.choices(WORDS, k=200)
    texts = []
    for _ in range(120):
        copy = list(base)
        for at in r.sample(range(200), r.randint(1, 5)):
            copy[at] = r.choice(WORDS)
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    nodes = simhash.numbered(simhash.stage_nodes(docs))
    ids = {x.node: x.who.id for x in nodes.collect()}
    links = {(ids[x.u], ids[x.v]) for x in simhash.similar_links(docs, nodes, small, block=50).collect()}
    assert all(jaccard(texts[a], texts[b]) >= 0.8 for a, b in links)
    found, true = list(range(120)), list(range(120))
    for label, pairs in ((found, links), (true, [(a, b) for a in range(120) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8])):
        for a, b in [*pairs] * 1:
            low, high = sorted((label[a], label[b]))
            label[:] = [low if x == high else x for x in label]
    assert found == true


def test_shared_counts():
    r = np.random.default_rng(2)
    one, two = ([np.unique(r.integers(-40, 40, r.integers(0, 30))) for _ in range(n)] for n in (7, 9))
    expected = [[len(np.intersect1d(a, b)) for b in two] for a in one]
    assert simhash.shared_counts(one, two, 8).tolist() == expected == simhash.shared_counts(one, two).tolist()


@pytest.mark.parametrize("rows", [session.BROADCAST_ROWS, 0])
def test_texts_are_shuffled_only_if_a_bitmap_asks_for_it(spark, monkeypatch, rows):
    """Tables too large to be broadcast give the same result, and most texts don't pass a shuffle for them."""
    monkeypatch.setattr(session, "BROADCAST_ROWS", rows)
    r = random.Random(6)
    texts = [" ".join(r.choices(WORDS, k=120)) for _ in range(200)]
    docs = [(k, text, "a") for k, text in enumerate(texts)] + [(300, texts[7], "a"), (301, texts[8].upper(), "b"), (9, texts[9], "a"), (9, texts[9], "a"), (302, None, "a"), (303, "", "a")]
    found = simhash.keep_one_per_group(spark.createDataFrame(docs, "doc_id bigint, text string, source string"))
    assert sorted(tuple(x) for x in found.collect()) == sorted(docs[:200] + [(302, None, "a")], key=lambda x: x[0])
    if not rows:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "bit_get" in plan


def test_maybe_in_loses_no_key(spark):
    keys = spark.range(3000).selectExpr("cast(id AS string) AS k")
    marked = maybe_in(keys, keys.where("k % 10 = 0"), "k").selectExpr("k % 10 = 0 AS wanted", "_maybe").collect()
    assert all(x._maybe for x in marked if x.wanted)
    assert len(marked) == 3000 and sum(x._maybe for x in marked) < 320


def test_few_links_take_few_tasks(spark):
    """Rounds of a few links don't run as many tasks as a shuffle has partitions."""
    status = spark.sparkContext.statusTracker()
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("few links", "")
    try:
        found = linked(spark.range(64).selectExpr("id AS u", "id + 1 AS v")).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stages = {s for job in status.getJobIdsForGroup("few links") for s in status.getJobInfo(job).stageIds}
    assert {x.component for x in found} == {0} and len(found) == 64
    assert sum(status.getStageInfo(s).numCompletedTasks for s in stages if status.getStageInfo(s)) < 1000
