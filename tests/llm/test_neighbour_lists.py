"""Nearest neighbours by inner product where norms vary and where query rows repeat."""

from __future__ import annotations

import numpy as np
import pytest

from newsloom.llm import ann


@pytest.mark.parametrize("sigma", [0.25, 0.5, 1.0])
def test_recall_with_varied_norms(spark, sigma):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((6000, 64))
    x *= (np.exp(sigma * rng.standard_normal(len(x))) / np.linalg.norm(x, axis=1))[:, None]
    data = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    hits = 0
    found = ann.search(data).toPandas()
    for q, own in found.groupby("query_id"):
        scores = x @ x[q]
        scores[q] = -np.inf
        assert len(own) == 20
        hits += len(set(own.vec_id) & set(np.argsort(-scores)[:20]))
    assert hits / (20 * 300) >= 0.9, hits


def test_repeated_query_rows_keep_twenty_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(20, x[20].tolist())] * 2 + [(40, x[41].tolist())]
    found = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), probed=1.0).toPandas()
    own = found[found.query_id == 20].sort_values("rank")
    # The two other rows of id 20 are candidates of its query, each once; 40 has two vectors.
    assert own["rank"].tolist() == list(range(1, 21)) and own.vec_id[~own.vec_id.isin([20, 40])].is_unique
    assert own.vec_id.tolist()[:2] == [20, 20] and (own.vec_id == 20).sum() == 2
    assert found[found.query_id == 40]["rank"].value_counts().eq(2).all() and (found.query_id == 40).sum() == 40


def test_most_pairs_are_abandoned_and_nothing_depends_on_the_sample(spark):
    """Isotropic vectors, a sample of 5 % of the rows: recall, and the pairs alive after each test of the scan."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((8000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    data = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found, hits = ann.search(data, sample=400).toPandas(), 0
    for q, own in found.groupby("query_id"):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(set(own.vec_id) & set(np.argsort(-scores)[:20]))
    assert len(found) == 8000 and hits / 8000 >= 0.9, hits
    queries, rows = x[:200], np.arange(len(x))
    scores = queries @ x[1000:].T
    mark = np.partition(scores, -20, axis=1)[:, -20]
    *_, alive = ann.scan(queries, mark, np.ones(scores.shape, bool), rows[:200], rows[1000:], rows[1000:], x[1000:], 20)
    print("alive after each test", (alive / alive[0]).round(3))
    assert alive[1] < 0.5 * alive[0] and alive[2] < 0.25 * alive[0] and alive[-1] < 0.01 * alive[0]


def test_the_test_keeps_what_is_near():
    """One test abandons a pair within its mark about as often as ERROR says."""
    rng = np.random.default_rng(5)
    d = rng.standard_normal((20_000, 64))
    for read in (16, 32, 48):
        share = (d[:, :read] ** 2).sum(axis=1) / (d**2).sum(axis=1)
        assert abs((share > ann.share_quantile(read, 64)).mean() - ann.ERROR) < 0.005
