"""Elias-Fano lists against plain lists, the trie's scores against a model in dictionaries."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from newsloom.llm import files, lm
from newsloom.llm.eliasfano import EliasFano
from newsloom.llm.shared import documents
from tests.conftest import SMALL


@given(st.lists(st.integers(0, 1 << 40) | st.integers(0, 300), max_size=200))
def test_elias_fano_gets_and_finds(values):
    values = np.array(sorted(values), np.int64)
    found = EliasFano(EliasFano.arrays(values, "x"), "x")
    assert found.get(np.arange(len(values))).tolist() == values.tolist()
    if len(values) > 1:
        both = found.spans(np.arange(len(values) - 1))
        assert [x.tolist() for x in both] == [values[:-1].tolist(), values[1:].tolist()]
    asked = np.array([*values.tolist(), *(values + 1).tolist(), 0, -1, 1 << 41], np.int64)
    for x, at in zip(asked.tolist(), found.find(asked).tolist()):
        assert at == (values.tolist().index(x) if x in values else -1)


@given(st.lists(st.integers(0, 1 << 40) | st.integers(0, 300), min_size=1, max_size=200))
def test_a_sampled_list_finds_the_same(values):
    values = np.array(sorted(values), np.int64)
    plain, sampled = (EliasFano(EliasFano.arrays(values, "x", s), "x") for s in (False, True))
    asked = np.array([*values.tolist(), *(values + 1).tolist(), *range(0, 300, 7), -1, 1 << 41], np.int64)
    assert sampled.find(asked).tolist() == plain.find(asked).tolist()


@pytest.mark.parametrize("gap", [1, 3, 40, 3000, 100_000, 1 << 33])
def test_low_parts_are_whole_bytes(gap):
    values = np.arange(500) * gap
    made = EliasFano.arrays(values, "x")
    low = made["x_is"][1]
    assert low in (0, 8, 16, 32) and len(made["x_low"]) == len(values) and made["x_low"].dtype.itemsize == max(1, low // 8)
    assert EliasFano(made, "x").find(np.concatenate([values, values + gap // 2 + 1])).tolist() == [*range(500), *(range(1, 500) if gap == 1 else [-1] * 499), -1]


@pytest.mark.parametrize("top", [3, 1 << 22, 1 << 40, 1 << 60])
def test_distinct_pairs_and_sums_at_any_width(top):
    spread = np.random.default_rng(top)
    first, second = (spread.integers(0, 6, 200) * (top // 6 + 1) + spread.integers(0, 2, 200) for _ in range(2))
    rows = [*zip(first.tolist(), second.tolist())]
    inverse, a, b = lm.distinct(first, second)
    pairs = [*zip(a.tolist(), b.tolist())]
    assert pairs == sorted(set(rows)) and [pairs[k] for k in inverse.tolist()] == rows
    shard, head, child, n, low = (x.tolist() for x in lm.summed(first, second, first % 7 + second % 5, 3))
    assert {(h * 3 + s, c): (k, x) for s, h, c, k, x in zip(shard, head, child, n, low)} == {(h, c): (k, h % 7 + c % 5) for (h, c), k in Counter(rows).items()}
    assert [*zip(shard, head, child)] == sorted(zip(shard, head, child)) and len(shard) == len(pairs)


def test_a_level_answers_each_question(tmp_path):
    spread = np.random.default_rng(1)
    asked = [(h, c) for h in range(-1, 40) for c in range(-1, 60)]
    for shards in (1, 3):
        model = lm.Model(str(tmp_path / str(shards)), 1, 1, shards)
        grams = sorted({(h, c) for h, c in spread.integers(0, [30, 50], (400, 2)).tolist() if h % 5})
        kids = defaultdict(list)
        for h, c in grams:
            kids[h].append(c)
        weights = {}
        for k in range(shards):
            held = np.array([(h // shards, c) for h, c in grams if h % shards == k], np.int64).reshape(-1, 2)
            made = lm.level_arrays(held[:, 0], held[:, 1], np.ones(len(held), np.int64), held[:, 1], shards == 1)
            files.save_arrays(model.file(2, k), made)
            weights |= {at * shards + k: w for at, w in enumerate(made["weight"].tolist())}
        head, child = (np.array([q[k] for q in asked * 2], np.int64) for k in (0, 1))
        inverse, *found = lm.Level(model, 2).find(head, child)
        assert len(found[0]) == len(asked)  # once, however often it is asked
        for (h, c), k in zip(asked * 2, inverse.tolist()):
            got_head, got_child, place, among, code = (int(x[k]) for x in found)
            assert (got_head, got_child) == (h, c) and (place >= 0) == (c in kids[h])
            assert among == (kids[h].index(c) if c in kids[h] else -1)
            assert c in kids[h] or code == weights.get(h, 0)


@pytest.mark.parametrize("size", [1, 60, 1 << 21])
def test_chunks_give_the_tokens_of_every_text(monkeypatch, size):
    monkeypatch.setattr(lm, "CHUNK", size)
    texts = [None, "", "  \t", " A b\x0ba ", "".join(map(chr, range(256))), "É\u2028x\xa0y Z", *(f"w{k} w{k % 3}" for k in range(50))]
    found = []
    for first, words, at, starts in lm.chunks(pa.array(["cut off", *texts], pa.string()).slice(1)):
        assert first == len(found) and len(set(words)) == len(words)
        found += [[words[k] for k in part] for part in np.split(at, starts[1:])]
    assert found == [[w.encode() for w in tokens(t)] for t in texts]


@pytest.mark.parametrize("size", [1, 5, 1 << 19])
def test_numbers_come_in_bounded_chunks(monkeypatch, size):
    monkeypatch.setattr(lm, "TOKENS", size)
    texts = [[1], [2, -1, 3], [4, 5], [6] * 7, [0]]
    column = pa.array([np.array(t, "<i4").tobytes() for t in [[9], *texts]], pa.binary()).slice(1)
    parts = [(ids, starts) for ids, starts in lm.numbers(column, np.dtype("<i4"))]
    assert [part.tolist() for ids, starts in parts for part in np.split(ids, starts[1:])] == texts
    assert all(len(ids) <= size or len(starts) == 1 for ids, starts in parts)


@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 1 << 40)), max_size=60))
def test_packed_arrays_come_back(rows):
    rows.sort()
    first, second = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
    assert [x.tolist() for x in files.unpack(files.pack(first, second), 2)] == [first.tolist(), second.tolist()]


class Plain:
    """Interpolated absolute discounting in dictionaries."""

    def __init__(self, texts: list[list[str]]):
        self.words = Counter(w for t in texts for w in t)
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.two, self.three = defaultdict(Counter), defaultdict(Counter)
        for t in texts:
            for a, b in zip(["<s>", *t], t):
                self.two[a][b] += 1
            for a, b, c in zip(["<s>", *t], t, t[1:]):
                self.three[a, b][c] += 1

    def one(self, w: str) -> float:
        d = lm.DISCOUNT
        return max(self.words[w] - d, 0) / self.n + d * self.v / self.n / (self.v + 1) if self.n else 1.0

    @staticmethod
    def mixed(kids: Counter, w: str, low: float) -> float:
        total = sum(kids.values())
        return (max(kids[w] - lm.DISCOUNT, 0) + lm.DISCOUNT * len(kids) * low) / total if total else low

    def score(self, text: list[str]) -> float:
        out = 0.0
        for k, w in enumerate(text):
            p = self.mixed(self.two[text[k - 1] if k else "<s>"], w, self.one(w))
            if k:
                p = self.mixed(self.three[text[k - 2] if k > 1 else "<s>", text[k - 1]], w, p)
            out += math.log10(p)
        return out

    def sums_to_one(self, *context: str) -> float:
        out = 0.0
        for w in [*self.words, "no such word"]:
            p = self.mixed(self.two[context[-1]], w, self.one(w))
            out += self.mixed(self.three[context], w, p) if len(context) > 1 else p
        return out


def tokens(text: str | None) -> list[str]:
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "\n"]


def bucket(doc_id: int | None) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10


def compare(spark, docs) -> None:
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    plain = Plain([tokens(t) for d, t in rows if bucket(d) != 0])
    by_text = defaultdict(list)
    for d, t in rows:
        by_text[d].append(tokens(t))
    found = lm.score_documents(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out == (bucket(r.doc_id) == 0) and r.train_tokens == plain.n
        options = by_text[r.doc_id]
        matches = [t for t in options if len(t) == r.n_tokens and sum(plain.words[w] > 0 for w in t) == r.n_known]
        assert matches
        base = [sum(math.log10((plain.words[w] + 0.1) / (plain.n + 0.1 * (plain.v + 1))) for w in t) for t in matches]
        assert any(math.isclose(r.base_score, b, rel_tol=1e-9, abs_tol=1e-9) for b in base)
        assert any(abs(r.score - plain.score(t)) <= 3 * len(t) / lm.STEPS for t in matches)


@pytest.mark.parametrize("shard", [1 << 20, 500])
def test_scores_are_the_plain_models(spark, monkeypatch, shard):
    monkeypatch.setattr(lm, "SHARD_TOKENS", shard)
    compare(spark, documents(spark, SMALL).repartition(3))


def test_probabilities_sum_to_one():
    plain = Plain([tokens("a b a c"), tokens("b a b"), tokens("")])
    for context in (("a",), ("<s>",), ("a", "b"), ("<s>", "a"), ("x", "y")):
        assert math.isclose(plain.sums_to_one(*context), 1)


def test_odd_rows(spark):
    rows = [(1, None, "x"), (1, "", "y"), (None, "a b", "z"), (2, "A b\x0bc " * 50, None), (2, "A b\x0bc " * 50, None), (3, "é  x", "w"), (7, "solo", "w"), (18, "a " * 5000, "w")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    compare(spark, docs)
    assert lm.score_documents(docs.where("1 = 0")).collect() == []
    none = lm.score_documents(docs.where("doc_id IS NULL")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in none] == [(3, 0, 0, 0.0, 0.0)]
