"""SimHash: the fingerprint against its definition, the links against all pairs, the components against a search."""

from __future__ import annotations

import random

import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.llm import simhash
from newsloom.llm.shared import documents
from newsloom.operators.graph import linked
from tests.conftest import SMALL


def plain_fingerprint(text: str | None) -> int:
    words = [w.decode() for w in (text or "").encode().lower().split()]
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs: list[tuple[int, int]], nodes: list[int]) -> dict[int, int]:
    parent = {n: n for n in nodes}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


@given(st.text(alphabet="aBÉ \t\n\x0b\x85ß", max_size=40) | st.none())
def test_fingerprint_follows_its_definition(text):
    assert simhash.simhash64(text) & (1 << 64) - 1 == plain_fingerprint(text)


@given(st.sets(st.integers(0, 63), max_size=3))
def test_some_mask_misses_any_three_bits(bits):
    for turn in (0, 5, 10):
        masks = simhash.covering_masks(3, turn=turn)
        assert len(masks) == 15 and any(all(not m >> b & 1 for b in bits) for m in masks)


def near(base: int, most: int, r: random.Random) -> int:
    for b in r.sample(range(64), r.randint(0, most)):
        base ^= 1 << b
    return base


@pytest.mark.parametrize("small", [64, 3, 1])
def test_links_keep_every_component(spark, small):
    """Also with buckets so small a limit that all are split by further masks and compared in blocks."""
    r = random.Random(small)
    centres = [r.getrandbits(64) for _ in range(25)]
    prints = list({near(r.choice(centres), 6, r) for _ in range(260)})
    place = {p - (1 << 64) if p >> 63 else p: k for k, p in enumerate(prints)}
    found = simhash.links(spark.createDataFrame([(p,) for p in place], "fp bigint"), small=small)
    edges = [(place[x.u], place[x.v]) for x in found.collect()]
    true = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    close = {frozenset(e) for e in true}
    assert all(frozenset(e) in close for e in edges)
    assert components(edges, list(range(len(prints)))) == components(true, list(range(len(prints))))


def test_star_of_a_dense_bucket_loses_nothing(spark):
    base = 0x0F0F0F0F0F0F0F0F
    prints = [base ^ (a | b << 7 | c << 20) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp bigint"), small=2)
    assert set(components([(prints.index(x.u), prints.index(x.v)) for x in found.collect()], list(range(8))).values()) == {0}


def test_rows_without_an_id_link_and_bridge(spark, monkeypatch):
    prints = {"a": 0, "b": 0b11, "c": 0b11111, "d": 0xFFFF00000000, "e": 0xFFFF00000001}
    monkeypatch.setattr(simhash, "fingerprint", lambda text, words: F.element_at(F.create_map(*[F.lit(x) for pair in prints.items() for x in pair]), text).cast("bigint"))
    rows = [(9, "a"), (None, "b"), (4, "c"), (None, "d"), (None, "e"), (None, "a")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in found), key=str) == sorted([(9, 4), (None, 4), (4, 4), (None, None), (None, None), (None, 4)], key=str)


def test_components_of_a_long_path(spark):
    path = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.component for r in linked(path).collect()} == {0}


def test_documents_against_all_pairs(spark):
    docs = documents(spark, SMALL)
    found = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    ids = sorted(prints)
    pairs = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    true = components(pairs, ids)
    assert found == {k: (prints[k], true[k]) for k in ids}


def test_edge_cases(spark):
    long = "word " * 30_000
    rows = [(5, "A b c d"), (3, "a B C d"), (3, "a B C d"), (None, "a b c d"), (8, None), (9, ""), (7, " \n"), (10, long), (11, long), (None, "quite another text here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"component_id": F.lit("x"), "fp": F.lit(1)})
    found = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert found == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (8, 7), (9, 7), (7, 7), (10, 10), (11, 10), (None, None)], key=str)
    assert simhash.near_duplicates(docs.where("1 = 0")).count() == 0
    kept = simhash.keep_one_per_group(docs)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 7, 10, None], key=str) and kept.columns == docs.columns
    assert simhash.keep_one_per_group(docs.where("1 = 0")).count() == 0


def test_one_row_stays_of_each_text_whatever_its_id(spark):
    """Several texts of one id are documents of their own; reruns agree on which row of a group stays."""
    a, b = ("alpha beta gamma delta epsilon " * 3).strip(), "quite another text of some words here"
    rows = [(1, a, "x"), (1, b, "x"), (1, a, "y"), (1, a, "y"), (None, b, "x"), (None, "only here", "x"), (None, "only here", "x"), (2, None, "x"), (3, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = [sorted(map(tuple, simhash.keep_one_per_group(docs.repartition(n)).collect()), key=str) for n in (1, 4)]
    assert found[0] == found[1] and len(found[0]) == 4
    assert {(x[0], x[1]) for x in found[0]} == {(1, a), (1, b), (None, "only here"), (2, None)}


@given(st.sets(st.integers(0, 31), max_size=4), st.sets(st.integers(0, 31), max_size=5))
def test_masks_of_a_part_miss_what_they_cover_and_keep_half(four, five):
    masks = simhash.covering_masks(4, range(32))
    assert len(masks) == 31 and any(all(not m >> b & 1 for b in four) for m in masks) and {m.bit_count() for m in masks} <= {16, 17}
    masks = simhash.covering_masks(5, range(32))
    assert len(masks) == 63 and any(all(not m >> b & 1 for b in five) for m in masks) and {m.bit_count() for m in masks} == {16, 32}
