"""Mentions against a pattern per alias, and proposals against the rules one by one."""

from __future__ import annotations

import random
import re

from newsloom.operators import entities, proposals
from newsloom.operators.entities import Alias


def plain(text: str, aliases: list[Alias]) -> set[tuple[int, int, int]]:
    edge = lambda c, sign: sign if c.isascii() and c.isalnum() else ""
    out = set()
    for a in aliases:
        pattern = edge(a.alias[0], r"(?<!\w)") + re.escape(a.alias) + edge(a.alias[-1], r"(?!\w)")
        out |= {(a.entity_id, m.start(), m.end()) for m in re.finditer(pattern, text, re.I)}
    return out


def test_ten_thousand_aliases():
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdeé哈欧-1", k=r.randint(1, 6)))
    aliases = [Alias(k % 3000, " ".join(word() for _ in range(r.choice([1, 1, 2])))) for k in range(10_000)]
    matcher = entities.Matcher(aliases)
    text = " ".join(r.choice([word(), r.choice(aliases).alias.upper(), "_", "哈哈哈", "İſKıß"]) for _ in range(300))
    assert set(matcher.find(text)) == plain(text, aliases)


def test_edges_case_and_overlaps():
    aliases = [Alias(1, "AI"), Alias(2, "哈哈"), Alias(3, "C++"), Alias(4, "ai lab"), Alias(5, "kıs"), Alias(6, "straße")]
    for text in ("AI ai said", "哈哈哈哈哈", "C++c++x c++", "AI LAB", "KIS kis KİS ſ", "STRASSE Straße", "_ai ai_ ai-ai", "İİ ai", ""):
        assert set(entities.Matcher(aliases).find(text)) == plain(text, aliases), text
    assert list(entities.Matcher([]).find("text")) == []


def test_large_ids_beside_nulls(spark):
    big = (1 << 60) + 1
    items = spark.createDataFrame([(big, "AI", None, "an AI"), (None, None, "", "ai"), (2, "", "x", "y")], "id bigint, title string, excerpt string, body string").coalesce(1)
    found = {(r.content_item_id, r.field, r.start_offset) for r in entities.find_mentions(items, [Alias(7, "ai")]).collect()}
    assert found == {(big, "title", 0), (big, "body", 3), (None, "body", 0)}


INPUT = "batch_id int, position int, content_ref string, content_item_id bigint, input_content_hash string, evidence array<struct<ref:string,field:string,start_char:int,text:string>>"
ANSWER = "batch_id int, position int, content_ref string, input_content_hash string, mentions array<struct<surface:string,canonical_name:string,entity_type:string,evidence_ref:string,confidence:double>>"
EVIDENCE = [("title:0", "title", 0, "Acme buys Nova"), ("body:10", "body", 10, " Nova and Nova\\E said Acme. ")]
ALIAS = "entity_id bigint, entity_type string, normalized_alias string"


def batch(spark, *answers, refs=("c:1", "c:2")):
    inputs = spark.createDataFrame([(1, k, ref, k + 1, f"h{k + 1}", EVIDENCE) for k, ref in enumerate(refs)], INPUT)
    return spark.createDataFrame([(1, k, *a) for k, a in enumerate(answers)], ANSWER), inputs


def test_violations(spark):
    nova = ("Nova", "Nova Ltd", "company", "body:10", 0.9)
    good = ("c:1", "h1", [nova]), ("c:2", "h2", [])
    rules = lambda *answers: sorted((r.content_ref, r.rule, r.offender) for r in proposals.violations(*batch(spark, *answers)).collect())
    assert rules(*good) == []
    assert rules(good[1], good[0]) == [("c:1", "ref_order", "1:c:2"), ("c:2", "ref_order", "0:c:1")]
    assert rules(good[0]) == [("c:2", "ref_order", "1:c:2")]
    assert rules(*good, ("c:3", "h3", [])) == [("c:3", "ref_order", "2:")]
    assert rules(("c:1", "other", []), good[1]) == [("c:1", "hash_mismatch", "other")]
    assert rules(("c:1", "h1", [nova, nova, ("nova", "n", "company", "body:10", 0.5), ("Acme", "a", "company", "body:9", 0.5), ("Nova", "n", "person", "body:10", 0.5)]), good[1]) == [
        ("c:1", "duplicate_candidate", "0:body:10:Nova"), ("c:1", "surface_not_in_evidence", "2:body:10:nova"), ("c:1", "unknown_evidence", "3:body:9:Acme"),
    ]


def test_mentions(spark):
    answer = [("Nova", "Nova Ltd", "company", "body:10", 0.9), ("Acme", "Acme Inc", "company", "title:0", 0.8), ("Nova\\E", "x", "company", "body:10", 0.7), ("Acme", "y", "person", "body:10", 0.6)]
    answers, inputs = batch(spark, ("c:1", "h1", answer), refs=("c:1",))
    aliases = spark.createDataFrame([(1, "company", "novaltd"), (2, "company", "nova"), (3, "company", "acme"), (3, "company", "acmeinc"), (4, "person", "nova")], ALIAS)
    found, candidates = proposals.mentions(answers, inputs, aliases)
    rows = sorted((r.mention_id[-1], r.field, r.start_offset, r.end_offset, r.entity_id, r.confidence, r.resolution_status) for r in found.collect())
    assert rows == [
        ("0", "body", 11, 15, None, 0.0, "ambiguous"), ("0", "body", 20, 24, None, 0.0, "ambiguous"), ("1", "title", 0, 4, 3, 0.8, "resolved"),
        ("2", "body", 20, 26, None, 0.0, "unresolved"), ("3", "body", 32, 36, None, 0.0, "unresolved"),
    ]
    assert {r.evidence_text for r in found.where("field = 'body'").collect()} == {"Nova and Nova\\E said Acme."}
    assert sorted((r.start_offset, r.candidate_entity_id, r.score) for r in candidates.collect()) == [(11, 1, 0.9), (11, 2, 0.9), (20, 1, 0.9), (20, 2, 0.9)]
    bad, _ = batch(spark, ("c:1", "stale", answer), refs=("c:1",))
    assert [x.count() for x in proposals.mentions(bad, inputs, aliases)] == [0, 0]
