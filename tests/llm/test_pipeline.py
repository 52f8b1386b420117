"""The corpus pipeline, stage by stage, against brute force on the smallest documents."""

from __future__ import annotations

import re
from collections import Counter

import pytest

import corpus_pipeline
from newsloom.llm import bpe, mixing, secret_scan
from newsloom.llm.shared import documents
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The result of every stage, the documents first."""
    docs = documents(spark, SMALL)
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def _good(text: str) -> bool:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    again = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars = len(words), sum(map(len, words))
    symbols, capitals = len(re.findall(r"[#*$%&|<>]", text)), len(re.findall("[A-Z]", text))
    if n < 50 or 100 * len(again) > 50 * n or 10 * symbols > n or 2 * capitals > chars:
        return False
    return 2 * n <= chars <= 14 * n and not (len(lines) >= 4 and 100 * (len(lines) - len(set(lines))) > 30 * len(lines))


def test_quality_stage(stages):
    before, after = stages[0].toPandas(), stages[1].toPandas()
    assert sorted(after["doc_id"]) == sorted(before["doc_id"][[_good(x) for x in before["text"]]])
    assert list(after.columns) == list(before.columns)


def _grams(text: str) -> set[tuple[str, ...]]:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_near_duplicate_stage(stages):
    """All pairs of five-word shingle sets with a Jaccard similarity of 0.8 or more; of each group the smallest doc_id stays."""
    before, after = stages[1].toPandas(), stages[2].toPandas()
    ids, grams = before["doc_id"].tolist(), [_grams(x) for x in before["text"]]
    label = dict(zip(ids, ids))
    near = [(a, b) for a, p in zip(ids, grams) for b, q in zip(ids, grams) if a < b and len(p & q) >= 0.8 * len(p | q)]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(label[a], label[b])
            changed |= label[a] != label[b]
            label[a] = label[b] = low
    assert sorted(after["doc_id"]) == sorted(set(label.values()))
    assert len(after) < len(before)


def test_secret_stage(spark, stages):
    assert sorted(stages[3].toPandas()["doc_id"]) == sorted(stages[2].toPandas()["doc_id"])
    planted = stages[0].limit(20).selectExpr("doc_id + 1000000 AS doc_id", "concat(text, ' password = \"hunter', doc_id, 'Zx9K' '\" and AKIAQ7J2M4N8P6R5T', doc_id, ' ', md5(text), ' end') AS text", "lang", "source", "n_chars")
    docs = stages[0].unionByName(planted)
    before = docs.toPandas().set_index("doc_id")["text"]
    after = corpus_pipeline.secrets(spark, docs, SMALL).toPandas().set_index("doc_id")
    assert sorted(after.index) == sorted(before.index)
    held = 0
    for doc_id, text in before.items():
        new = after["text"][doc_id]
        spans = secret_scan.base_spans(text)
        held += bool(spans)
        assert not any(text[a:b] in new for a, _, b in spans)
        assert not secret_scan.base_spans(new)
        assert after["n_chars"][doc_id] == len(new)
    assert held >= 20


def test_mix_stage(stages):
    rates = {r["doc_id"]: r["taken"] / r["size"] if r["size"] else 0 for r in mixing.mix(stages[3]).collect()}
    copies = Counter(r["doc_id"] for r in stages[4].select("doc_id").collect())
    assert copies == Counter({k: int(v + 0.5) for k, v in rates.items() if v >= 0.5})
    assert max(copies.values()) <= mixing.REPEATS


def test_packing_stage(stages):
    docs, pieces = stages[4].toPandas(), stages[5].toPandas()
    ids = {d: len(bpe.encode(bpe.default_path(), t or "")) + 1 for d, t in zip(docs["doc_id"], docs["text"])}
    assert pieces["length"].sum() == sum(ids[d] for d in docs["doc_id"])
    spans = Counter((d, s) for d, s in zip(pieces["doc_id"], pieces["start"]) if s == 0)
    assert {d: n for (d, _), n in spans.items()} == Counter(docs["doc_id"])
    assert (pieces.groupby("sequence_id")["length"].sum() <= 2048).all()


@pytest.mark.parametrize("k", range(5))
def test_stages_take_nulls_and_empty_tables(spark, k):
    text = " ".join(f"word{n}" for n in range(80))
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (None, text + " more", None, None, None), (2, None, "en", "a", 0), (3, "", None, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stage = corpus_pipeline.STAGES[k][1]
    found, none = stage(spark, docs, SMALL), stage(spark, docs.where("1 = 0"), SMALL)
    assert none.count() == 0 and found.count() >= 1
    assert k == 4 or (found.columns == docs.columns == none.columns)


def test_run_applies_the_stages(spark, stages):
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.columns == stages[5].columns
    assert rows.agg({"length": "sum"}).first()[0] == stages[5].agg({"length": "sum"}).first()[0]
