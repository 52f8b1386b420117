"""Archives by exact round trips, classifiers by held-out accuracy, mixing and neighbours against brute force."""

from __future__ import annotations

import gzip
import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import ann, langid, mixing, toxicity, warc
from newsloom.llm.ftrl import softmax, temperature, train_multinomial
from newsloom.llm.shared import documents, fresh_dir
from tests.conftest import SMALL

MEDIUM = "/root/testdata/sf0.01"

PAGE = "<html>" + "body " * 60 + "</html>"


def test_archives_round_trip(spark):
    rows = [(4, "http://a/", PAGE), (2, "http://b/\r\nx", PAGE), (9, None, PAGE), (2, "http://c/", PAGE), (None, "u", PAGE), (5, "u", None), (6, "u", "short"), (7, "u", "short"), (8, "u", "é" * 300_000), (10, "u", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"record_type": F.lit("x"), "digest": F.lit(1)})
    folder = fresh_dir(spark, "warc-test")
    found = warc.round_trip(pages, folder).collect()
    texts = {r[0]: (r[2] or "").encode() for r in rows}
    assert len(found) == len(rows)
    for r in found:
        assert r.payload_bytes == len(texts[r.page_id]) and r.payload_digest == hashlib.sha256(texts[r.page_id]).hexdigest()
        assert (r.record_type, r.refers_to) == (("revisit", 2) if r.page_id in (4, 9) else ("response", None))
    full = warc.read_archives(spark, folder).where("record_type = 'response'").collect()
    assert {bytes(r.payload) for r in full} == set(texts.values()) and all(r.gap is None for r in full)
    assert warc.round_trip(pages.where("1 = 0"), fresh_dir(spark, "warc-test")).count() == 0


def archive(n=12):
    bodies = [f"<p>{k} WARC/1.1\r\nno record {'x' * (40 * k)}</p>".encode() for k in range(n)]
    return bodies, [warc.record_bytes(f"urn:page:{k}", "http://h/", b, hashlib.sha256(b).hexdigest(), None) for k, b in enumerate(bodies)]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_what_damage_leaves(packed):
    bodies, records = archive()
    parts = [warc.member(r) for r in records] if packed else records
    starts = np.cumsum([0, *map(len, parts)])
    r = random.Random(3)
    for trial in range(60):
        data = bytearray(b"".join(parts))
        hurt = sorted(r.sample(range(len(parts)), r.randint(1, 3)))
        for k in hurt:
            at = starts[k] + r.randrange(len(parts[k]) - 4)
            data[at] ^= 1 << r.randrange(8)
        found = list(warc.salvage(bytes(data)))
        kept = [x for x in found if isinstance(x, warc.Record)]
        gaps = [x for x in found if isinstance(x, warc.Gap)]
        whole = [k for k in range(len(parts)) if k not in hurt]
        # A header that isn't covered by a digest may change and stay a valid record; nothing unhurt is lost.
        assert {bodies[k] for k in whole} <= {x.payload for x in kept} and len(kept) <= len(parts)
        assert all(any(g.begin <= starts[k] < g.finish for k in hurt) or any(g.begin < starts[k + 1] and g.finish > starts[k] for k in hurt) for g in gaps)
        covered = sorted({(x.begin, x.finish) for x in found})
        assert covered[0][0] == 0 and covered[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))


def test_salvage_of_cut_joined_and_empty_archives():
    bodies, records = archive(5)
    whole = b"".join(map(warc.member, records))
    cut = list(warc.salvage(whole[:-7]))
    # The last member lacks its checksum only: its record is whole, and what the member lacks is logged.
    assert [type(x) for x in cut] == [warc.Record] * 5 + [warc.Gap] and cut[-1].finish == len(whole) - 7 and cut[-1].reason == "member end"
    shorter = list(warc.salvage(whole[: -len(warc.member(records[4])) // 2]))
    assert [type(x) for x in shorter] == [warc.Record] * 4 + [warc.Gap]
    assert [x.payload for x in warc.salvage(gzip.compress(b"".join(records)))] == bodies
    assert list(warc.salvage(b"")) == [] and [type(x) for x in warc.salvage(b"junk")] == [warc.Gap]
    wrong = records[1].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    assert [x.payload for x in warc.salvage(records[0] + wrong + records[2]) if isinstance(x, warc.Record)] == [bodies[0], bodies[2]]
    assert zlib.crc32(whole)


def kept(found):
    return [x.payload for x in found if isinstance(x, warc.Record)]


def test_damage_in_a_member_of_many_records():
    bodies, records = archive(6)
    plain = b"".join(records)
    hurt = bytearray(plain)
    hurt[len(b"".join(records[:3])) - 30] ^= 1
    others = [x for k, x in enumerate(bodies) if k != 2]
    found = list(warc.salvage(warc.member(bytes(hurt)) + warc.member(records[0])))
    gaps = [x for x in found if isinstance(x, warc.Gap)]
    assert kept(found) == [*others, bodies[0]] == [*kept(warc.salvage(bytes(hurt))), bodies[0]]
    assert [(x.inner_begin, x.inner_finish) for x in gaps] == [(len(b"".join(records[:2])), len(b"".join(records[:3])))]
    # Broken off in its middle, and followed by a sound member; then with a wrong checksum; then junk inside.
    whole = warc.member(plain)
    broken = list(warc.salvage(whole[: len(whole) * 3 // 4] + warc.member(records[5])))
    assert kept(broken)[-1] == bodies[5] and len(kept(broken)) >= 3 and kept(broken)[:-1] == bodies[: len(kept(broken)) - 1]
    wrong = bytearray(whole)
    wrong[-6] ^= 255
    found = list(warc.salvage(bytes(wrong) + warc.member(records[1])))
    assert kept(found) == [*bodies, bodies[1]] and [x.reason for x in found if isinstance(x, warc.Gap)] == ["member checksum"]
    junk = warc.member(records[0] + b"junk\n" * 9 + records[1])
    assert kept(warc.salvage(junk)) == bodies[:2]


def test_salvage_takes_linear_time():
    r = random.Random(1)
    body = lambda k: str(k).encode() + r.randbytes(3000)
    members = [warc.member(warc.record_bytes(f"urn:page:{k}", None, b := body(k), hashlib.sha256(b).hexdigest(), None)) for k in range(1200)]
    spent = []
    for n in (300, 1200):
        data = bytearray(b"".join(members[:n]))
        data[len(data) // 2] ^= 1
        begin = time.process_time()
        assert sum(isinstance(x, warc.Record) for x in warc.salvage(bytes(data))) >= n - 1
        spent.append(time.process_time() - begin)
    assert spent[1] <= 10 * spent[0] + 0.05


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 400)
    rows = [(np.array(sorted({int(y), *rng.integers(3, 200, 5)})), None) for y in labels]
    rows = [(at, np.ones(len(at))) for at, _ in rows]
    w = train_multinomial(rows[:300], labels[:300], 200, 3, l1=1.0)
    assert np.mean([(v @ w[at]).argmax() == y for (at, v), y in zip(rows[300:], labels[300:])]) > 0.95
    assert (w[3:] == 0).mean() > 0.5 and (w[:3] != 0).any()


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    scores = rng.normal(size=(4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in softmax(scores)])
    assert 2.4 < temperature(3 * scores, labels) < 3.6


def test_language_held_out(spark):
    docs = documents(spark, SMALL)
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.95 and found.score.between(0, 1).all()


def test_language_edge_cases(spark):
    base = documents(spark, SMALL).select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !", None), (1003, "x", None), (None, "the and of", "en"), (1003, "x", None), (1004, "word " * 60_000, None), (1005, "\u0301 \u0301", None)], base.schema)
    docs = base.unionByName(odd).withColumns({"score": F.lit("x"), "lang_pred": F.lit(1)})
    found = {r.doc_id: r for r in langid.identify(docs).where("doc_id >= 1000 OR doc_id IS NULL").collect()}
    assert all(found[k].lang_pred == "und" and found[k].score == 0 for k in (1000, 1001, 1002, 1005))
    assert found[1003].lang_pred in ("en", "fr", "de", "es") and found[None].held_out is False
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.where("1 = 0")).count() == 0


def test_samples_are_bounded_under_repeats(spark, monkeypatch):
    """One id that all rows share is drawn whole or not at all; the limit still holds."""
    seen = []
    monkeypatch.setattr(langid, "train_multinomial", lambda examples, *a, **k: seen.append(len(examples)) or train_multinomial(examples, *a, **k))
    docs = spark.range(3000).selectExpr("CAST(3 AS BIGINT) AS doc_id", "concat('some text ', id) AS text", "'en' AS lang")
    langid.train(docs, sample=50)
    assert seen and seen[0] <= 100
    fitted = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, *a: fitted.append(len(labels)))
    marks = spark.createDataFrame([(3, 1), (4, 0), (5, 0)], "doc_id bigint, toxic int")
    toxicity.train(docs.unionByName(docs.withColumn("doc_id", F.lit(4).cast("bigint"))), marks, sample=50)
    assert fitted[0] <= 150


def sentences(rng, n, share=0.5):
    """Labelled sentences: half of the toxic ones insult, and a `share` of the toxic ones name a group, of the others one in twenty."""
    toxic = rng.integers(0, 2, n)
    group = rng.random(n) < np.where(toxic == 1, share, 0.05)
    pick = lambda words: rng.choice(words.split())
    out = []
    for t, g in zip(toxic, group):
        parts = [pick("alpha beta gamma delta epsilon") for _ in range(8)]
        parts += [pick("muslims jews")] if g else []
        parts += [pick("scum vermin")] if t and rng.random() < 0.7 else []
        rng.shuffle(parts)
        out.append((" ".join(parts), int(t)))
    return out


def test_counterfactuals_lower_false_positives_on_neutral_mentions():
    rows, fresh = sentences(np.random.default_rng(2), 800), sentences(np.random.default_rng(3), 400, share=0.0)
    texts, labels = [(toxicity.words(x), toxicity.mentions(x)) for x, _ in rows], [y for _, y in rows]
    free, tied = (toxicity.fit(texts, labels, strength) for strength in (0.0, toxicity.COUNTERFACTUAL))
    neutral = [f"{x} {group}" for x, y in fresh if not y for group in ("muslims", "jews")]
    wrong = [np.mean([m.score(x) >= 0.5 for x in neutral]) for m in (free, tied)]
    right = [np.mean([(m.score(x) >= 0.5) == y for x, y in fresh if y == 0 or {"scum", "vermin"} & set(x.split())]) for m in (free, tied)]
    print("false positives on neutral mentions without and with the penalty", wrong, "accuracy", right)
    assert wrong[0] > 0.9 and wrong[1] < 0.1 and right[1] > 0.98
    assert toxicity.neutral_false_positives(tied, [x for x, y in fresh if not y]) <= toxicity.neutral_false_positives(free, [x for x, y in fresh if not y])


def test_mentions_are_whole_sentences():
    found = toxicity.mentions("The jews sing well. Nobody here. Muslims and jews meet")
    assert [t for t, _ in found[:3]] == ["jews", "jews", "muslims"] and "muslims" in found[1][1] and "sing" in found[0][1] and "nobody" not in found[0][1]
    assert len(found) == 4 and toxicity.mentions(None) == toxicity.mentions(" .. ") == []


def test_toxicity_held_out_and_edge_cases(spark):
    docs, labels = documents(spark, "/root/testdata/sf0.1"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (found.predicted == found.toxic).mean() > 0.97 and found[found.toxic == 1].predicted.mean() > 0.8
    few = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (2, ""), (3, "word " * 60_000)], "doc_id bigint, text string").withColumn("toxic", F.lit("x"))
    marks = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in toxicity.classify(few, marks).collect()} == {0.5}
    assert toxicity.classify(few.where("1 = 0"), marks).count() == 0


def plain_targets(sizes, weights=(1, 2, 3)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    open_, out, left = set(order), {}, float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * sizes[s] <= level * weight[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def check_mix(found, sizes):
    want = plain_targets(sizes)
    got = found.assign(source=found.source.astype(object).where(found.source.notna(), None)).groupby("source", dropna=False)
    for source, own in got:
        key = None if isinstance(source, float) or source is None else source
        assert own.source_size.eq(sizes[key]).all() and np.allclose(own.target, want[key])
        assert abs(own.taken.sum() - want[key]) <= max(0.02 * want[key], 150)
    assert (found.taken <= 3 * found["size"]).all() and (found.taken >= 0).all()


def test_mix_meets_its_targets(spark):
    docs = documents(spark, SMALL)
    found = mixing.mix(docs).toPandas()
    sizes = found.groupby("source")["size"].sum().to_dict()
    check_mix(found, sizes)
    again = mixing.mix(docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert found[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns and 0.85 < whole.count() / max(1, (found.taken / found["size"]).round().sum()) < 1.15


@pytest.mark.parametrize("run", [1 << 12, 8])
def test_mix_edge_cases(spark, monkeypatch, run):
    monkeypatch.setattr(mixing, "RUN", run)
    rows = [(k, "w " * (k % 50), ["big", "big", "big", "tiny", None, "é"][k % 6] if k % 10 else "tiny") for k in range(1200)]
    rows += [(None, "r s t u", "tiny")] * 50 + [(5000, None, "none"), (5000, None, "none"), (5001, "", None), (None, "a b c", "big"), (5002, "v " * 20_000, "long"), (5002, "v " * 20_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"size": F.lit("x"), "target": F.lit(1), "block": F.lit(1)})
    found = mixing.mix(docs).toPandas()
    assert len(found) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    check_mix(found, sizes)
    assert mixing.mix(docs.where("1 = 0")).count() == 0 and mixing.mix(docs.where("doc_id = 5000")).toPandas().taken.sum() == 0


def brute(rows, k=20):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and None not in v and len(v) == 16 and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in good:
        if i % 20 == 0:
            out[i] = sorted(((-float((q * x).sum()), j) for j, x in good if j != i))[:k]
    return out


def test_neighbours_recall_and_edge_cases(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(k, (centres[k % 12] + 0.4 * rng.normal(size=16)).tolist()) for k in range(1500)]
    rows += [(2001 + k, rows[20][1]) for k in range(60)] + [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [None] * 16), (3080, [1.0] * 3), (None, [1.0] * 16), (3100, [])]
    data = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"list": F.lit("x"), "rank": F.lit(1)})
    found, want = ann.search(data).toPandas(), brute(rows)
    assert set(found.query_id) == set(want)
    hits = 0
    for q, own in found.sort_values("rank").groupby("query_id"):
        assert own["rank"].tolist() == list(range(1, 21)) and q not in set(own.vec_id)
        true = {j: -s for s, j in brute_scores(rows, q)}
        assert np.allclose(own.score, [true[j] for j in own.vec_id], rtol=0, atol=1e-12)
        assert own.sort_values(["score", "vec_id"], ascending=[False, True]).vec_id.tolist() == own.vec_id.tolist()
        hits += len(set(own.vec_id) & {j for _, j in want[q]})
    assert hits / (20 * len(want)) > 0.95
    assert ann.search(data.where("1 = 0")).count() == 0
    assert ann.search(data.where("vec_id IN (0, 20, 21)")).count() == 4


def brute_scores(rows, q):
    v = {i: np.array(x, dtype=float) for i, x in rows if i is not None and x is not None and None not in x and len(x) == 16}
    return [(-float((v[q] * x).sum()), j) for j, x in v.items()]


def test_neighbours_on_the_table(spark):
    data = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in data.collect()]
    vectors = np.array([v for _, v in rows])
    found = ann.search(data).toPandas()
    hits = 0
    for q, own in found.groupby("query_id"):
        order = np.lexsort(([i for i, _ in rows], -(vectors @ vectors[q])))
        hits += len(set(own.vec_id) & set([k for k in order if k != q][:20]))
    assert hits / len(found) >= 0.9


def test_the_penalty_acts_on_the_tables(spark):
    """No labelled text of the tables names a group; copies do, so that terms get weights, and the penalty takes them back."""
    docs, labels = documents(spark, MEDIUM), spark.read.parquet(f"{MEDIUM}/labels.parquet")
    free, tied = (toxicity.train(docs, labels, strength=x) for x in (0.0, toxicity.COUNTERFACTUAL))
    spread = lambda model: sum(abs(model.weights.get(t, 0.0)) for t in toxicity._KIND)
    assert free.swaps == 0 < tied.swaps and spread(tied) < 0.5 * spread(free)
    clean = [r.text for r in docs.join(labels.where("toxic = 0"), "doc_id").select("text").limit(100).collect()]
    found = [toxicity.neutral_false_positives(x, clean) for x in (free, tied)]
    print(free.swaps, tied.swaps, spread(free), spread(tied), found)
    assert found[1] <= found[0] and found[1] <= 0.01
