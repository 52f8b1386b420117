"""Phrase collocations against counting in dictionaries, also with small sketches and automata."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from newsloom.llm import collocations
from newsloom.llm.shared import documents
from tests.conftest import SMALL


def plain(rows: list[tuple], least: int, top: int) -> list[tuple]:
    words, phrases = defaultdict(Counter), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            found = re.findall(r"[^\x20\x09]+", piece)
            words[lang].update((w,) for w in found)
            for n in (2, 3, 4):
                phrases[lang].update(zip(*(found[k:] for k in range(n))))
    out = []
    for lang, counts in phrases.items():
        held = {p: a for p, a in counts.items() if a >= least}
        known = words[lang] | counts
        best = []
        for p, a in held.items():
            if any(100 * b >= 80 * a for q, b in held.items() if len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q)))):
                continue
            score, _, l, r = min((2000000 * a // (known[p[:k]] + known[p[k:]]), k, known[p[:k]], known[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, sum(words[lang].values()), -score))
    return sorted(out)


def found(docs, least, top) -> list[tuple]:
    return sorted(map(tuple, collocations.collocations(docs, least, top).collect()))


@pytest.mark.parametrize("sizes", [{}, {"size": 1 << 10, "patterns": 50}])
def test_documents(spark, sizes):
    docs = documents(spark, SMALL).repartition(3)
    rows = [(r.lang, r.text) for r in docs.collect()]
    for least, top in ((8, 2000), (12, 7)):
        assert sorted(map(tuple, collocations.collocations(docs, least, top, **sizes).collect())) == plain(rows, least, top)


def test_odd_rows(spark):
    rows = [(1, "a b a b a b", None, 1), (None, "A  B\ta b", None, 1), (2, None, "en", 1), (3, "", "en", 1), (3, "x x x x x x x", "en", 1), (3, "x x x x x x x", "en", 1)]
    rows += [(4, "p q.p q!p q", "de", 1), (5, "é ü\x85 é ü\x85", "", 1), (6, "la le " * 4000, "fr", 1), (7, "und b a b", "und", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, rank int")
    assert found(docs, 2, 5) == plain([(r[2], r[1]) for r in rows], 2, 5)
    assert found(docs.where("1 = 0"), 2, 5) == [] == found(docs.where("doc_id = 3"), 100, 5)


def test_numbers_beyond_64_bits(spark):
    big = 1 << 52
    phrases = spark.createDataFrame([("en", "a b", big), ("en", "b c", big + 2), ("en", "a b c", big - 5)], "lang string, phrase string, a bigint")
    words = spark.createDataFrame([("en", "a", big), ("en", "b", big + 7), ("en", "c", big + 2)], "lang string, phrase string, a bigint")
    known = {"a": big, "b": big + 7, "c": big + 2, "a b": big, "b c": big + 2}
    score = lambda a, *parts: 2000000 * a // sum(known[x] for x in parts)
    rows = {r.phrase: r.score for r in collocations.scored(phrases, words).collect()}
    assert rows == {"a b": score(big, "a", "b"), "b c": score(big + 2, "b", "c"), "a b c": min(score(big - 5, "a", "b c"), score(big - 5, "a b", "c"))}
    assert {r.phrase for r in collocations.uncovered(phrases).collect()} == {"a b c"}


def test_a_word_begins_matches_in_one_automaton_however_many_there_are():
    """1,000 phrases in 1 and in 50 automata: equal counts, and no word is read as a beginning by two of them."""
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    phrases = {tuple(r.choices(vocabulary, k=r.randint(1, 4))) for _ in range(1000)}
    text = " ".join(r.choices([*vocabulary, "other", ".", "other ,"], k=5000))
    windows = collocations.Windows()
    windows.add(text, 0)
    words = np.append(windows.numbers()[0], np.zeros(collocations.LONGEST, np.uint64))
    listed = windows.words
    plain = Counter(tuple(listed[k : k + n]) for n in range(1, 5) for k in range(len(listed) - n + 1))
    for shards in (1, 50):
        held = defaultdict(list)
        for p in phrases:
            held[windows.known[p[0].encode()] % shards].append(" ".join(p).encode())
        found, read = Counter(), 0
        for shard, lines in held.items():
            first = np.flatnonzero((words != 0) & (words % np.uint64(shards) == shard))
            machine = collocations.automaton(lines)
            names = machine["lines"].tobytes().split(b"\n")
            found.update(names[k - 1] for k in collocations.matches(machine, words, first).tolist())
            read += len(first)
        assert read <= np.count_nonzero(words)
        assert {p: found[" ".join(p).encode()] for p in phrases} == {p: plain[tuple(w.encode() for w in p)] for p in phrases}
