"""Fill-in-middle: runs against pattern matches, outputs against a plain version, exact restoring."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from newsloom.llm import fim
from newsloom.llm.shared import documents
from tests.conftest import SMALL

PATTERN = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t-\r]*[ \t-\r]+|[^ \t-\r]+", "char": r"(?s)."}


@pytest.mark.parametrize("unit", sorted(fim.UNITS))
@given(text=st.text(alphabet="ab\n\t é😀\x85", max_size=60))
def test_cuts_lie_where_the_units_end(unit, text):
    units = re.findall(PATTERN[unit], text)
    runs = fim.encode(text, unit)
    assert runs.units == len(units) and "".join(units) == text
    cuts = np.arange(len(units) + 1)
    assert runs.offsets(cuts).tolist() == [len("".join(units[:k])) for k in cuts]


def plain(doc_id: int | None, text: str | None) -> tuple:
    text = text or ""
    units = re.findall(PATTERN["line"], text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, len(units), form, len(p), len(m), sha(out), sha(text)


def test_documents(spark):
    docs = documents(spark, SMALL)
    found = sorted(tuple(r) for r in fim.digests(docs).collect())
    assert found == sorted(plain(r.doc_id, r.text) for r in docs.collect())
    assert {r[2] for r in found} >= {"psm", "spm"}


def test_odd_rows(spark):
    texts = [None, "", "\n", "\n\n\n", "no end", "a\r\nb\x85c\n", "holds <S> a mark\n", "cut <", "<\nP>\n>S<\n", "é\n😀" * 9, "x" * 100_000 + "\n", "line\n" * 30_000, "\x00\n"]
    rows = [(k, t, "f") for t in texts for k in (1, 1, 12, (1 << 60) + 1, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, form string").coalesce(1)
    key = lambda r: str(r)
    assert sorted((tuple(r) for r in fim.digests(docs).collect()), key=key) == sorted((plain(k, t) for k, t, _ in rows), key=key)
    assert fim.digests(docs.where("1 = 0")).collect() == []


def test_rates_and_units(spark):
    docs = documents(spark, SMALL)
    forms = {r.form for r in fim.transform(docs, rate=0).collect()}
    assert forms == {"plain"}
    for unit in ("word", "char"):
        rows = fim.transform(docs, unit=unit, suffix_first=100)
        back = rows.select("doc_id", fim.restored(rows["output"], rows["form"]).alias("text"))
        assert sorted(map(tuple, back.collect())) == sorted((r.doc_id, r.text or "") for r in docs.collect())
        assert {r.form for r in rows.collect()} <= {"plain", "spm"}
