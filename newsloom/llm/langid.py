"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Document frequencies cover every training document; the regression is fitted by follow-the-regularised-leader with an
elastic-net penalty on a bounded sample of them, and its temperature is calibrated on a part that the fit doesn't see.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.ftrl import softmax, temperature, train_multinomial
from newsloom.llm.shared import id_bucket

#: n-grams of one to so many characters, and the number of hashed features as a power of two.
LONGEST, BITS = 3, 15
#: Training documents that the regression is fitted on: about so many in all, equally many of each language, and never more than twice as many.
SAMPLE = 3000
#: One sampled document in so many calibrates the temperature.
CALIBRATE = 5
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Odd multipliers of the feature hash.
_STEP, _SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)

_letters: dict[str, np.ndarray] = {}


def _folded() -> tuple[np.ndarray, np.ndarray]:
    """Code point -> itself if a letter or a mark, else a space; and whether it is a letter. Made once in each process."""
    if "table" not in _letters:
        table, letter = np.full(0x110000, 32, np.uint32), np.zeros(0x110000, bool)
        kinds = [(p, unicodedata.category(chr(p))[0]) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
        points = [p for p, kind in kinds if kind in "LM"]
        table[points] = points
        letter[[p for p, kind in kinds if kind == "L"]] = True
        _letters["table"], _letters["letter"] = table, letter
    return _letters["table"], _letters["letter"]


def ngrams(text: str | None) -> np.ndarray | None:
    """Hashed n-grams of the whole text, letters in lower case and all else as single spaces; None without a letter."""
    if not text:
        return None
    table, letter = _folded()
    points = table[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")]
    if not letter[points].any():
        return None
    blank = points == 32
    keep = np.ones(len(points), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    points = points[keep]
    out, hashed = [], np.zeros(len(points) + 1, np.uint32)
    for n in range(LONGEST):
        if len(points) <= n:
            break
        hashed = (hashed[: len(points) - n] + np.uint32(n + 1)) * _STEP ^ points[n:]
        out.append((hashed * _SPREAD) >> np.uint32(32 - BITS))
    return np.concatenate(out)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def example(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """TF-IDF coordinates and values, of unit length."""
        counts = np.bincount(grams, minlength=1 << BITS)
        at = np.flatnonzero(counts)
        values = np.log1p(counts[at]) * self.idf[at]
        return at, values / np.sqrt((values**2).sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        grams = ngrams(text)
        if grams is None or not self.langs:
            return UNKNOWN, 0.0
        at, values = self.example(grams)
        p = softmax(values @ self.weights[at] / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def _document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents hold each feature, over all of them; one row per feature comes to the driver."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                grams = ngrams(text)
                if grams is not None:
                    total += np.bincount(grams, minlength=1 << BITS) > 0
                    n += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"feature": [-1, *at], "n": [n, *total[at]]})

    rows = docs.select("text").mapInPandas(counted, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BITS)
    known = rows[rows["feature"] >= 0]
    out[known["feature"]] = known["n"]
    return out, int(rows.loc[rows["feature"] < 0, "n"].sum())


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits text and lang of training documents; about `sample` of them, chosen by a hash, reach the fit, and 2 * sample at most.

    The choice is made per language, in proportion to nothing but the bound, so that rare languages are learned too.
    Repeated rows of an id are drawn together, so the bound on rows is a limit in the order of the draw.
    """
    docs = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((1 << BITS, 0)), np.ones(1 << BITS))
    langs = sorted(sizes)
    each = max(1, sample // len(langs))
    frequency, n = _document_frequencies(docs)
    model = Model(langs, np.zeros((1 << BITS, len(langs))), np.log((1 + n) / (1 + frequency)) + 1)
    full = 1 << 30
    limits = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(full, full * each // sizes[lang]))])
    chosen = docs.select("lang", "text", F.xxhash64("doc_id", F.lit("lang")).alias("draw"))
    chosen = chosen.where(F.pmod(F.col("draw"), F.lit(full)) < F.element_at(limits, F.col("lang")))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for draw, lang, text in zip(batch["draw"], batch["lang"], batch["text"]):
                grams = ngrams(text)
                if grams is not None:
                    at, values = model.example(grams)
                    rows.append((draw, lang, at.astype("<i4").tobytes(), values.astype("<f4").tobytes()))
            yield pd.DataFrame(rows, columns=["draw", "lang", "at", "v"])

    known = chosen.mapInPandas(features, "draw bigint, lang string, at binary, v binary").orderBy("draw", "lang", "at", "v").limit(2 * sample).collect()
    examples = [(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["v"], "<f4").astype(float)) for r in known]
    labels = np.array([langs.index(r["lang"]) for r in known], dtype=int)
    fit = np.arange(len(known)) % CALIBRATE != 0
    if len(known) < 5 * CALIBRATE:
        fit[:] = True
    model.weights = train_multinomial([x for x, f in zip(examples, fit) if f], labels[fit], 1 << BITS, len(langs))
    aside = [k for k in range(len(known)) if not fit[k]]
    model.temperature = temperature(np.array([examples[k][1] @ model.weights[examples[k][0]] for k in aside]).reshape(len(aside), len(langs)), labels[aside])
    return model


def predict(text: Column, model: Model) -> Column:
    """struct(lang_pred, score) of a text column; the model, features by languages, is broadcast (its size is fixed by its parameters)."""
    from pyspark.sql import SparkSession

    held = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.predict(x) for x in texts], columns=["lang_pred", "score"])

    return predicted(text)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """documents -> doc_id, held_out, lang_pred, score; learned from the documents that aren't held out.

    Null texts and texts without a letter are `und` with score 0, as is every text if nothing can be learned. A null
    id counts as the empty text in the split; repeated rows each get their row; an empty table gives an empty result; other
    columns, also of clashing names, are ignored.
    """
    held_out = id_bucket("doc_id", FOLDS) == HELD_OUT
    model = train(docs.where(~held_out), sample)
    rows = docs.select("doc_id", held_out.alias("held_out"), predict(F.col("text"), model).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")
