"""Toxicity: a linear classifier whose scores may not hang on which group a text mentions.

Each identity term in a labelled sentence is swapped for another of its kind, and the training adds the squared change
of the sentence's score to its loss. Since a corpus may hold no such terms, every labelled text also has a
counterfactual copy: the same text and label with a term placed into one of its sentences, so that terms stand in texts
of both labels and have gradients of their own, which no L1 penalty hides. Terms of one kind are drawn to one weight,
and towards none, since the neutral word of a kind counts as no evidence; neutral mentions stop raising the score.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Collection, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.ftrl import Ftrl
from newsloom.llm.shared import id_bucket

#: Identity terms by kind; the last of each kind is neutral.
IDENTITIES = (
    ("women", "men", "girls", "boys", "people"),
    ("woman", "man", "girl", "boy", "person"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "religious"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "believers"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "adult"),
    ("black", "white", "asian", "african", "european", "american", "local"),
    ("immigrants", "refugees", "foreigners", "migrants", "residents"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "personas"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "personnes"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer", "menschen"),
)
_KIND = {term: kind for kind in IDENTITIES for term in kind}
WORDS = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+")
#: Labelled rows that the classifier is fitted on, of each label at most about so many; a word must be in so many of them.
SAMPLE, LEAST_DOCS = 3000, 3
ROUNDS = 20
#: Lengths of the beginnings of words that are features besides the words.
STEMS = (4, 5)
#: Weight of the squared score changes against the log loss.
COUNTERFACTUAL = 8.0
FOLDS, HELD_OUT = 5, 0


def words(text: str | None) -> set[str]:
    """The distinct words of a text, and the beginnings of the longer ones, marked by an asterisk."""
    found = set(WORDS.findall(text.lower())) if text else set()
    return found | {f"{w[:n]}*" for n in STEMS for w in found if len(w) > n and w not in _KIND}


def mentions(text: str | None) -> list[tuple[str, list[str]]]:
    """(identity term, the features of its sentence without it) for every mention, and for one term that is placed into a sentence.

    The sentence and the term that is placed follow from a checksum of the text.
    """
    sentences = [found for x in SENTENCE.findall(text or "") if (found := set(WORDS.findall(x.lower())))]
    if not sentences:
        return []
    draw, terms = zlib.crc32(text.encode("utf-8", "replace")), sorted(_KIND)
    placed = sentences[draw % len(sentences)], {terms[draw // len(sentences) % len(terms)]}
    out = []
    for found, named in [*((x, x & _KIND.keys()) for x in sentences), placed]:
        rest = words(" ".join(found - named)) if named else ()
        out += [(term, sorted(rest | (named - {term}))) for term in sorted(named)]
    return out


@dataclass
class Model:
    """Weights of the words that have any, the intercept, and how many steps of the fit the counterfactual penalty made."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    swaps: int = 0

    def score(self, text: str | None) -> float:
        return _chance(self.bias + sum(self.weights[w] for w in self.weights.keys() & words(text)))


def _chance(total: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def fit(texts: Iterable[tuple[Collection[str], Sequence[tuple[str, Collection[str]]]]], labels: Sequence[int], strength: float = COUNTERFACTUAL, rounds: int = ROUNDS, seed: int = 7) -> Model:
    """Logistic regression on word presence by follow-the-regularised-leader, with the counterfactual penalty.

    `texts` are the distinct words of each text with its mentions, the placed one last; they are read once and held as
    numbers. A text's copy, with the placed term, is a row of its own with the text's label. In every round each mention is swapped for the neutral word of its kind and for another term of it, drawn anew, and the
    squared change of the sentence's score is penalised.
    """
    number: dict[str, int] = {}
    coded = lambda found: np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found))
    held, spoken = [], []
    for found, named in texts:
        held.append(coded(found))
        spoken.append([(term, coded(rest)) for term, rest in named])
    if not held:
        return Model()
    known = np.bincount(np.concatenate(held), minlength=len(number))
    names = ["", *sorted(w for w, n in number.items() if known[n] >= LEAST_DOCS or w in _KIND), *sorted(_KIND.keys() - number.keys())]
    place = {w: k for k, w in enumerate(names)}
    placed = np.array([place.get(w, 0) for w in number], np.int32)
    rows = [np.unique(np.append(placed[x], 0)) for x in held]
    swaps = [[(term, np.unique(np.append(placed[x], 0))) for term, x in named] for named in spoken]
    share = max(1e-9, sum(labels) / len(labels))
    cost = {1: 0.5 / share, 0: 0.5 / max(1e-9, 1 - share)}
    terms = np.array([place[x] for x in _KIND])
    model, order, count, made = Ftrl(len(names), 1, alpha=1.0, l1=5.0, l2=1e-3, free=terms), np.random.default_rng(seed), len(rows), 0
    copied = [k for k in range(count) if spoken[k]]
    rows += [np.union1d(rows[k], [place[spoken[k][-1][0]]]) for k in copied]
    labels = [*labels, *(labels[k] for k in copied)]
    for _ in range(rounds):
        for k in order.permutation(len(rows)):
            at, y = rows[k], labels[k]
            w = model.weights(at)
            model.update(at, np.full((len(at), 1), (_chance(w.sum()) - y) * cost[y]), w)
            for term, rest in swaps[k] if strength and k < count else ():
                own, other = place[term], place[_KIND[term][order.integers(len(_KIND[term]))]]
                if not model.weights(np.array([own, other])).any():
                    continue
                made += 1
                base = model.weights(rest[rest != own]).sum()
                # The neutral word of the kind is no evidence: only the term's weight gives way.
                w = model.weights(np.array([own]))
                p, q = _chance(base + w[0, 0]), _chance(base)
                if p != q:
                    model.update(np.array([own]), np.full((1, 1), 2 * strength * (p - q) * p * (1 - p)), w)
                w = model.weights(np.array([own, other]))
                if w[0, 0] == w[1, 0] or other in rest:
                    continue
                p, q = _chance(base + w[0, 0]), _chance(base + w[1, 0])
                change = 2 * strength * (p - q)
                model.update(np.array([own, other]), np.array([[change * p * (1 - p)], [-change * q * (1 - q)]]), w)
                shared = rest[rest != own]
                model.update(shared, np.full((len(shared), 1), change * (p * (1 - p) - q * (1 - q))), model.weights(shared))
    w = model.weights()[:, 0]
    return Model({str(names[k]): float(w[k]) for k in np.flatnonzero(w) if k}, float(w[0]), made)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, strength: float = COUNTERFACTUAL) -> Model:
    """Fits documents to labels.toxic; about `sample` rows of each label, chosen by a hash, reach the fit, and 3 * sample at most.

    The chosen ids, at most about twice `sample`, are broadcast to the scan of the texts.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model()
    full = 1 << 30
    limit = F.when(F.col("_label") == 1, F.lit(min(full, full * sample // sizes[1]))).otherwise(F.lit(min(full, full * sample // sizes[0])))
    chosen = known.select("doc_id", F.col("toxic").cast("int").alias("_label"), F.xxhash64("doc_id", F.lit("toxic")).alias("_draw"))
    chosen = chosen.where(F.pmod(F.col("_draw"), F.lit(full)) < limit)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spoken = [json.dumps(mentions(x)) for x in batch["text"]]
            yield pd.DataFrame({"draw": batch["_draw"], "toxic": batch["_label"], "words": [" ".join(sorted(words(x))) for x in batch["text"]], "mentions": spoken})

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("_draw", "_label", "text").mapInPandas(features, "draw bigint, toxic int, words string, mentions string")
    # Repeated rows of an id are drawn together, so the bound on rows is set here.
    rows = rows.orderBy("draw", "words", "mentions").limit(3 * sample).collect()
    return fit(((r["words"].split(), json.loads(r["mentions"])) for r in rows), [r["toxic"] for r in rows], strength)


def neutral_false_positives(model: Model, sentences: Iterable[str]) -> float:
    """The share of sentences that score 0.5 or more once an identity term is named in them, over all terms; for sentences that aren't toxic."""
    named = [f"{x} {term}" for x in sentences for term in sorted(_KIND)]
    return sum(model.score(x) >= 0.5 for x in named) / max(1, len(named))


def score(text: Column, model: Model) -> Column:
    """The probability of label 1; the model's few words are broadcast."""
    held = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([held.value.score(x) for x in texts], dtype="float64")

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """documents, labels -> doc_id, held_out, score, predicted; learned from labels of the rows that aren't held out.

    Null and empty texts get the score of a text without words; so does every text if one of the labels is missing
    (0.5). A null id counts as the empty text in the split; where an id has several labels the largest holds; repeated
    rows each get their row; an empty table gives an empty result; other columns, also of clashing names, are ignored.
    """
    model = train(docs, labels.where(id_bucket("doc_id", FOLDS) != HELD_OUT), sample)
    rows = docs.select("doc_id", (id_bucket("doc_id", FOLDS) == HELD_OUT).alias("held_out"), score(F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
