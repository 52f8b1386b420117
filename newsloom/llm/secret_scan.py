"""Secret scans: fixed patterns, and a probabilistic automaton inferred from credentials that the patterns label.

The automaton is learned by state merging (ALERGIA): labelled credentials become a prefix tree of character classes,
and states whose outgoing and final frequencies differ by less than a Hoeffding bound are merged with all that
follows. Every other candidate string, whatever its characters, is scored by its likelihood under the automaton
against a background of ordinary candidates; those likelier than the threshold add spans. The threshold is set on
labelled credentials that the inference doesn't see and on ordinary candidates.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.shared import materialize

#: The base kinds in their order, their patterns, the group whose length counts, and the least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
)
KINDS = ("assign", "access", "hex", "format")
#: What may be a credential besides: long strings of credential characters; `=` only pads the end, so that a name before it is another string.
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST)
#: Distinct labelled credentials that the inference reads, and distinct ordinary candidates that the threshold is set on.
SAMPLE = 1000
ALPHA = 0.05
#: One labelled credential in so many is held out of the inference, to set the threshold.
HELD_OUT = 5
#: Log-likelihood ratio a character, in bits, below which a candidate is never a secret.
FLOOR = 0.5
#: What a share of flagged ordinary candidates costs against the same share of found credentials.
COST = 10.0
#: Marks of a string's begin and end in the background, and the number of classes by which rare ones are smoothed.
BEGIN, CLOSE, CLASSES = "^", "$", 16

FOUND = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_format bigint"


def _holds_a_name(text: str) -> bool:
    """Whether a text may hold an assignment: a quick look before the pattern."""
    low = text.lower()
    return any(x in low for x in ("passw", "secret", "token", "api"))


def _longest_word(text: str) -> int:
    return max(map(len, text.split()), default=0)


def base_matches(text: str) -> list[tuple[int, int, int, str]]:
    """(start, place of the kind, end, the secret part) of the base patterns' matches, in order; patterns that can't match aren't run."""
    able = _holds_a_name(text), "AKIA" in text, _longest_word(text) >= BASE[2][3]
    found = []
    for k, (_, pattern, group, least) in enumerate(BASE):
        if able[k]:
            found += [(m.start(), k, m.end(), m[group]) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the base patterns' matches, in order."""
    return [x[:3] for x in base_matches(text)]


def shape(text: str) -> str:
    """Character classes: digits, hexadecimal letters, other letters by case; A, K and I and signs stand for themselves."""
    return text.translate(_SHAPES)


_SHAPES = str.maketrans(
    {c: "d" for c in "0123456789"} | {c: "h" for c in "abcdef"} | {c: "l" for c in "ghijklmnopqrstuvwxyz"} | {c: "U" for c in "BCDEFGHJLMNOPQRSTUVWXYZ"}
)


@dataclass
class State:
    """A state's visits, endings and transitions (class -> [target, uses])."""

    visits: int = 0
    ends: int = 0
    next: dict[str, list[int]] = field(default_factory=dict)


def prefix_tree(strings: list[str]) -> list[State]:
    states = [State()]
    for s in strings:
        at = 0
        states[0].visits += 1
        for c in s:
            if c not in states[at].next:
                states[at].next[c] = [len(states), 0]
                states.append(State())
            edge = states[at].next[c]
            edge[1] += 1
            at = edge[0]
            states[at].visits += 1
        states[at].ends += 1
    return states


def _differ(f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
    """The Hoeffding test: do two frequencies differ by more than chance?"""
    return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def _compatible(states: list[State], a: int, b: int, alpha: float) -> bool:
    todo = [(a, b)]
    while todo:
        p, q = (states[x] for x in todo.pop())
        if _differ(p.ends, p.visits, q.ends, q.visits, alpha):
            return False
        for c in p.next.keys() | q.next.keys():
            (to_p, uses_p), (to_q, uses_q) = p.next.get(c, (-1, 0)), q.next.get(c, (-1, 0))
            if _differ(uses_p, p.visits, uses_q, q.visits, alpha):
                return False
            if to_p >= 0 and to_q >= 0 and to_p != to_q:
                todo.append((to_p, to_q))
    return True


def _fold(states: list[State], into: int, tree: int) -> None:
    """Adds a subtree's counts to the automaton at `into`."""
    todo = [(into, tree)]
    while todo:
        a, b = todo.pop()
        p, q = states[a], states[b]
        p.visits += q.visits
        p.ends += q.ends
        for c, (to, uses) in q.next.items():
            if c in p.next:
                p.next[c][1] += uses
                todo.append((p.next[c][0], to))
            else:
                p.next[c] = [to, uses]


@dataclass
class Automaton:
    """A probabilistic automaton with its background (counts of neighbouring classes), threshold and figures.

    found and flagged: shares of held-out credentials and of ordinary candidates that reach the threshold.
    """

    states: list[State]
    background: Counter
    threshold: float = FLOOR
    found: float = 0.0
    flagged: float = 0.0
    before: Counter = field(default_factory=Counter)

    def __post_init__(self) -> None:
        for (first, _), n in self.background.items():
            self.before[first] += n

    def _ordinary(self, first: str, c: str) -> float:
        return math.log2((self.background[first + c] + 1) / (self.before[first] + CLASSES))

    def ratio(self, text: str) -> float:
        """Mean bits a character, the end included, by which the automaton explains a string better than the background does."""
        at, bits, last, form = 0, 0.0, BEGIN, shape(text)
        for c in form:
            state = self.states[at]
            edge = state.next.get(c)
            bits += math.log2(((edge[1] if edge else 0) + 0.1) / (state.visits + 0.1 * CLASSES)) - self._ordinary(last, c)
            at, last = edge[0] if edge else at, c
        bits += math.log2((self.states[at].ends + 0.1) / (self.states[at].visits + 0.1 * CLASSES)) - self._ordinary(last, CLOSE)
        return bits / (len(form) + 1)


def merged(labelled: list[str], alpha: float = ALPHA) -> list[State]:
    """The prefix tree of the strings' shapes, with compatible states merged; the states that nothing leads to stay unused."""
    states = prefix_tree(sorted(map(shape, labelled)))
    red, known = [0], {0}
    edges = [(0, c) for c in sorted(states[0].next)]
    waiting = set(edges)
    while edges:
        source, c = edge = edges.pop(0)
        waiting.discard(edge)
        blue = states[source].next[c][0]
        if blue in known:
            continue
        for r in red:
            if _compatible(states, r, blue, alpha):
                states[source].next[c][0] = r
                _fold(states, r, blue)
                more = [(r, x) for x in sorted(states[r].next) if states[r].next[x][0] not in known and (r, x) not in waiting]
                break
        else:
            red.append(blue)
            known.add(blue)
            more = [(blue, x) for x in sorted(states[blue].next)]
        edges += more
        waiting.update(more)
    return states


def neighbours(words: list[str]) -> Counter:
    """Counts of neighbouring classes in the shapes of words, with their begins and ends."""
    line = "".join(f"{BEGIN}{shape(w)}{CLOSE}" for w in words)
    return Counter(a + b for a, b in zip(line, line[1:]) if a != CLOSE)


def infer(labelled: list[str], background: Counter, ordinary: list[str] = (), alpha: float = ALPHA) -> Automaton:
    """Merges the prefix tree of the labelled strings' shapes and sets the threshold.

    One string in HELD_OUT stays out of the tree (from HELD_OUT strings on). The threshold is the score of a held-out
    string that yields the most: the share of them found, less COST times the share of ordinary candidates flagged.
    No labels: an automaton that accepts nothing.
    """
    aside = labelled[::HELD_OUT] if len(labelled) >= HELD_OUT else labelled
    model = Automaton(merged([x for k, x in enumerate(labelled) if k % HELD_OUT or len(labelled) < HELD_OUT], alpha), background, math.inf)
    if not labelled:
        return model
    scores, others = sorted(map(model.ratio, aside)), sorted(map(model.ratio, ordinary))
    share = lambda values, t: (len(values) - bisect_left(values, t)) / max(1, len(values))
    model.threshold = max((max(FLOOR, t) for t in scores), key=lambda t: (share(scores, t) - COST * share(others, t), t))
    model.found, model.flagged = share(scores, model.threshold), share(others, model.threshold)
    return model


def candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """Candidates that meet no base span (start, kind, end); both are read in order, side by side."""
    at, reach = 0, 0
    if _longest_word(text) < LEAST:
        return
    for m in CANDIDATE.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][2])
            at += 1
        if reach <= m.start():
            yield m


def format_spans(text: str, taken: list[tuple[int, int, int]], model: Automaton) -> list[tuple[int, int, int]]:
    """Candidates outside the base spans whose format is likelier a credential's."""
    return [(m.start(), 3, m.end()) for m in candidates(text, taken) if model.ratio(m[0]) >= model.threshold]


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def learn(docs: DataFrame, sample: int = SAMPLE) -> Automaton:
    """Infers the automaton from at most `sample` distinct credentials that the base patterns label, over all documents.

    The bound is on what the inference reads: every document is scanned, and of the distinct credentials, and likewise
    of the ordinary candidates, those with the least hashes come to the driver. Ordinary are the other candidates of
    letters or digits only, since a mixed one may be an unlabelled secret. The background counts the neighbouring
    classes of all other candidates, summed on the executors.
    """

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes: Counter = Counter()
        least: dict[str, dict[str, int]] = {"value": {}, "word": {}}

        def note(kind: str, words: list[str]) -> None:
            held = least[kind]
            held.update((x, xxhash.xxh64_intdigest(x.encode("utf-8", "replace"))) for x in words)
            if len(held) > 4 * sample:
                least[kind] = dict(heapq.nsmallest(sample, held.items(), key=lambda x: (x[1], x[0])))

        for batch in batches:
            for text in batch["text"]:
                if text:
                    base = base_matches(text)
                    note("value", [x[3] for x in base])
                    words = [m[0] for m in candidates(text, [x[:3] for x in base])]
                    note("word", [x for x in words if x.isalpha() or x.isdigit()])
                    classes.update(neighbours(words))
        rows = [("pair", c, n) for c, n in classes.items()]
        for kind, held in least.items():
            rows += [(kind, x, h - (1 << 63)) for x, h in heapq.nsmallest(sample, held.items(), key=lambda x: (x[1], x[0]))]
        yield pd.DataFrame(rows, columns=["kind", "value", "n"])

    found = materialize(docs.select("text").mapInPandas(labelled, "kind string, value string, n bigint"))
    first = lambda kind: [r["value"] for r in found.where(F.col("kind") == kind).select("n", "value").distinct().orderBy("n", "value").limit(sample).collect()]
    pairs = found.where("kind = 'pair'").groupBy("value").agg(F.sum("n").alias("n")).collect()  # at most the square of the classes
    return infer(first("value"), Counter({r["value"]: r["n"] for r in pairs}), first("word"))


def scan_text(text: str | None, model: Automaton) -> list[tuple[int, int, int]]:
    """All spans of a text as (start, place of the kind, end), base ones and those of the automaton."""
    base = base_spans(text or "")
    return sorted(base + format_spans(text or "", base, model))


def scan(docs: DataFrame, model: Automaton | None = None, sample: int = SAMPLE) -> DataFrame:
    """documents -> doc_id, counts by kind, base_sha256 and the spans (`kind:start:end` by code points, comma-joined).

    Whole texts; null and empty texts have no spans (the digest is that of the empty string). Repeated rows and null
    ids each get their row, other columns are ignored, and an empty table gives an empty result. The model, a few
    hundred states, is learned from the same documents unless one is given.
    """
    model = model or learn(docs, sample)

    @F.pandas_udf(FOUND)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            spans = scan_text(text, model)
            n = Counter(k for _, k, _ in spans)
            base = _listed([x for x in spans if x[1] < 3])
            rows.append((n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(), _listed(spans), n[3]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])

    return docs.select("doc_id", scanned("text").alias("s")).select(F.col("doc_id").cast("bigint").alias("doc_id"), "s.*")


def redact(docs: DataFrame, mark: str = "[secret]", sample: int = SAMPLE) -> DataFrame:
    """Replaces every span by `mark` (overlapping spans as one) and recounts n_chars; no document is dropped.

    Null and empty texts stay as they are, repeated rows and null ids are kept, and an empty table gives an empty one.
    """
    model = learn(docs, sample)

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            if text:
                parts, at = [], 0
                for start, _, end in scan_text(text, model):
                    if start >= at:
                        parts += [text[at:start], mark]
                    at = max(at, end)
                text = "".join(parts) + text[at:]
            out.append(text)
        return pd.Series(out, dtype=object)

    # n_chars needs the cleaned text, so both come from one evaluation.
    held = docs.withColumn("text", cleaned(F.col("text")))
    return held.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else held
