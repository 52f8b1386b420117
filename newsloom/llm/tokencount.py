"""Token counts by finite-state transducers.

Two deterministic machines are compiled from a byte-level vocabulary. The first cuts a text into pieces; it reads
character classes, so its dozen states make chunk state maps small: every fixed-size chunk of a batch is run from all
states at once, the maps are composed by a parallel prefix scan, and a second run from the true entry states yields
the cuts. The second reads the bytes of a piece, and each of its transitions carries the change in the number of
emitted tokens; its states are found as they are needed.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.llm.bpe import default_path, encoder, reference_tokenizer, vocabulary

CHUNK = 512
#: Characters of a batch that are held as arrays at a time.
BLOCK = 1 << 21
#: Piece counts that a worker remembers (later new pieces are counted each time), and transducer states (beyond that it forgets them and goes on).
PIECES, MACHINE = 500_000, 500_000

LETTER, DIGIT, SPACE, BLANK, OTHER, APOSTROPHE, STMD, R, V, L, E, END = range(12)
CLASSES = 12
START, IN_LETTERS, IN_DIGITS, IN_OTHER, ONE_SPACE, ONE_BLANK, MORE_SPACE, MORE_BLANK, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(12)
STATES = 12
CUT_HERE, CUT_BEFORE = 1, 2
UNKNOWN = 255

_LETTERS = (LETTER, STMD, R, V, L, E)


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and cuts (before this character, before the previous one) for every state and class."""
    fresh = {c: IN_LETTERS for c in _LETTERS} | {DIGIT: IN_DIGITS, OTHER: IN_OTHER, APOSTROPHE: QUOTE, SPACE: ONE_SPACE, BLANK: ONE_BLANK, END: START}
    rule: dict[tuple[int, int], tuple[int, int]] = {}
    for state in range(STATES):
        for c in range(CLASSES):
            rule[state, c] = fresh[c], CUT_HERE
    for c in _LETTERS:
        rule[IN_LETTERS, c] = IN_LETTERS, 0
        rule[ONE_SPACE, c] = IN_LETTERS, 0
        rule[MORE_SPACE, c] = IN_LETTERS, CUT_BEFORE
    for c, run in ((DIGIT, IN_DIGITS), (OTHER, IN_OTHER), (APOSTROPHE, IN_OTHER)):
        rule[run, c] = run, 0
        rule[ONE_SPACE, c] = run, 0
        rule[MORE_SPACE, c] = run, CUT_BEFORE
    for c in (*_LETTERS, DIGIT, OTHER, APOSTROPHE):
        rule[MORE_BLANK, c] = fresh[c], CUT_HERE | CUT_BEFORE
    for state in (ONE_SPACE, ONE_BLANK, MORE_SPACE, MORE_BLANK):
        rule[state, SPACE] = MORE_SPACE, 0
        rule[state, BLANK] = MORE_BLANK, 0
    rule[QUOTE, STMD] = START, 0
    rule[QUOTE, R], rule[QUOTE, V], rule[QUOTE, L] = (QUOTE_R, 0), (QUOTE_V, 0), (QUOTE_L, 0)
    rule[QUOTE, OTHER] = rule[QUOTE, APOSTROPHE] = IN_OTHER, 0
    for state, last in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, L)):
        for c in range(CLASSES):
            after, cut = rule[IN_LETTERS, c]
            rule[state, c] = after, cut | CUT_BEFORE
        rule[state, last] = START, 0
    step, cuts = np.zeros(STATES * CLASSES, np.uint8), np.zeros(STATES * CLASSES, np.uint8)
    for (state, c), (after, cut) in rule.items():
        step[state * CLASSES + c], cuts[state * CLASSES + c] = after, cut
    return step, cuts


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan: row k becomes the map of rows 0 to k run one after another, in log2 rounds."""
    maps, reach = maps.copy(), 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    return maps


class Splitter:
    """The piece machine over batches of characters; classes come from the tokenizer's own splitter, once per character."""

    def __init__(self, path: str):
        self.step, self.cuts = _splitter()
        self.split = reference_tokenizer(path).pre_tokenizer.pre_tokenize_str
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        for text, c in ((" ", SPACE), ("'", APOSTROPHE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
            self.classes[[ord(x) for x in text]] = c

    def _classify(self, x: str) -> int:
        alone = lambda before: len(self.split(before + x)) == 1
        return LETTER if alone("a") else DIGIT if alone("1") else OTHER if alone("!") else BLANK

    def classified(self, points: np.ndarray) -> np.ndarray:
        found = self.classes[points]
        if (found == UNKNOWN).any():
            for p in np.unique(points[found == UNKNOWN]).tolist():
                self.classes[p] = OTHER if 0xD800 <= p < 0xE000 else self._classify(chr(p))
            found = self.classes[points]
        return found

    def _run(self, lanes: np.ndarray, states: np.ndarray) -> np.ndarray:
        """Exit states of every chunk (a column of `lanes`) from the given entry states, one row per chunk."""
        states = states.astype(np.uint8)
        for row in lanes:
            states = self.step[states.astype(np.intp) * CLASSES + row[:, None]]
        return states

    def pieces(self, classes: np.ndarray) -> np.ndarray:
        """Where pieces begin."""
        n = len(classes)
        lanes = np.full(-(-n // CHUNK) * CHUNK, END, np.uint8)
        lanes[:n] = classes
        lanes = np.ascontiguousarray(lanes.reshape(-1, CHUNK).T)
        count = lanes.shape[1]
        maps = self._run(lanes[:32], np.tile(np.arange(STATES, dtype=np.uint8), (count, 1)))
        met = (maps == maps[:, :1]).all(axis=1)
        if met.any():
            maps[met] = self._run(lanes[32:, met], maps[met, :1])
        if not met.all():
            maps[~met] = self._run(lanes[32:, ~met], maps[~met])
        states = np.full(count, START, np.uint8)
        states[1:] = compose(maps)[:-1, START]
        marks = np.empty(lanes.shape, np.uint8)
        for k, row in enumerate(lanes):
            at = states.astype(np.intp) * CLASSES + row
            marks[k], states = self.cuts[at], self.step[at]
        marks = marks.T.reshape(-1)
        begins = (marks[:n] & CUT_HERE).astype(bool)
        begins[: n - 1] |= (marks[1:n] & CUT_BEFORE).astype(bool)
        return np.flatnonzero(begins)


class Transducer:
    """Bytes of one piece -> number of tokens.

    A state is the longest suffix that begins some token, with the last token at each of its positions and the token
    counts there, relative to the present one. On a byte, exactly one token that ends here is compatible with the last
    token before it; the transition carries the difference of the counts.
    """

    def __init__(self, path: str):
        self.ranks, _ = vocabulary(path)
        self.single = encoder(path)._encode_single_piece
        self.tokens = {k: t for t, k in self.ranks.items()}
        self.begins = {t[:n] for t in self.ranks for n in range(1, len(t) + 1)}
        self.fits: dict[tuple[int, int], bool] = {}
        self.counts: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.numbers = {(b"", ((-1, 0),)): 0}
        self.states: list[tuple[bytes, tuple]] = [(b"", ((-1, 0),))]
        self.step: dict[int, tuple[int, int]] = {}

    def _compatible(self, before: int, token: int) -> bool:
        known = self.fits.get((before, token))
        if known is None:
            own = self.tokens[token]
            parts = [token] if before < 0 else [before, token]
            known = self.single(own if before < 0 else self.tokens[before] + own) == parts
            if len(self.fits) > MACHINE:
                self.fits.clear()
            self.fits[before, token] = known
        return known

    def _extend(self, state: int, byte: int) -> tuple[int, int]:
        suffix, past = self.states[state]
        grown = suffix + bytes((byte,))
        for size in range(len(grown), 0, -1):
            token = self.ranks.get(grown[-size:])
            if token is not None and size <= len(past) and self._compatible(past[size - 1][0], token):
                change = past[size - 1][1] + 1
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        while grown not in self.begins:
            grown = grown[1:]
        history = ((token, 0), *((t, c - change) for t, c in past))[: len(grown) + 1]
        key = (grown, history)
        number = self.numbers.setdefault(key, len(self.states))
        if number == len(self.states):
            self.states.append(key)
        self.step[state << 8 | byte] = number, change
        return number, change

    def count(self, piece: str) -> int:
        known = self.counts.get(piece)
        if known is not None:
            return known
        if len(self.states) > MACHINE:
            self._forget()
        state, total, step = 0, 0, self.step.get
        for byte in piece.encode("utf-8", "replace"):
            state, change = step(state << 8 | byte) or self._extend(state, byte)
            total += change
        if len(piece) <= 64 and len(self.counts) < PIECES:
            self.counts[piece] = total
        return total


class Counter:
    def __init__(self, path: str):
        self.splitter, self.transducer = Splitter(path), Transducer(path)
        self.special = sorted(vocabulary(path)[1], key=len, reverse=True)

    def _segments(self, text: str) -> tuple[list[str], int]:
        """The stretches between special strings, and how many of those there are."""
        parts = [text]
        for mark in self.special:
            parts = [x for part in parts for x in part.split(mark)]
        return parts, len(parts) - 1

    def _block(self, parts: list[str]) -> np.ndarray:
        """Tokens of each stretch; each is followed by an end mark that resets the machine."""
        joined = "\x00".join(parts) + "\x00"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        classes = self.splitter.classified(points)
        ends = np.cumsum([len(x) + 1 for x in parts]) - 1
        classes[ends] = END
        begins = self.splitter.pieces(classes)
        known, count = self.transducer.counts, self.transducer.count
        places = begins.tolist()
        tokens = np.fromiter(
            (t if (t := known.get(joined[a:b])) is not None else count(joined[a:b]) for a, b in zip(places, [*places[1:], len(joined)])), np.int64, len(places)
        )
        tokens[np.searchsorted(begins, ends)] = 0
        known = np.concatenate([[0], np.cumsum(tokens)])
        upto = known[np.searchsorted(begins, ends)]
        return np.diff(upto, prepend=0)

    def counts(self, texts: list[str | None]) -> list[int]:
        out, parts, owners, held = [0] * len(texts), [], [], 0

        def flush() -> None:
            nonlocal parts, owners, held
            if parts:
                for owner, n in zip(owners, self._block(parts).tolist()):
                    out[owner] += n
            parts, owners, held = [], [], 0

        for k, text in enumerate(texts):
            own, marks = self._segments(text or "")
            out[k] += marks
            for x in own:
                parts.append(x)
                owners.append(k)
                held += len(x) + 1
                if held >= BLOCK:
                    flush()
        flush()
        return out


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_count(text: Column, path: str | None = None) -> Column:
    """Number of tokens of a text column under a byte-level vocabulary file; null counts as empty, special strings as one token each.

    Whole texts in Arrow batches, no shuffle; a worker compiles the machines once.
    """
    path = path or default_path()

    @F.pandas_udf("bigint")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series(counter(path).counts(texts.tolist()), dtype="int64")

    return counted(text)
