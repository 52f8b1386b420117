"""Phrase collocations: a sketch proposes, automata count.

A first pass adds all phrases of 2 to 4 words to a count-min sketch, one row of counters that is wider than there are
phrases; tasks send packed blocks of counters by range, which are summed into a bitmap of the counters that reach the
least count. An upper bound can't lose a phrase. A second pass collects the phrases that the bitmap admits, and their
words; they are compiled into Aho-Corasick automata over words, bounded in size, by language and first word. A third pass
reads the documents: each word is a possible beginning for the one automaton that has patterns with it, so the work of
a text doesn't grow with the number of automata. A stop stands between pieces, so no match crosses. Exact counts then go
through the thresholds. Between the passes go packed blocks, not a row for every phrase and task.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.files import mapped, mounted, pack, save_arrays, unpack
from newsloom.llm.shared import fresh_dir, materialize

LEAST, LONGEST, TOP = 30, 4, 2000
#: A score is SCALE times the share; a phrase goes if a longer one around it has COVER percent of its occurrences.
SCALE, COVER = 2_000_000, 80
#: Counters of one range of the sketch, phrases that a task gathers, patterns of an automaton.
RANGE, GATHER, PATTERNS = 1 << 24, 1 << 21, 400_000
#: What stands between pieces.
STOP = b"\xff"
#: Distinct words that a task remembers.
CACHE = 500_000
#: Parts of a language that are ranked apart.
SALT = 64

_SIGNS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\xff" * 10 + b" abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in lower case (A-Z); STOP, which UTF-8 can't hold, stands between its pieces and at its end."""
    whole = (text or "").encode("utf-8", "surrogatepass").translate(_SIGNS)
    return (whole.replace(STOP, b" \xff ") + b" \xff").split()


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) or 1


class Known(dict):
    """Hashes of words, each made once; 0 is that of STOP."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = 0 if word == STOP else _hash(word)
        return found


class Windows:
    """Gathered texts as the hashes of their words, one after another."""

    def __init__(self) -> None:
        self.known = Known()
        self.clear()

    def clear(self) -> None:
        self.words: list[bytes] = []
        self.ends: list[int] = []
        self.langs: list[int] = []

    def add(self, text: str | None, lang: int) -> None:
        self.words += words_of(text)
        self.ends.append(len(self.words))
        self.langs.append(lang)

    def numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and language's mark of each word."""
        if len(self.known) > CACHE:
            self.known.clear()
        word = np.fromiter(map(self.known.__getitem__, self.words), np.uint64, len(self.words))
        return word, np.repeat(np.array(self.langs, np.uint64), np.diff(self.ends, prepend=0))

    def phrases(self, hot: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: (length, first words, hashes) of the phrases within pieces, or of those that `hot` admits.

        A phrase's hash mixes those of its words in order, and its language's mark. A phrase lies where one that is a
        word shorter begins at its first word and one at its second; if either isn't admitted, it is too rare as well.
        """
        word, mark = self.numbers()
        first = np.flatnonzero((word[:-1] != 0) & (word[1:] != 0))
        held = word[first] + mark[first]
        for n in range(2, LONGEST + 1):
            held = (held ^ (held >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word[first + (n - 1)]
            mixed = (held ^ (held >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            if hot is not None:
                kept = np.flatnonzero(hot(mixed))
                first, held, mixed = first[kept], held[kept], mixed[kept]
            yield n, first, mixed
            more = np.flatnonzero(np.diff(first) == 1)
            first, held = first[more], held[more]


def _mark(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))


def _gathered(batches: Iterator[pd.DataFrame], mark: Callable[[str], int] = _mark) -> Iterator[Windows]:
    """Texts of the batches in portions of about GATHER phrases."""
    windows = Windows()
    for batch in batches:
        marks = {lang: mark(lang) for lang in batch["lang"].unique()}
        for lang, text in zip(batch["lang"], batch["text"]):
            windows.add(text, marks[lang])
            if (LONGEST - 1) * len(windows.words) >= GATHER:
                yield windows
                windows.clear()
    if windows.words:
        yield windows


def _by_lang(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def sizes_by_lang(docs: DataFrame) -> dict[str, int]:
    """Characters of each language; a row a language comes to the driver."""
    return {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()}


def sketch_width(chars: int, size: int = RANGE) -> int:
    """Counters of the sketch: at least one for every two characters, and so about one a phrase or more, in whole ranges."""
    return max(1, -(-chars // (2 * size))) * size


def sketch(docs: DataFrame, width: int, folder: str, least: int = LEAST, size: int = RANGE) -> int:
    """Writes the bitmap of the counters that reach `least`, each range of `size` at its place in one file; returns how many do."""
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/hot", "wb") as f:
        f.truncate(width // 8)

    def blocks(windows: Windows) -> pd.DataFrame:
        at = np.sort(np.concatenate([h % np.uint64(width) for _, _, h in windows.phrases()]).astype(np.int64))
        new = np.flatnonzero(np.diff(at, prepend=-1))
        at, n = at[new], np.diff(new, append=len(at))
        part = at // size
        ends = np.searchsorted(part, np.arange(width // size + 1))
        found = np.flatnonzero(np.diff(ends)).tolist()
        blobs = [pack(at[a:b] % size, n[a:b]) for a, b in ((ends[k], ends[k + 1]) for k in found)]
        return pd.DataFrame({"part": found, "counters": blobs})

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for windows in _gathered(batches):
            yield blocks(windows)

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, np.int32)
        for blob in group["counters"]:
            at, n = unpack(bytes(blob), 2)
            # Beyond `least` a counter needs no exact value.
            total[at] = np.minimum(total[at] + n, least)
        with open(f"{folder}/hot", "r+b") as f:
            f.seek(int(group["part"].iloc[0]) * size // 8)
            f.write(np.packbits(total >= least, bitorder="little").tobytes())
        return pd.DataFrame({"part": group["part"].iloc[:1], "n": [int((total >= least).sum())]})

    made = materialize(docs.mapInPandas(counted, "part bigint, counters binary").groupBy("part").applyInPandas(summed, "part bigint, n bigint"))
    return sum(r["n"] for r in made.collect())  # a row a range


def _hot(folder: str, width: int) -> Callable[[np.ndarray], np.ndarray]:
    """Which hashes have a counter that reached the least count."""
    bits = np.memmap(f"{folder}/hot", np.uint8, "r")

    def admitted(hashes: np.ndarray) -> np.ndarray:
        at = (hashes % np.uint64(width)).astype(np.int64)
        return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    return admitted


def _place(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Where the step from a state by a word is looked up, evenly spread."""
    mixed = (word ^ (word >> np.uint64(31))) + state.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(29))


def automaton(lines: Iterable[bytes]) -> dict[str, np.ndarray]:
    """The automaton of some phrases, in arrays: its states are the phrases and their beginnings, numbered by depth; 0 is the root.

    For each depth, the states lie in the order of the step's place that leads to them, with the state that it comes from,
    its word and, for each stretch of places, where that stretch begins; `lines` are the states' words.
    """
    levels: list[set[bytes]] = [set() for _ in range(LONGEST)]
    for line in lines:
        levels[line.count(b" ")].add(line)
    for shorter, longer in zip(levels[-2::-1], levels[:0:-1]):
        shorter.update(x.rpartition(b" ")[0] for x in longer)
    out, listed, number = {}, [], {b"": 0}
    for depth, level in enumerate(levels, 1):
        rows = [(*x.rpartition(b" ")[::2], x) for x in level]
        state = np.fromiter((number[before] for before, _, _ in rows), np.int32, len(rows))
        word = np.fromiter((_hash(last) for _, last, _ in rows), np.uint64, len(rows))
        place = _place(state, word)
        order = np.argsort(place)
        bits = max(1, len(rows).bit_length())
        starts = np.searchsorted(place[order], np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        out |= {f"starts{depth}": np.append(starts, len(rows)).astype(np.int32), f"state{depth}": state[order], f"word{depth}": word[order]}
        number = {rows[k][2]: at for at, k in enumerate(order.tolist(), len(listed) + 1)}
        listed += number
    return out | {"lines": np.frombuffer(b"\n".join(listed), np.uint8)}


def _stepped(machine: dict[str, np.ndarray], depth: int, state: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The states at `depth` that words lead to from states, counted from 0 at each depth; -1 where there is no step."""
    starts, states, words = (machine[f"{x}{depth}"] for x in ("starts", "state", "word"))
    out = np.full(len(word), -1, np.int32)
    stretch = (_place(state, word) >> np.uint64(65 - (len(starts) - 1).bit_length())).astype(np.int64)
    at, end, rows = starts[stretch], starts[stretch + 1], np.arange(len(word))
    while len(rows := rows[more := at < end]):
        at, end, state, word = at[more], end[more], state[more], word[more]
        hit = (words[at] == word) & (states[at] == state)
        out[rows[hit]] = at[hit]
        rows, at, end, state, word = (x[~hit] for x in (rows, at + 1, end, state, word))
    return out


def matches(machine: dict[str, np.ndarray], words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The states of all matches that begin at the words `first`.

    An automaton that reads word by word is in the state of the longest match so far, and its failure links lead to those
    that began later. There are LONGEST at most, so all of them go on together, depth by depth, and no link is stored.
    """
    found, below = [], 0
    state = np.zeros(len(first), np.int32)
    for depth in range(1, LONGEST + 1):
        to = _stepped(machine, depth, state, words[first + (depth - 1)])
        kept = np.flatnonzero(to >= 0)
        first, state = first[kept], to[kept] + np.int32(below + 1)
        found.append(state)
        below += len(machine[f"state{depth}"])
    return np.concatenate(found)


def compile_automata(docs: DataFrame, width: int, folder: str, shards: dict[str, int]) -> set[tuple[str, int]]:
    """Collects the phrases that the bitmap admits, and their words; writes an automaton for every language and shard, and returns which there are.

    The first word decides the shard, so that a match is looked for in one automaton however many there are.
    """

    def blocks(held: dict[tuple[str, int], list[bytes]]) -> pd.DataFrame:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        return pd.DataFrame([(lang, shard, squeeze(b"\n".join(sorted(x)))) for (lang, shard), x in held.items()], columns=["lang", "shard", "phrases"])

    def collected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot = _hot(folder, width)
        seen: set[int] = set()
        held: dict[tuple[str, int], list[bytes]] = {}
        count = 0
        names: dict[int, str] = {}

        def mark(lang: str) -> int:
            names[found := _mark(lang)] = lang
            return found

        for windows in _gathered(batches, mark):
            ends = np.array(windows.ends)
            words: set[tuple[str, bytes]] = set()
            for n, first, hashes in windows.phrases(hot):
                hashes, new = np.unique(hashes, return_index=True)
                fresh = [(h, k) for h, k in zip(hashes.tolist(), new.tolist()) if h not in seen]
                seen.update(h for h, _ in fresh)
                starts = first[[k for _, k in fresh]]
                for at, text in zip(starts.tolist(), np.searchsorted(ends, starts, "right").tolist()):
                    lang, phrase = names[windows.langs[text]], windows.words[at : at + n]
                    held.setdefault((lang, windows.known[phrase[0]] % shards[lang]), []).append(b" ".join(phrase))
                    count += 1
                    if n == 2:
                        words.update((lang, w) for w in phrase)
            for lang, word in words:
                held.setdefault((lang, windows.known[word] % shards[lang]), []).append(word)
            if count >= CACHE:
                yield blocks(held)
                held, count = {}, 0
            if len(seen) > 4 * CACHE:
                seen.clear()
        yield blocks(held)

    def compiled(group: pd.DataFrame) -> pd.DataFrame:
        lines = {x for blob in group["phrases"] for x in zstandard.ZstdDecompressor().decompress(bytes(blob)).split(b"\n")}
        save_arrays(_automaton_file(folder, group["lang"].iloc[0], int(group["shard"].iloc[0])), automaton(lines))
        return group[["lang", "shard"]].iloc[:1]

    found = docs.mapInPandas(collected, "lang string, shard int, phrases binary").groupBy("lang", "shard").applyInPandas(compiled, "lang string, shard int")
    return {(r["lang"], r["shard"]) for r in materialize(found).collect()}  # a row an automaton


def _automaton_file(folder: str, lang: str, shard: int) -> str:
    return f"{folder}/{xxhash.xxh3_128_hexdigest(lang.encode('utf-8', 'surrogatepass'))}-{shard}"


def count_matches(docs: DataFrame, folder: str, shards: dict[str, int], known: set[tuple[str, int]], least: int = LEAST) -> DataFrame:
    """lang, phrase, a, n: overlapping matches of every pattern that occurs `least` times in the documents of its language; n is null.

    A row without a phrase has the language's number of words n. Tasks add up their matches, by automaton.
    """
    codes = [(lang, shard) for lang, n in shards.items() for shard in range(n)]
    langs = list(shards)
    base = np.cumsum([0, *shards.values()])[:-1]

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n_words = np.zeros(len(langs), np.int64)
        n_shards = np.array([*shards.values()], np.uint64)
        held: dict[int, list[np.ndarray]] = {}
        count = 0

        def rows() -> pd.DataFrame:
            blobs = []
            for code, found in held.items():
                total = np.bincount(np.concatenate(found))
                places = np.flatnonzero(total)
                blobs.append((*codes[code], pack(places, total[places]), 0))
            return pd.DataFrame(blobs, columns=["lang", "shard", "counts", "n"])

        for windows in _gathered(batches, langs.index):
            word, lang = windows.numbers()
            word = np.append(word, np.zeros(LONGEST, np.uint64))
            first = np.flatnonzero(word)
            lang = lang[first].astype(np.int64)
            n_words += np.bincount(lang, minlength=len(langs))
            code = base[lang] + (word[first] % n_shards[lang]).astype(np.int64)
            order = np.argsort(code.astype(np.uint16) if len(codes) < 1 << 16 else code, kind="stable")
            here, ends = np.unique(code[order], return_index=True)
            for k, at in zip(here.tolist(), np.split(first[order], ends[1:])):
                if codes[k] in known:
                    found = matches(mapped(_automaton_file(folder, *codes[k])), word, at)
                    held.setdefault(k, []).append(found)
                    count += len(found)
            if count >= 4 * GATHER:
                yield rows()
                held, count = {}, 0
        yield rows()
        yield pd.DataFrame([(lang, -1, None, n) for lang, n in zip(langs, n_words.tolist()) if n], columns=["lang", "shard", "counts", "n"])

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        lang, shard = group["lang"].iloc[0], int(group["shard"].iloc[0])
        if shard < 0:
            return pd.DataFrame({"lang": [lang], "phrase": [None], "a": pd.array([None], "Int64"), "n": pd.array([int(group["n"].sum())], "Int64")})
        phrases = np.array(mapped(_automaton_file(folder, lang, shard))["lines"].tobytes().decode("utf-8", "replace").split("\n"), object)
        total = np.zeros(len(phrases) + 1, np.int64)
        for blob in group["counts"]:
            places, counts = unpack(bytes(blob), 2)
            total[places] += counts
        kept = np.flatnonzero(total >= least)
        return pd.DataFrame({"lang": lang, "phrase": phrases[kept - 1], "a": pd.array(total[kept], "Int64"), "n": pd.array([None] * len(kept), "Int64")})

    found = docs.mapInPandas(counted, "lang string, shard int, counts binary, n bigint")
    return found.groupBy("lang", "shard").applyInPandas(summed, "lang string, phrase string, a bigint, n bigint")


def phrase_counts(docs: DataFrame, least: int = LEAST, size: int = RANGE, patterns: int = PATTERNS) -> DataFrame:
    """lang, phrase, a for all phrases of 2 to LONGEST words that occur `least` times or more in a language, and for their words; rows with n, its number of words, have no phrase.

    The number of automata of a language follows from the phrases that the sketch admits and its share of the characters.
    """
    docs, folder = _by_lang(docs), mounted(fresh_dir(docs.sparkSession, "phrases"))
    chars = sizes_by_lang(docs)
    total = sum(chars.values())
    width = sketch_width(total, size)
    hot = sketch(docs, width, folder, least, size)
    shards = {lang: max(1, -(-hot * n // (max(total, 1) * patterns))) for lang, n in chars.items()}
    known = compile_automata(docs, width, folder, shards)
    return materialize(count_matches(docs, folder, shards, known, least))


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """phrases with l, r and score of the lowest-scoring cut, the earliest among equals.

    All parts of a phrase are as frequent as itself, so they are in one of the two tables. Quotients are exact decimals.
    """
    known = words.select("lang", "phrase", "a").unionByName(phrases.select("lang", "phrase", "a"))
    split = phrases.withColumn("w", F.split("phrase", " ")).select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    split = split.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("one"), F.array_join(F.expr("slice(w, k + 1, size(w))"), " ").alias("two"))
    split = split.join(known.select("lang", F.col("phrase").alias("one"), F.col("a").alias("l")), ["lang", "one"])
    split = split.join(known.select("lang", F.col("phrase").alias("two"), F.col("a").alias("r")), ["lang", "two"])
    score = F.expr(f"CAST(a AS DECIMAL(20, 0)) * {SCALE} DIV (CAST(l AS DECIMAL(20, 0)) + r)")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m")
    return split.groupBy("lang", "phrase", "a").agg(least).select("lang", "phrase", "a", "m.l", "m.r", "m.score")


def uncovered(phrases: DataFrame, cover: int = COVER) -> DataFrame:
    """Phrases (lang, phrase, a) without those that lie in a longer one with `cover` percent of their occurrences or more."""
    rows = phrases.withColumn("w", F.split("phrase", " ")).withColumn("size", F.size("w")).where("size > 2")
    inner = rows.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("n"))
    inner = inner.select("lang", "a", "w", "n", F.explode(F.expr("sequence(1, size - n + 1)")).alias("at"))
    inner = inner.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("n")), " ").alias("phrase"), "a")
    most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    rows = phrases.join(most, ["lang", "phrase"], "left")
    covered = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * cover
    return rows.where(~F.coalesce(covered, F.lit(False))).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, **sizes: int) -> DataFrame:
    """documents -> lang, rank, phrase, a, l, r, n, score: each language's `top` phrases.

    A null text has no words, a null lang is `und`. Every row counts, repeated ones too; doc_id takes no part, so it may
    be null; other columns are ignored; an empty table gives an empty result, as does a language without a frequent
    phrase. Ranks first go through salted parts of a language, so that no task ranks all its phrases.
    """
    counts = phrase_counts(docs, least, **sizes)
    alone = ~F.contains("phrase", F.lit(" "))
    words, phrases = counts.where(alone), counts.where(~alone)
    rows = scored(phrases, words).join(uncovered(phrases).select("lang", "phrase"), ["lang", "phrase"])
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALT))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return rows.join(counts.where("phrase IS NULL").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
