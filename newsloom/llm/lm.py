"""Language-model scores from an n-gram trie in Elias-Fano lists.

The model is a trigram model with interpolated absolute discounting. Its trie has three levels in files of the shared
folder: words by hash with their number, the successors of each word, and the successors of each pair. The
children of a node are a run of one increasing list (each is one more than its number and the last value of the run before), a second list
points to where runs begin, and probabilities and back-off weights are codes of their logarithms in steps of 1/512. On the third
level a word stands as its place among the successors of the word before it, so a question is asked relative to its
context. Tasks map the files and answer whole arrays of questions.

Texts are read twice: their words are counted, then written as numbers (from the most frequent word on, so that a word's
count follows from its number), which all later passes read. Counting passes emit packed blocks of n-grams by shard,
combined before the shuffle; a shard of a level is built by one task of bounded size. What is gathered grows with the
corpus: no n-gram is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.eliasfano import EliasFano
from newsloom.llm.files import combined, mapped, mounted, pack, save_arrays, unpack
from newsloom.llm.shared import fresh_dir, id_bucket, materialize
from newsloom.session import written

DISCOUNT = 0.75
#: One document in so many is held out of the counts.
HELD_OUT = 10
#: Codes a unit of the decimal logarithm.
STEPS = 512
#: The end of a text as a word: no word has a line break.
END = b"\n"
#: Tokens whose n-grams one shard holds, bytes of text and tokens that a task works on at a time, and n-grams that it gathers before it emits blocks.
SHARD_TOKENS, CHUNK, TOKENS, GATHER = 1 << 20, 1 << 22, 1 << 19, 1 << 20
#: Words that a worker remembers, and words with counts that it gathers before it adds them up.
CACHE, COUNTED = 300_000, 1_000_000


def code(p: np.ndarray) -> np.ndarray:
    """Probabilities (or weights up to 1) as codes."""
    with np.errstate(divide="ignore"):
        return np.clip(np.rint(-np.log10(p) * STEPS), 0, 65535).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Where the trie's files are, the counts N and V, shards by level, the distinct counts of words (falling) with the first number of each, and the number of each pair shard's first node."""

    folder: str
    tokens: int = 0
    words: int = 0
    shards: int = 1
    counts: tuple[int, ...] = ()
    first_word: tuple[int, ...] = ()
    first_node: tuple[int, ...] = ()

    def file(self, level: int, shard: int) -> str:
        return f"{self.folder}/level{level}-{shard}"

    def unigram(self, count: np.ndarray) -> np.ndarray:
        """Probability of a word by its count; 0 is any unknown word."""
        if not self.tokens:
            return np.full(len(count), 1.0 / (self.words + 1))
        return np.maximum(count - DISCOUNT, 0) / self.tokens + DISCOUNT * self.words / self.tokens / (self.words + 1)

    def unigram_codes(self, ids: np.ndarray) -> np.ndarray:
        """Codes of the words with these numbers, -1 an unknown word."""
        return code(self.unigram(np.array([*self.counts, 0], np.int64)))[self._place_of_count(ids)]

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of the words with these numbers, 0 of an unknown word."""
        return np.array([*self.counts, 0], np.int64)[self._place_of_count(ids)]

    def _place_of_count(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids >= 0, np.searchsorted(np.array(self.first_word, np.int64), ids, "right") - 1, -1)

    @property
    def number(self) -> np.dtype:
        """How the number of a word is written."""
        return np.dtype("<i4" if self.words < 1 << 31 else "<i8")

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.tokens + 0.1 * (self.words + 1)))


def _digests(words: list[bytes]) -> np.ndarray:
    """128 bits a word as two columns."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").reshape(-1, 2).astype(np.uint64)


def ranks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of numbers from 0 on in order, and each number's place among them."""
    place = len(x).bit_length()
    if int(x.max(initial=0)).bit_length() + place > 63:
        values, inverse = np.unique(x, return_inverse=True)
        return values, inverse
    key = x << place | np.arange(len(x))
    key.sort()  # sorts numbers faster than argsort
    values, inverse = key >> place, np.empty(len(x), np.int64)
    new = np.diff(values, prepend=-1) != 0
    inverse[key & ((1 << place) - 1)] = np.cumsum(new) - 1
    return values[new], inverse


def distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's place among the distinct pairs of numbers from 0 on, and these in order."""
    heads = tails = None
    wide, place = int(second.max(initial=0)).bit_length(), len(first).bit_length()
    if int(first.max(initial=0)).bit_length() + wide + place > 63:
        heads, first = ranks(first)
        if place + wide + place > 63:
            tails, second = ranks(second)
            wide = place
    pairs, inverse = ranks(first << wide | second)
    first, second = pairs >> wide, pairs & ((1 << wide) - 1)
    return inverse, first if heads is None else heads[first], second if tails is None else tails[second]


class Level:
    """Runs of children by head: the mapped shards of one level."""

    def __init__(self, model: Model, level: int):
        self.model, self.level = model, level
        self.open: dict[int, tuple] = {}

    def _shard(self, k: int) -> tuple:
        if k not in self.open:
            x = mapped(self.model.file(self.level, k))
            self.open[k] = EliasFano(x, "begin"), EliasFano(x, "child"), x["code"], x["weight"]
        return self.open[k]

    def find(self, head: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, ...]:
        """For heads and children (-1: none): each one's place among the distinct questions, and of these, in some order,
        head and child, the child's place in its shard and among its head's children (-1: not there), and its code, or
        if it isn't there the head's weight (0 if it has no children).

        Distinct questions go in order of shards, heads and children, so that a shard's lists are read from front to
        end: a head is read once, a run's first child is compared as it is read, other children are searched for.
        """
        shards = self.model.shards
        each = int(head.max(initial=0)) // shards + 1
        order = np.where(head >= 0, head % shards * each + head // shards + 1, 0)
        inverse, order, child = distinct(order, child + 1)
        child -= 1
        place, among, codes = np.full(len(order), -1, np.int64), np.full(len(order), -1, np.int64), np.zeros(len(order), np.int64)
        first = np.flatnonzero(np.diff(order, prepend=-1))
        heads = order[first]
        ends = np.searchsorted(heads, np.arange(shards + 1) * each + 1)
        first = np.append(first, len(order))
        for k in np.flatnonzero(np.diff(ends)).tolist():
            begin, children, code_of, weights = self._shard(k)
            own = heads[ends[k] : ends[k + 1]] - (k * each + 1)
            own = own[: np.searchsorted(own, begin.n - 1)]  # beyond are words that only end texts
            if not len(own) or not children.n:
                continue
            upto = first[ends[k] : ends[k] + len(own) + 1]
            asked = slice(int(upto[0]), int(upto[-1]))
            a, b = begin.spans(own)
            # The value before a run and its first one; nothing stands before the first run of a shard.
            before, value = children.spans(np.clip(a - 1, 0, children.n - 2)) if children.n > 1 else (children.get(np.zeros(len(a), np.int64)),) * 2
            front = np.searchsorted(a, 0, "right")
            value[:front] = before[:front]
            before[:front] = 0
            value[a == b] = np.iinfo(np.int64).max
            back, last = weights[own], np.where(b - a > 1, b, 0)
            if len(own) < asked.stop - asked.start:
                each_of = np.repeat(np.arange(len(own)), np.diff(upto))
                a, last, before, value, back = (x[each_of] for x in (a, last, before, value, back))
            target = before + child[asked] + 1
            found = np.where(target == value, a, -1)
            more = np.flatnonzero((target > value) & (last > 0))
            if len(more):
                met = children.find(target[more])
                found[more] = np.where(met < last[more], met, -1)
            held = np.flatnonzero(found >= 0)
            at = found[held]
            place[asked] = found
            codes[asked] = back
            held += asked.start
            codes[held] = code_of[at]
            among[held] = at - a[held - asked.start]
        order -= 1
        return inverse, np.where(order >= 0, order % each * shards + order // each, -1), child, place, among, codes


class Words:
    """A worker's view of the words: what it knows of one is held by slot."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.int64)

    def _learn(self, new: list[bytes]) -> None:
        """Numbers of new words, -1 the unknown ones."""
        keys, ids = _digests(new), np.full(len(new), -1, np.int64)
        shard = (keys[:, 0] % np.uint64(self.model.shards)).astype(np.int64)
        for k in np.unique(shard).tolist():
            x = mapped(self.model.file(1, k))
            rows = np.flatnonzero(shard == k)
            for tie in range(2):  # two words may share the first half
                at = np.searchsorted(x["high"], keys[rows, 0]) + tie
                inside = np.flatnonzero(at < len(x["high"]))
                same = inside[(x["high"][at[inside]] == keys[rows[inside], 0]) & (x["low"][at[inside]] == keys[rows[inside], 1])]
                ids[rows[same]] = x["id"][at[same]]
        self.slots.update(zip(new, range(len(self.ids), len(self.ids) + len(new))))
        self.ids = np.concatenate([self.ids, ids])

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of distinct words."""
        if len(self.slots) > CACHE:
            self._forget()
        slots = np.fromiter(map(self.slots.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = np.arange(len(self.ids), len(self.ids) + len(new))
            self._learn([words[k] for k in new.tolist()])
        ids = self.ids[slots]
        return ids, self.model.counts_of(ids)


class Trie:
    """A worker's view of the levels of pairs and triples."""

    def __init__(self, model: Model):
        self.model, self.pairs, self.triples = model, Level(model, 2), Level(model, 3)
        self.first_node = np.array(model.first_node or [0], np.int64)

    def contexts(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number before each token, the begin mark's before the first of a text."""
        before = np.concatenate([[-1], ids[:-1]])
        before[starts] = self.model.words
        return before

    def pair(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: its code after the word before; the node of the pair before (-1: none), and the token's place among the successors (-1: not there)."""
        inverse, head, child, place, among, codes = self.pairs.find(self.contexts(ids, starts), ids)
        there = place >= 0
        codes += np.where(there, 0, self.model.unigram_codes(child))
        place = np.where(there, self.first_node[head % self.model.shards] + place, -1)
        node = np.empty(len(ids), np.int64)
        node[1:] = place[inverse[:-1]]
        node[starts] = -1
        return codes[inverse], node, among[inverse]

    def log_probabilities(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Decimal logarithm of each token's probability after the two tokens before it."""
        low, node, among = self.pair(ids, starts)
        inverse, _, _, place, _, codes = self.triples.find(node, among)
        return np.where((place >= 0)[inverse], codes[inverse], codes[inverse] + low) / -STEPS


def split(texts: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """(first row, distinct words and the end as bytes, each token's place among them, where each text begins) of as many texts as make up a chunk."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, first = np.cumsum(size), 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] - size[first] + CHUNK, "right")))
        part = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.slice(first, last - first), "")))
        words, lengths = part.flatten(), pc.list_value_length(part).to_numpy(zero_copy_only=False)
        kept = pc.greater(pc.binary_length(words), 0)  # white space at the ends of a text leaves empty strings
        row = np.repeat(np.arange(last - first), lengths)[kept.to_numpy(zero_copy_only=False)]
        coded = words.filter(kept).dictionary_encode()
        starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=last - first) + 1)])
        at = np.full(starts[-1], len(coded.dictionary), np.int64)
        at[np.arange(len(row)) + row] = coded.indices.to_numpy(zero_copy_only=False)
        yield first, pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([END], pa.binary())]), at, starts[:-1]
        first = last


def chunks(texts: pa.Array) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray]]:
    """What `split` gives, words as a list."""
    for first, words, at, starts in split(texts):
        _, ends, flat = words.buffers()  # slices of the whole are made faster than Arrow's scalars
        ends, flat = np.frombuffer(ends, np.int32, len(words) + 1).tolist(), flat.to_pybytes()
        yield first, [flat[a:b] for a, b in zip(ends, ends[1:])], at, starts


def numbers(column: pa.Array, kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the words, where each text begins) of as many texts as make up a chunk."""
    size, first = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // kind.itemsize, 0
    upto = np.cumsum(size)
    _, ends, flat = column.buffers()  # read in place
    opens = int(np.frombuffer(ends, np.int32, 1, column.offset * 4)[0]) if len(column) else 0
    while first < len(column):
        begin = int(upto[first] - size[first])
        last = max(first + 1, int(np.searchsorted(upto, begin + TOKENS, "right")))
        ids = np.frombuffer(flat, kind, int(upto[last - 1]) - begin, opens + begin * kind.itemsize).astype(np.int64)
        yield ids, upto[first:last] - size[first:last] - begin
        first = last


def _vocabulary(docs: DataFrame, model: Model) -> Model:
    """Level 1: counts words in the tasks, numbers them from the most frequent on, and writes them by hash."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def added() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["word", "n"])

        for batch in batches:
            for _, words, at, _ in split(batch.column(0)):
                held.append(pa.table({"word": words, "n": np.bincount(at, minlength=len(words))}))
                size += len(words)
                if size > COUNTED:
                    held = [added()]
                    size = len(held[0])
                    if size > COUNTED // 2:
                        yield from held[0].to_batches()
                        held, size = [], 0
        if held:
            yield from added().to_batches()

    words = docs.select("text").mapInArrow(counted, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    words = written(words, "words")
    count, total = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    model = replace(model, tokens=total, words=count, shards=max(1, -(-total // SHARD_TOKENS)))
    ranked = words.repartitionByRange(max(1, -(-count // SHARD_TOKENS)), F.desc("n"), "word").sortWithinPartitions(F.desc("n"), "word")
    ranked = written(ranked.withColumn("m", F.monotonically_increasing_id()), "ranked")
    ranked = ranked.withColumn("part", F.shiftrightunsigned("m", 33))
    sizes = sorted((r["part"], r["n"]) for r in ranked.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row a partition
    first = [(part, before) for (part, _), before in zip(sizes, np.cumsum([0, *(n for _, n in sizes)]).tolist())]
    starts = F.broadcast(docs.sparkSession.createDataFrame(first, "part bigint, before bigint"))
    ranked = ranked.join(starts, "part").select("word", "n", (F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"))

    @F.pandas_udf("bigint")
    def shard_of(words: pd.Series) -> pd.Series:
        return pd.Series((_digests(list(map(bytes, words)))[:, 0] % np.uint64(model.shards)).astype(np.int64))

    def built(group: pd.DataFrame) -> pd.DataFrame:
        keys = _digests(list(map(bytes, group["word"])))
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        arrays = {"high": keys[order, 0], "low": keys[order, 1], "id": group["id"].to_numpy(model.number)[order]}
        save_arrays(model.file(1, int(group["shard"].iloc[0])), arrays)
        return pd.DataFrame({"shard": group["shard"].iloc[:1], "n": [len(group)]})

    held = sorted(((r["n"], r["words"]) for r in ranked.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)  # N tokens have no more than sqrt(2 N) different counts
    model = replace(model, counts=tuple(n for n, _ in held), first_word=tuple(np.cumsum([0, *(x for _, x in held[:-1])]).tolist()) if held else ())
    _written(ranked.withColumn("shard", shard_of("word")), built, lambda k: {"high": np.zeros(0, np.uint64), "low": np.zeros(0, np.uint64), "id": np.zeros(0, model.number)}, model, 1)
    return model


def _written(rows: DataFrame, build: Callable[[pd.DataFrame], pd.DataFrame], empty: Callable[[int], dict], model: Model, level: int) -> list[int]:
    """Builds the shards of a level in tasks; returns the number of entries of each (a number a shard comes to the driver)."""
    made = materialize(rows.groupBy("shard").applyInPandas(build, "shard bigint, n bigint"))
    sizes = {r["shard"]: r["n"] for r in made.collect()}
    for k in range(model.shards):
        if k not in sizes:
            save_arrays(model.file(level, k), empty(k))
    return [sizes.get(k, 0) for k in range(model.shards)]


def coded(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs but text, with n_tokens, n_known, base_score and ids: the numbers of a text's tokens (-1: unknown), one after another."""
    names = [c.split()[0] for c in CODED.split(", ")]

    @F.arrow_udf(CODED)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Words(model)
        for texts in batches:
            for _, words, at, starts in chunks(texts):
                ids, counts = known.look_up(words)
                sums = [np.add.reduceat(x[at], starts) for x in ((counts > 0).astype(np.int64), model.base(counts))]
                flat, ends = ids[at].astype(model.number).tobytes(), np.append(starts, len(at)) * model.number.itemsize
                blobs = pa.array([flat[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.binary())
                yield pa.StructArray.from_arrays([pa.array(np.diff(starts, append=len(at))), *map(pa.array, sums), blobs], names)

    return docs.withColumn("_s", found("text")).select(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], "_s.*")


def summed(head: np.ndarray, child: np.ndarray, low: np.ndarray, shards: int) -> tuple[np.ndarray, ...]:
    """Shard, head in it, child, count and code of the distinct n-grams, in order; the code depends on head and child."""
    each = int(head.max(initial=0)) // shards + 1
    head = head % shards * each + head // shards
    wide, more = (int(x.max(initial=0)).bit_length() for x in (child, low))
    if (each * shards).bit_length() + wide + more <= 63:
        key = (head << wide | child) << more | low
        key.sort()
        new = np.flatnonzero(np.diff(key, prepend=-1))
        n, key = np.diff(new, append=len(key)), key[new]
        low, key = key & ((1 << more) - 1), key >> more
        head, child = key >> wide, key & ((1 << wide) - 1)
    else:
        inverse, head, child = distinct(head, child)
        n, codes = np.bincount(inverse, minlength=len(head)), low
        low = np.zeros(len(head), np.int64)
        low[inverse] = codes
    return head // each, head % each, child, n, low


def _blocks(texts: DataFrame, model: Model, level: int) -> DataFrame:
    """n-grams as packed blocks by shard of their head: head, child, count, and on the third level the child's code one level down."""

    def emitted(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        shard, head, child, n, low = summed(*(np.concatenate(x) for x in zip(*held)), model.shards)
        ends = np.searchsorted(shard, np.arange(model.shards + 1))
        found = np.flatnonzero(np.diff(ends)).tolist()
        blobs = [pack(head[a:b], child[a:b], n[a:b], low[a:b]) for a, b in ((ends[k], ends[k + 1]) for k in found)]
        return pa.record_batch({"shard": pa.array(found, pa.int64()), "grams": pa.array(blobs, pa.binary())})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, n = Trie(model), [], 0
        for batch in batches:
            for ids, starts in numbers(batch.column(0), model.number):
                if level == 2:
                    rows = [trie.contexts(ids, starts), ids, np.zeros(len(ids), np.int64)]
                else:
                    codes, node, among = trie.pair(ids, starts)
                    inner = np.flatnonzero(node >= 0)
                    rows = [node[inner], among[inner], codes[inner]]
                held.append(rows)
                n += len(rows[0])
                if n >= GATHER:
                    yield emitted(held)
                    held, n = [], 0
        if n:
            yield emitted(held)

    return texts.select("ids").mapInArrow(counted, "shard bigint, grams binary")


def level_arrays(head: np.ndarray, child: np.ndarray, n: np.ndarray, low: np.ndarray, sampled: bool) -> dict[str, np.ndarray]:
    """One shard of a level from its n-grams in order of head and child: head numbers are dense, some may have no children."""
    size = int(head[-1]) + 1 if len(head) else 0
    kids = np.bincount(head, minlength=size)
    total = np.bincount(head, weights=n, minlength=size)
    begin = np.concatenate([[0], np.cumsum(kids)])
    last = np.where(kids > 0, child[np.maximum(begin[1:] - 1, 0)] + 1 if len(child) else 0, 0)
    base = np.cumsum(last) - last
    spare = np.divide(DISCOUNT * kids, total, out=np.ones(size), where=total > 0)
    p = np.maximum(n - DISCOUNT, 0) / total[head] + spare[head] * 10.0 ** (low / -STEPS)
    return {**EliasFano.arrays(begin, "begin"), **EliasFano.arrays(base[head] + child + 1, "child", sampled), "code": code(p).astype(np.uint16), "weight": code(spare).astype(np.uint16)}


def _level(texts: DataFrame, model: Model, level: int) -> list[int]:
    def built(group: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(bytes(x), 4) for x in group["grams"]]
        head, child, n, low = (np.concatenate(x) for x in zip(*parts))
        wide = int(child.max()).bit_length()
        key, n, (low,) = combined(head << wide | child, n, (low,))
        head, child = key >> wide, key & ((1 << wide) - 1)
        low = model.unigram_codes(child) if level == 2 else low
        save_arrays(model.file(level, int(group["shard"].iloc[0])), level_arrays(head, child, n, low, level == 2))
        return pd.DataFrame({"shard": group["shard"].iloc[:1], "n": [len(head)]})

    none = np.zeros(0, np.int64)
    return _written(_blocks(texts, model, level), built, lambda k: level_arrays(none, none, none, none, level == 2), model, level)


def start(docs: DataFrame) -> Model:
    """The words of all given documents, counted and written to the shared folder."""
    return _vocabulary(docs, Model(mounted(fresh_dir(docs.sparkSession, "lm"))))


def grown(texts: DataFrame, model: Model) -> Model:
    """The model with the pairs and triples of coded texts, all of whose words it knows."""
    sizes = _level(texts, model, 2)
    model = replace(model, first_node=tuple(np.cumsum([0, *sizes[:-1]]).tolist()))
    _level(texts, model, 3)
    return model


CODED = "n_tokens bigint, n_known bigint, base_score double, ids binary"


def scores(texts: DataFrame, model: Model) -> DataFrame:
    """The columns of coded texts but ids, with score."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = Trie(model)
        for batch in batches:
            for ids, starts in numbers(batch, model.number):
                yield pa.array(np.add.reduceat(trie.log_probabilities(ids, starts), starts))

    return texts.withColumn("_score", scored("ids")).select(*[F.col(f"`{c}`") for c in texts.columns if c != "ids"], F.col("_score").alias("score"))


def score_documents(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model is learned from the rows whose crc32(doc_id as text) modulo 10 is not 0, and scores all whole texts. A
    null or empty text is its end token alone; a null doc_id counts as the empty text, so is held out. Repeated rows
    each count and each get their row; other columns are ignored; an empty table gives an empty result. If nothing is
    learned from, every token is unknown and has probability 1.
    """
    held = id_bucket("doc_id", HELD_OUT) == 0
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    model = start(rows.where("NOT held_out"))
    texts = written(coded(rows, model), "coded", "zstd")
    model = grown(texts.where("NOT held_out"), model)
    return scores(texts, model).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
