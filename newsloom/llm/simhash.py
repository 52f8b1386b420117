"""SimHash near-duplicates by covering locality-sensitive hashing.

Every fingerprint bit gets a non-zero vector of r + 1 bits; each non-zero vector v of that space is one table, whose
mask keeps the bits whose vector has an odd inner product with v. Up to r differing bits give r linear conditions on
v, which leave a non-zero solution: some mask ignores all of them. So every pair within the radius shares a bucket of
some table, without exception.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.shared import guarded_broadcast, is_few, materialize, maybe_in
from newsloom.operators.graph import linked

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: Buckets up to this many distinct fingerprints are compared pair by pair within one row.
SMALL_BUCKET = 64
#: Refinements of a large bucket by masks of its free bits, before its rest is compared in blocks.
LEVELS = 3
#: The near-duplicate stage of a pipeline: words of a shingle, and the least Jaccard similarity of two sets of shingles.
STAGE_WORDS, SIMILAR = 5, 0.8
#: Its sketch: parts of SYMBOLS min-hashes of SYMBOL_BITS bits, and the radius (in symbols) that the masks of each part cover.
PARTS, SYMBOLS, SYMBOL_BITS, PART_RADIUS = 2, 8, 8, 3
#: The most fingerprint bits in which a candidate may differ: at a similarity of 0.8 the mean is 9.7 and the deviation 2.9, at none 32 and 4.
PAIR_BITS = 26
#: Buckets of more nodes than this meet by way of a pivot.
PIVOT_BUCKET = 32
#: Sets of a block that are compared with those of another at a time.
BLOCK = 2048
#: Rows of a task that are hashed under all masks.
TASK_ROWS = 20_000
#: Odd multipliers of the sketch's hash functions: a golden-ratio sequence.
MULTIPLIERS = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) | 1) & (1 << 64) - 1 for k in range(PARTS * SYMBOLS)], dtype="<u8")


def simhash64(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint as a signed 64-bit number; bit k is set if more than half of the shingle hashes have it, repeats counted."""
    hashes = _shingle_hashes(_tokens(text), words)
    return _majority(hashes) if len(hashes) else 0


def fingerprint(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """simhash64 of a text column, in Arrow batches."""

    @F.pandas_udf("bigint")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash64(x, words) for x in texts], dtype="int64")

    return hashed(text)


def covering_masks(radius: int = RADIUS, bits: range | list[int] = range(64), turn: int = 0) -> list[int]:
    """2^(radius+1) - 1 masks over `bits`, of which one at least misses any `radius` given bits.

    Up to 2^radius bits get vectors with the highest coordinate set, so that every mask keeps half of 2^radius bits, or
    all of them; more bits get all vectors in turn.
    """
    size, half = 2 ** (radius + 1) - 1, 2**radius
    vector = {bit: half + (k + turn) % half if len(bits) <= half else (k + turn) % size + 1 for k, bit in enumerate(bits)}
    return [sum(1 << b for b, x in vector.items() if (x & v).bit_count() % 2) for v in range(1, size + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keyed(rows: DataFrame, radius: int, level: int) -> DataFrame:
    """Each fingerprint under each mask; from the second level on, the bits that the bucket already shares stay in the key."""
    masks = F.array(*[F.lit(_signed(m)).cast("bigint") for m in covering_masks(radius, turn=5 * level)])
    kept = F.col("kept") if level else F.lit(0).cast("bigint")
    table = F.col("table") * len(covering_masks(radius)) if level else F.lit(0)
    rows = rows.select("fp", kept.alias("was"), table.alias("base"), F.posexplode(masks).alias("t", "mask"))
    mask = F.col("was").bitwiseOR(F.col("mask"))
    return rows.select("fp", (F.col("base") + F.col("t")).cast("bigint").alias("table"), mask.alias("kept"), F.col("fp").bitwiseAND(mask).alias("key"))


def _shared_buckets(rows: DataFrame) -> DataFrame:
    """Rows whose bucket holds another fingerprint, with the bucket's size, its least fingerprint and the number of bits in which it varies.

    Buckets are counted by an aggregate that combines before the shuffle; only the shared ones meet their rows again.
    """
    held = rows.groupBy("table", "kept", "key").agg(F.count("*").alias("n"), F.bit_or("fp").alias("some"), F.bit_and("fp").alias("every"), F.min("fp").alias("low"))
    held = held.where("n > 1").selectExpr("table", "key", "n", "low", "bit_count(some ^ every) AS varying")
    return rows.join(held, ["table", "key"])


def _pairs_in_rows(rows: DataFrame, radius: int) -> DataFrame:
    """Links within small buckets: each bucket is one row, and only links leave it."""
    bucket = rows.groupBy("table", "kept", "key").agg(F.sort_array(F.collect_list("fp")).alias("all"))
    near = F.filter("all", lambda x: (x > F.col("one")) & (F.bit_count(x.bitwiseXOR(F.col("one"))) <= radius))
    return bucket.select("all", F.explode("all").alias("one")).select(F.col("one").alias("u"), F.explode(near).alias("v"))


def _pairs_in_blocks(rows: DataFrame, radius: int, block: int) -> DataFrame:
    """Links of buckets that no mask can split further: blocks of a bounded size meet pair by pair."""
    dealt = rows.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("b", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    one = dealt.select("table", "key", F.col("fp").alias("u"), "b", F.explode(F.expr("sequence(b, blocks - 1)")).alias("c"))
    two = dealt.select("table", "key", F.col("fp").alias("v"), F.explode(F.expr("sequence(0, b)")).alias("b"), F.col("b").alias("c"))
    met = one.join(two, ["table", "key", "b", "c"])
    return met.where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)).select("u", "v")


def links(fingerprints: DataFrame, radius: int = RADIUS, small: int = SMALL_BUCKET, levels: int = LEVELS) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v) between them, whose components are those of all pairs within `radius` bits.

    A bucket that varies in at most `radius` bits is linked as a star; a small one pair by pair; a larger one is
    hashed again by masks of the bits it doesn't share, which again lose no pair, and after `levels` rounds what is
    left is compared in blocks. No bucket is capped.
    """
    found, rows = [], fingerprints.select("fp")
    for level in range(levels):
        met = materialize(_shared_buckets(_keyed(rows, radius, level)))
        star, few = F.col("varying") <= radius, F.col("n") <= small
        found.append(met.where(star).select(F.col("low").alias("u"), F.col("fp").alias("v")).where("u <> v"))
        found.append(_pairs_in_rows(met.where(~star & few), radius))
        rows = met.where(~star & ~few)
        if rows.isEmpty():
            break
    else:
        found.append(_pairs_in_blocks(rows, radius, small * 16))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """documents -> doc_id, fp (bigint), component_id: the smallest doc_id reachable through links of `radius` bits.

    Fingerprints are the nodes, so rows without a doc_id link and bridge like any other; they name no component, and
    where a whole group has no doc_id, component_id is null. Null and empty texts have the fingerprint zero and link
    like any other. Equal fingerprints meet in a map-side combined aggregate first, so a group of copies counts once
    however large it is. Repeated rows each get their row; an empty table gives an empty result; other columns are
    ignored.
    """
    prints = materialize(docs.select("doc_id", fingerprint(F.col("text"), words).alias("fp")))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("id"))
    named = linked(links(distinct, radius)).withColumnRenamed("id", "fp")
    placed = materialize(distinct.join(named, "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("component")))
    least = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    labels = placed.join(least, "component").select("fp", "component_id")
    return prints.join(labels, "fp", "left").select("doc_id", "fp", "component_id")


def fingerprint_hex(column: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def _tokens(text: str | None) -> list[bytes]:
    """The text's words in lower case (A-Z)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _shingle_hashes(tokens: list[bytes], words: int) -> np.ndarray:
    """Hashes of all runs of `words` words; a shorter text is one run, an empty text has none."""
    if not tokens:
        return np.zeros(0, "<u8")
    line, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) < words:
        return np.array([digest(line, SEED)], dtype="<u8")
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist()
    return np.array([digest(line[a:b], SEED) for a, b in zip(first, last)], dtype="<u8")


def _shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles of a text, as signed numbers."""
    return np.unique(_shingle_hashes(_tokens(text), words)).view("<i8")


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def _stirred(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(32))


def sketch(hashes: np.ndarray) -> list[int]:
    """PARTS signed 64-bit numbers: per part SYMBOLS symbols, each the low bits of the least of the hashes under an own function."""
    least = [int(_stirred(hashes * m).min()) & (1 << SYMBOL_BITS) - 1 for m in MULTIPLIERS]
    whole = (sum(x << SYMBOL_BITS * k for k, x in enumerate(least[a : a + SYMBOLS])) for a in range(0, len(least), SYMBOLS))
    return [x - (1 << 64) if x >> 63 else x for x in whole]


def _stage_node(text: str | None, words: int) -> tuple[str, int, list[int], int]:
    """128 bits for the text but for case and spacing, its fingerprint, its sketch, and its shingles' number."""
    tokens = _tokens(text)
    digest = xxhash.xxh3_128_hexdigest(b" ".join(tokens))
    hashes = np.unique(_shingle_hashes(tokens, words))
    if not len(hashes):
        return digest, 0, [0] * PARTS, 0
    return digest, _majority(hashes), sketch(hashes), len(hashes)


def stage_nodes(docs: DataFrame, words: int = STAGE_WORDS) -> DataFrame:
    """One row per distinct text (but for case and spacing): digest, who (its least doc_id, null last, and a hash of that row), fp, sketch, n (shingles)."""

    @F.pandas_udf("digest string, fp bigint, sketch array<bigint>, n int")
    def hashed(texts: pd.Series) -> pd.DataFrame:
        rows = [_stage_node(x, words) for x in texts]
        return pd.DataFrame(rows, columns=["digest", "fp", "sketch", "n"]).astype({"fp": "int64", "n": "int32"})

    who = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), row_hash(docs).alias("row"))
    rows = docs.select(who.alias("who"), hashed("text").alias("s")).select("who", "s.*")
    return rows.groupBy("digest").agg(F.min("who").alias("who"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.first("n").alias("n"))


def numbered(nodes: DataFrame) -> DataFrame:
    """Nodes with a number each, which stays theirs since the table is written."""
    return materialize(nodes.withColumn("node", F.monotonically_increasing_id()))


def row_hash(docs: DataFrame) -> Column:
    """128 bits for a whole row as text, nulls told from empty values."""
    parts = [x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`").cast("string"))]
    return F.concat(F.hex(F.xxhash64(*parts)), F.lit(":"), F.hex(F.xxhash64(F.lit("second"), *parts)))


def part_masks() -> list[tuple[int, int]]:
    """(part, mask) of every table: two sketches that differ in PARTS * (PART_RADIUS + 1) - 1 symbols at most agree under some mask.

    The masks cover symbols, so the bits of a symbol are kept or left out together.
    """
    symbol = (1 << SYMBOL_BITS) - 1
    spread = lambda mask: sum(symbol << SYMBOL_BITS * k for k in range(SYMBOLS) if mask >> k & 1)
    return [(part, spread(m)) for part in range(PARTS) for m in covering_masks(PART_RADIUS, range(SYMBOLS))]


def _could_be_near(a: str, b: str) -> Column:
    """Sizes that allow the similarity, and fingerprints that don't speak against it."""
    small, large = F.least(f"{a}n", f"{b}n"), F.greatest(f"{a}n", f"{b}n")
    return (small >= SIMILAR * large - 1e-9) & (F.bit_count(F.col(f"{a}fp").bitwiseXOR(F.col(f"{b}fp"))) <= PAIR_BITS)


def _bucketed(nodes: DataFrame) -> DataFrame:
    """node, fp and n under every mask's key: a hash of the table's number and the symbols that its mask keeps."""
    keys = [F.xxhash64(F.lit(k), F.element_at("sketch", part + 1).bitwiseAND(F.lit(_signed(m)).cast("bigint"))) for k, (part, m) in enumerate(part_masks())]
    return nodes.select("node", "fp", "n", F.explode(F.array(*keys)).alias("key"))


def _pivots(rows: DataFrame) -> DataFrame:
    """Per bucket (key) the node nearest to the majority of its fingerprints' bits: p, pfp, pn. The original of a group of copies lies there."""
    one = F.lit(1).cast("bigint")
    ones = [F.sum(F.shiftrightunsigned("nodefp", k).bitwiseAND(one)).alias(f"b{k}") for k in range(64)]
    sums = rows.groupBy("key").agg(F.count("*").alias("n"), *ones)
    major = sum((F.when(2 * F.col(f"b{k}") > F.col("n"), F.lit(_signed(1 << k)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k in range(64)), F.lit(0).cast("bigint"))
    sums = guarded_broadcast(materialize(sums.select("key", major.alias("major"))))
    gap = F.bit_count(F.col("nodefp").bitwiseXOR(F.col("major"))).alias("gap")
    best = rows.join(sums, "key").groupBy("key").agg(F.min(F.struct(gap, "node", "nodefp", "noden")).alias("best"))
    return best.select("key", F.col("best.node").alias("p"), F.col("best.nodefp").alias("pfp"), F.col("best.noden").alias("pn"))


def _sets(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, grams: the shingle sets of the wanted nodes (node)."""

    @F.pandas_udf("array<bigint>")
    def shingled(texts: pd.Series) -> pd.Series:
        return pd.Series([_shingles(x, words) for x in texts])

    wanted = materialize(nodes.join(wanted.select("node").distinct(), "node").select("node", F.col("who.row").alias("row")))
    rows = docs.select(row_hash(docs).alias("row"), "text")
    if is_few(wanted):
        rows = rows.join(F.broadcast(wanted), "row")
    else:
        rows = maybe_in(rows, wanted, "row").where("_maybe").drop("_maybe").join(wanted, "row")
    return materialize(rows.select("node", shingled("text").alias("grams")).groupBy("node").agg(F.first("grams").alias("grams")))


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """The pairs (u, v) of nodes whose shingle sets have a Jaccard similarity of SIMILAR or more."""
    pairs = materialize(pairs)
    sets = _sets(pairs.select(F.explode(F.array("u", "v")).alias("node")), docs, nodes, words)
    met = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    met = met.withColumn("both", F.size(F.array_intersect("a", "b"))).withColumn("any", F.size("a") + F.size("b") - F.col("both"))
    return materialize(met.where(F.col("both") >= SIMILAR * F.col("any") - 1e-9).select("u", "v"))


def shared_counts(one: list[np.ndarray], two: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every set of `one` with every set of `two`, by products of 0/1 matrices of at most `width` columns."""
    out = np.zeros((len(one), len(two)), np.float32)
    common = np.intersect1d(np.concatenate(one), np.concatenate(two))
    cells = []
    for sets in (one, two):
        row, value = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        column = np.searchsorted(common, value)
        known = column < len(common)
        known[known] = common[column[known]] == value[known]
        order = np.argsort(column[known], kind="stable")
        cells.append((row[known][order], column[known][order]))
    for at in range(0, len(common), width):
        parts = []
        for (row, column), sets in zip(cells, (one, two)):
            a, b = np.searchsorted(column, [at, at + width])
            part = np.zeros((len(sets), min(width, len(common) - at)), np.float32)
            part[row[a:b], column[a:b] - at] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _linked_in_block(group: pd.DataFrame) -> pd.DataFrame:
    """One link from each lone node of a block to each other component that it is similar to."""
    one, two = group[group["lone"]], group[~group["lone"]]
    if not len(one) or not len(two):
        return pd.DataFrame({"u": [], "v": []})
    both = shared_counts(list(one["grams"]), list(two["grams"]))
    sizes = [x["grams"].map(len).to_numpy() for x in (one, two)]
    near = both >= SIMILAR * (sizes[0][:, None] + sizes[1][None, :] - both) - 1e-9
    near &= one["c"].to_numpy()[:, None] != two["c"].to_numpy()[None, :]
    i, j = np.nonzero(near)
    found = pd.DataFrame({"u": one["node"].to_numpy()[i], "v": two["node"].to_numpy()[j], "c": two["c"].to_numpy()[j]})
    return found.drop_duplicates(["u", "c"])[["u", "v"]]


def _lone_links(known: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, block: int) -> DataFrame:
    """Links of the nodes of crowded buckets that are in another component than a pivot of theirs.

    Buckets that share nodes make up a group. The lone nodes of a group meet all its nodes in blocks of bounded size,
    where similarities come from matrix products: a set is sent once for every block that it meets, no pair is a row.
    """
    lone = known.where("c <> head")
    touched = materialize(known.join(lone.select("key").distinct(), "key", "left_semi").select("key", "node", "c"))
    heads = touched.groupBy("key").agg(F.min("node").alias("v"))
    groups = linked(touched.join(heads, "key").select(F.col("node").alias("u"), "v")).withColumnRenamed("id", "node")
    rows = touched.select("node", "c").distinct().join(groups, "node", "left").withColumn("g", F.coalesce("component", "node"))
    rows = materialize(rows.join(lone.select("node").distinct().withColumn("l", F.lit(True)), "node", "left").select("g", "node", "c", F.col("l").isNotNull().alias("is_lone")))
    sizes = rows.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("n_all"), F.ceil(F.sum(F.col("is_lone").cast("int")) / block).cast("int").alias("n_lone"))
    rows = rows.join(_sets(rows, docs, nodes, words), "node").join(sizes, "g")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = rows.where("is_lone").select("g", "node", "c", "grams", F.lit(True).alias("lone"), own("n_lone").alias("a"), each("n_all").alias("b"))
    two = rows.select("g", "node", "c", "grams", F.lit(False).alias("lone"), own("n_all").alias("b"), each("n_lone").alias("a"))
    met = one.unionByName(two).groupBy("g", "a", "b").applyInPandas(_linked_in_block, "u bigint, v bigint")
    return materialize(met)


def similar_links(docs: DataFrame, nodes: DataFrame, small: int = PIVOT_BUCKET, words: int = STAGE_WORDS, block: int = BLOCK) -> DataFrame:
    """Links (u, v) whose components are those of all candidate pairs with a shingle Jaccard of SIMILAR or more.

    Candidates share a bucket of some mask; their sizes allow the similarity and their fingerprints differ in at most
    PAIR_BITS bits. A key has SYMBOLS / 2 * SYMBOL_BITS bits, so buckets stay small up to some 2^32 texts. The nodes of
    a bucket of more than `small` meet its pivot first, each the pivot it is nearest to; those that are still in
    another component than a pivot of theirs then meet all nodes of their buckets, in blocks. So a large group of near
    copies makes few pairs, and no pair that could join two components is left out.
    """
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, nodes.count() // TASK_ROWS)
    rows = _bucketed(nodes.select("node", "fp", "sketch", "n").repartition(tasks))
    crowded = materialize(rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > small).select("key"))
    few = rows.join(guarded_broadcast(crowded), "key", "left_anti")
    one, two = (few.select("key", F.col("node").alias(n), F.col("fp").alias(f"{n}fp"), F.col("n").alias(f"{n}n")) for n in "uv")
    pairs = one.join(two, "key").where((F.col("u") < F.col("v")) & _could_be_near("u", "v")).select("u", "v")
    if crowded.isEmpty():
        return _verified(pairs.distinct(), docs, nodes, words)
    many = materialize(rows.join(guarded_broadcast(crowded), "key").withColumnsRenamed({"fp": "nodefp", "n": "noden"}))
    many = many.join(guarded_broadcast(materialize(_pivots(many))), "key")
    star = many.where((F.col("node") != F.col("p")) & _could_be_near("p", "node"))
    nearest = F.min(F.struct(F.bit_count(F.col("pfp").bitwiseXOR(F.col("nodefp"))).alias("bits"), "p"))
    pairs = pairs.unionByName(star.groupBy("node").agg(nearest.alias("to")).select(F.col("to.p").alias("u"), F.col("node").alias("v")))
    found = _verified(pairs.distinct(), docs, nodes, words)
    named = materialize(linked(found).withColumnRenamed("id", "node"))
    known = many.select("key", "node", "p").join(named, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    heads = named.select(F.col("node").alias("p"), F.col("component").alias("head"))
    known = materialize(known.join(heads, "p", "left").select("key", "node", "c", F.coalesce("head", "p").alias("head")))
    return found.unionByName(_lone_links(known, docs, nodes, words, block))


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """Drops every document but one of each group: that with the smallest doc_id (null last). Columns stay as they are.

    A group is joined by five-word shingle sets with a Jaccard similarity of 0.8 or more; texts that are equal but for
    case and spacing are one, null and empty texts among them. Rows of one doc_id with different texts are documents
    of their own; of rows that share doc_id and text the one with the least hash of all its columns stays, so that
    reruns agree. An empty table gives an empty result; other columns, whatever their names, take no part.
    """
    nodes = numbered(stage_nodes(docs))
    named = linked(similar_links(docs, nodes.where(F.col("n") > 0))).withColumnRenamed("id", "node")
    kept = nodes.join(named, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("who").alias("who"))
    kept = kept.select(F.col("who.row").alias("_row"), F.lit(True).alias("_kept")).distinct()
    rows = docs.withColumn("_row", row_hash(docs))
    # Equal rows have equal hashes: they are few or many, but one short key, combined before the shuffle.
    counted = rows.groupBy("_row").agg(F.count("*").alias("_n")).join(kept, "_row", "left")
    odd = materialize(counted.where("_kept IS NULL OR _n > 1").select("_row", F.col("_kept").isNotNull().alias("_again")))
    few = is_few(odd)
    rest = rows if few else maybe_in(rows, odd, "_row")
    # Where odd rows are many, texts are shuffled only if a bitmap doesn't clear them.
    clear = rest.where("1 = 0" if few else "NOT _maybe").drop("_maybe")
    rest, odd = (rows, F.broadcast(odd)) if few else (rest.where("_maybe").drop("_maybe"), odd)
    single = rest.join(odd, "_row", "left_anti").unionByName(clear)
    return single.drop("_row").unionByName(rest.join(odd.where("_again"), "_row", "left_semi").drop("_row").distinct())
