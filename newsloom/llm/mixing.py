"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Each source's documents are laid end to end in the order of a hash, and the stream is cut into blocks of equally many
words: as long as the corpus size asks for, but shorter in a small source, which has some hundred blocks in any corpus
(if it has the words); its share of the slots grows as its blocks shrink. Slot i of the mix lies at the fractional part of i times the golden ratio; the source into whose share of the
cumulative weights it falls gets the slot. The slots of a source are ranked, and rank r takes block r modulo the
source's number of blocks. Ranks and positions are found in two levels (sums of buckets, then within a bucket), so
that no source, however large, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.shared import WORD, guarded_broadcast, materialize

#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: A source is taken so many times at most.
REPEATS = 3
#: The least number of words of a block, and the number of slots that longer blocks keep to.
LEAST_BLOCK, SLOTS = 16, 1 << 18
#: Blocks that each source has at least, unless they'd be shorter than LEAST_BLOCK.
SOURCE_BLOCKS = 1024
#: Hex digits of the hash that make a bucket of a source's stream; slots of a bucket of the schedule.
BUCKET_DIGITS = 3
SLOT_BUCKET = 1 << 12
#: Cells of the unit interval by which slots meet the sources' shares, as a number of low bits dropped.
CELL_BITS = 20
#: 2^32 over the golden ratio, to the nearest odd number, and 2^32.
GOLDEN, FULL = 2654435769, 4294967296
#: Parts of a slot in which shares are counted.
PARTS = 256
#: Equal rows beyond so many are laid into the stream by several tasks.
RUN = 1 << 12


def text_print(text: Column | str) -> Column:
    """The digest that stands for a text; null and empty are one."""
    return F.md5(F.coalesce(text, F.lit("")))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (the number of words of the whole text; null: 0), print (the text's digest) and m (equal rows), one row for all equal ones."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")
    return docs.select("doc_id", "source", size, text_print(F.col("text")).alias("print")).groupBy("doc_id", "source", "size", "print").agg(F.count("*").alias("m"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per source: source, place (in order, null last), source_size, target and total.

    Shares are in proportion to the weights; a source stops at `repeats` times its size and the excess is shared again.
    In the order of limit to weight the sources that stop come first: a source stops while its limit is not above its
    share of what the earlier ones left. The table has one row per source, so its windows are over few rows.
    """
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    per = per.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("place") % len(weights) + 1))
    per = per.withColumn("most", F.col("source_size") * repeats).withColumn("total", F.sum("source_size").over(everything))
    order = Window.orderBy(F.col("most") / F.col("weight"), "place")
    left = F.col("total") - F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("level", left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    first_open = F.when(F.col("most") > F.col("level") * F.col("weight"), F.struct((F.col("most") / F.col("weight")).alias("r"), "place", "level"))
    per = per.withColumn("shared", F.min(first_open).over(everything)["level"])
    most = F.col("most").cast("double")
    return per.select("source", "place", "source_size", F.coalesce(F.least(most, F.col("shared") * F.col("weight")), most).alias("target"), "total")


def block_words(total: int) -> int:
    """Words of a block: so many that the schedule keeps to SLOTS slots besides those of small sources, however large the corpus is."""
    return max(LEAST_BLOCK, -(-total // SLOTS))


def shares(sources: DataFrame, block: int) -> DataFrame:
    """Adds blocks (of the source's stream), parts (of slots it needs) and its interval [low, high) of the 2^32 points."""
    finest = F.ceil(F.col("source_size") / LEAST_BLOCK)
    rows = sources.withColumn("blocks", F.greatest(F.ceil(F.col("source_size") / block), F.least(finest, F.lit(SOURCE_BLOCKS))).cast("bigint"))
    need = F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") * PARTS + 0.5)).otherwise(0)
    rows = rows.withColumn("parts", need.cast("bigint"))
    order = Window.orderBy("place")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("all_parts", F.sum("parts").over(everything)).withColumn("upto", F.sum("parts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    edge = lambda x: F.expr(f"CAST({x} AS DECIMAL(19, 0)) * {FULL} div greatest(all_parts, 1)")
    return rows.withColumn("low", edge("upto - parts")).withColumn("high", edge("upto"))


def stream(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with words in their source's stream: doc_id, place, size, source_size, target, blocks, print and `at`, the words before.

    Buckets come from the id and the text together, so that no id that many rows share fills one; equal rows lie in
    the stream as one run and are told apart after the sums.
    """
    known = guarded_broadcast(sources.select(F.col("source").alias("s"), "place", "source_size", "target", "blocks"))
    rows = sizes.where("size > 0").join(known, F.col("source").eqNullSafe(F.col("s")), "left")
    rows = rows.withColumn("turn", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "print")))
    rows = rows.withColumn("bucket", F.substring("turn", 1, BUCKET_DIGITS))
    sums = rows.groupBy("place", "bucket").agg(F.sum(F.col("size") * F.col("m")).alias("held"))
    before = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("place", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("place", "bucket").orderBy("turn", "doc_id", "print").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum(F.col("size") * F.col("m")).over(within), F.lit(0)))
    rows = rows.join(sums, ["place", "bucket"]).withColumn("at", F.col("base") + F.col("inner"))
    columns = ["doc_id", "place", "size", "source_size", "target", "blocks", "print"]
    few = rows.where(F.col("m") <= RUN).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)))
    runs = rows.where(F.col("m") > RUN).withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1, F.lit(RUN).cast("bigint"))))
    many = runs.repartition("run", "turn").withColumn("k", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + RUN, F.col("m")) - 1)))
    at = (F.col("at") + F.col("k") * F.col("size")).alias("at")
    return few.select(*columns, at).unionByName(many.select(*columns, at))


def schedule(spans: DataFrame, slots: int, repeats: int = REPEATS) -> DataFrame:
    """Slots of the mix: slot, place (of the source), rank (of the slot in its source) and block.

    Points meet intervals through the cells of the unit interval that they share, an equi-join. A slot beyond
    `repeats` rounds of its source is left out.
    """
    spark = spans.sparkSession
    runs = spark.range(-(-slots // SLOT_BUCKET)).withColumnRenamed("id", "run")
    begin = F.col("run") * SLOT_BUCKET
    points = runs.select("run", F.explode(F.sequence(begin, F.least(begin + SLOT_BUCKET, F.lit(slots)) - 1)).alias("slot"))
    points = points.withColumn("point", F.col("slot") * GOLDEN % FULL).withColumn("cell", F.shiftright("point", CELL_BITS))
    cells = F.explode(F.sequence(F.shiftright("low", CELL_BITS), F.shiftright(F.col("high") - 1, CELL_BITS))).alias("cell")
    met = points.join(spans.where("high > low").select("place", "blocks", "low", "high", cells), "cell").where("point >= low AND point < high")
    counts = met.groupBy("place", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("place").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("place", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = met.withColumn("inner", F.row_number().over(Window.partitionBy("place", "run").orderBy("slot")) - 1)
    ranked = ranked.join(counts, ["place", "run"]).withColumn("rank", F.col("base") + F.col("inner"))
    return ranked.where(F.col("rank") < F.col("blocks") * repeats).select("slot", "place", "rank", (F.col("rank") % F.col("blocks")).alias("block"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """documents -> doc_id, source, size, source_size, target, taken (words that the mix takes, repeats counted), print (digest of the text).

    Null and empty texts have size 0 and are taken 0 times; a null source is a source of its own, the last; repeated
    rows and null ids are documents of their own; an empty table gives an empty result; other columns, also of clashing
    names, are ignored. Only the corpus size and the number of slots come to the driver. The tables of one row per
    source pass through one task, in order of their names, which the weights follow.
    """
    sizes = materialize(sized(docs))
    sources = materialize(targets(sizes, weights, repeats))
    total = (sources.agg(F.max("total")).first()[0]) or 0
    block = block_words(total)
    spans = materialize(shares(sources, block))
    slots = -(-(spans.agg(F.max("all_parts")).first()[0] or 0) // PARTS)
    copies = schedule(spans, slots, repeats).groupBy("place", "block").agg(F.count("*").alias("copies"))
    # Block b of a source is its words from b * size div blocks to (b + 1) * size div blocks.
    holder = lambda word: F.expr(f"(({word}) * blocks + blocks - 1) div source_size")  # noqa: E731  the last block that can begin at or before a word
    placed = stream(sizes, spans)
    pieces = placed.withColumn("block", F.explode(F.sequence(F.greatest(holder("at") - 1, F.lit(0)), F.least(holder("at + size - 1"), F.col("blocks") - 1))))
    low = F.greatest(F.col("at"), F.expr("block * source_size div blocks"))
    high = F.least(F.col("at") + F.col("size"), F.expr("(block + 1) * source_size div blocks"))
    pieces = pieces.withColumn("words", high - low).where("words > 0")
    met = pieces.join(copies, ["place", "block"], "left")
    taken = met.groupBy("doc_id", "place", "at", "size", "source_size", "target", "print").agg(F.sum(F.col("words") * F.coalesce("copies", F.lit(0))).alias("taken"))
    known = guarded_broadcast(spans.select("source", "place"))
    full = taken.join(known, "place").select("doc_id", "source", "size", "source_size", "target", "taken", "print")
    about = guarded_broadcast(spans.select(F.col("source").alias("s"), "source_size", "target"))
    empty = sizes.where("size = 0").withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), "m"))).join(about, F.col("source").eqNullSafe(F.col("s")), "left")
    return full.unionByName(empty.select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"), "print"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The mix as whole documents: each row as many times as the schedule takes it, to the nearest whole number.

    Equal rows (doc_id, source and text) share what they take; null and empty texts are never taken; null ids and
    sources count as values of their own; an empty table gives an empty result. All columns stay.
    """
    rate = mix(docs, weights, repeats).groupBy(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("print").alias("_p"))
    rate = rate.agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("_rate")).where("_rate >= 0.5")
    same = text_print(docs["text"]) == F.col("_p")
    met = docs.join(rate, same & docs["doc_id"].eqNullSafe(F.col("_d")) & docs["source"].eqNullSafe(F.col("_s")))
    return met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.floor(F.col("_rate") + 0.5).cast("int")))).select(*[docs[c] for c in docs.columns])
