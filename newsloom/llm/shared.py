"""The few expressions that several training-data operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import BROADCAST_ROWS, fresh_dir, guarded_broadcast, is_few, materialize, shared_dir

__all__ = ["BROADCAST_ROWS", "WORD", "documents", "fresh_dir", "guarded_broadcast", "id_bucket", "is_few", "materialize", "maybe_in", "shared_dir"]

#: A word: a run of anything but a space or the ASCII control white space.
WORD = r"[^\x20\x09-\x0D]+"

#: The bitmap of maybe_in: BLOCKS blocks of WORDS words of 64 bits, 2 MB in all, however many the keys are.
BLOCKS, WORDS = 4096, 64


def maybe_in(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows with `_maybe`: false only where their key is none of the wanted ones, so that a join need not shuffle them.

    A bitmap holds a bit per hash of a key. It is small enough to be broadcast and never grows, so rows of many wanted
    keys pass more often, but none is lost. `wanted` is a materialized table.
    """
    place = F.pmod(F.xxhash64(key), F.lit(BLOCKS * WORDS * 64)).cast("int")
    word, bit = F.shiftright(place, 6) % WORDS, place.bitwiseAND(F.lit(63))
    block = F.shiftright(place, 6 + (WORDS - 1).bit_length())
    bits = wanted.select(block.alias("_block"), word.alias("_word"), F.expr("1L").alias("_one"), bit.alias("_bit"))
    bits = bits.groupBy("_block", "_word").agg(F.bit_or(F.expr("shiftleft(_one, _bit)")).alias("_bits"))
    held = bits.groupBy("_block").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_map"))
    words = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.coalesce(F.element_at("_map", w), F.lit(0).cast("bigint")))
    held = materialize(held.select("_block", words.alias("_words")))
    met = rows.withColumns({"_block": block, "_word": word, "_bit": bit}).join(F.broadcast(held), "_block", "left")
    maybe = F.expr("coalesce(bit_get(element_at(_words, _word + 1), _bit) = 1, false)")
    return met.withColumn("_maybe", maybe).drop("_block", "_word", "_bit", "_words")


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
