"""Fill-in-middle by run-length class encoding.

A text is stored as maximal runs of one character class (the class that ends units, and the rest) with the number of
units that are complete after each run. A cut after so many units is found by a binary search for its run; the offset
in the run is arithmetic. Only the two offsets leave the tasks' Python: the text is cut, put together and restored by
built-in functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 7
#: Percent of the texts that are transformed, and of these that put the suffix first.
RATE, SUFFIX_FIRST = 100, 50
#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = MARKS = "<P>", "<S>", "<M>"
#: Kinds of units: the characters that end one, and whether each of a run's characters ends one or the run as a whole.
UNITS = {"line": ("\n", True), "word": (" \t\n\x0b\x0c\r", False), "char": (None, True)}


@dataclass
class Runs:
    """Begin of each run and of the text's end, whether it ends units, and the units complete after it."""

    begins: np.ndarray
    ends_units: np.ndarray
    upto: np.ndarray
    each: bool

    @property
    def units(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def offsets(self, cuts: np.ndarray) -> np.ndarray:
        """Characters before these numbers of units."""
        run = np.searchsorted(self.upto, cuts)
        if not len(self.upto):
            return np.zeros(len(cuts), np.int64)
        within = self.ends_units[run] & self.each
        before = self.upto[run] - np.diff(self.begins)[run]
        at = np.where(within, self.begins[run] + cuts - before, self.begins[run + 1])
        return np.where(cuts > 0, at, 0)


def encode(text: str, unit: str = "line") -> Runs:
    """The runs of a text; its last run completes a unit in any case."""
    ends, each = UNITS[unit]
    points = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    of_class = np.ones(len(points), bool) if ends is None else np.isin(points, [ord(c) for c in ends])
    begins = np.flatnonzero(np.diff(of_class, prepend=~of_class[:1]))
    kind = of_class[begins]
    begins = np.append(begins, len(points))
    counts = np.where(kind, np.diff(begins) if each else 1, 0)
    if len(kind) and not kind[-1]:
        counts[-1] = 1
    return Runs(begins, kind, np.cumsum(counts), each)


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 from the seed and an id; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def _cut(unit: str):
    @F.pandas_udf("n bigint, first int, second int")
    def cut(texts: pd.Series, ones: pd.Series, twos: pd.Series) -> pd.DataFrame:
        rows = []
        for text, one, two in zip(texts, ones, twos):
            runs = encode(text, unit)
            low, high = sorted((one % (runs.units + 1), two % (runs.units + 1)))
            rows.append((runs.units, *runs.offsets(np.array([low, high])).tolist()))
        return pd.DataFrame(rows, columns=["n", "first", "second"])

    return cut


def transform(docs: DataFrame, unit: str = "line", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """documents -> doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output.

    The cuts and the form come from the seed and doc_id alone. A null text counts as empty; empty texts and those that
    hold a mark stay plain, with null lengths. Whole texts of any length; repeated rows and null ids each get their
    row; other columns are ignored; an empty table gives an empty result.
    """
    one, two, three, four = draws(F.col("doc_id"), seed)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), one.alias("h1"), two.alias("h2"), three.alias("h3"), four.alias("h4"))
    rows = rows.withColumn("c", _cut(unit)("text", "h1", "h2")).select("*", "c.*")
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    prefix = F.substring("text", F.lit(1), F.col("first"))
    middle = F.substring("text", F.col("first") + 1, F.col("second") - F.col("first"))
    suffix = F.substring("text", F.col("second") + 1, F.lit(0x7FFFFFFF))
    mark = [F.lit(m) for m in MARKS]
    output = F.when(F.col("form") == "psm", F.concat(mark[0], prefix, mark[1], suffix, mark[2], middle))
    output = output.when(F.col("form") == "spm", F.concat(mark[1], suffix, mark[0], prefix, mark[2], middle)).otherwise(F.col("text"))
    cut = F.col("form") != "plain"
    return rows.withColumn("form", form).select(
        "doc_id", "n", "form", F.when(cut, F.col("first")).cast("bigint").alias("prefix_chars"), F.when(cut, F.col("second") - F.col("first")).cast("bigint").alias("middle_chars"), output.alias("output")
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output of transform was made from. No mark lies in or across its parts, so the marks part it."""
    part = F.split(output, "|".join(map(re.escape, MARKS)))
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """transform without the outputs, but with output_sha256 and restored_sha256."""
    rows = transform(docs)
    again = restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))
