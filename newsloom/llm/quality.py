"""Quality rules as a ledger of failure bits: every rule is evaluated once, policies and ablations read the bits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Rule name -> SQL condition on the measurements under which a document fails. A rule's bit is its place here.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 14 * n_words",
    "capitals": "2 * n_upper > word_chars",
}
#: Policy version -> the rules that reject. Policies only combine ledger bits, so a new one needs no new scan.
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words", "capitals"),
}
BASE_POLICY, POLICY = 1, 2

MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_upper bigint"
#: The characters between words.
_SPACES = " \t\n\v\f\r"


@dataclass(frozen=True)
class Measured:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_lines: int
    n_upper: int


def _repeated(words: list[bytes]) -> int:
    """Words lying in a three-word window that the text holds at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    _, pair = np.unique(at[:-1] * len(ids) + at[1:], return_inverse=True)
    _, window, counts = np.unique(pair[:-1].astype(np.int64) * len(ids) + at[2:], return_inverse=True, return_counts=True)
    twice = counts[window] > 1
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift : shift + n - 2] |= twice
    return int(covered.sum())


def measure(text: str | None) -> Measured:
    """All measurements of one text in one pass; null counts as empty."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    lines = again = 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            lines += 1
            again += line in seen
            seen.add(line)
    return Measured(
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, SYMBOLS)),
        again,
        _repeated(words),
        lines,
        sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    )


NAMES = [c.split()[0] for c in MEASURES.split(", ")]


def measurements(text: Column) -> Column:
    """`measure` over a text column, in Arrow batches."""

    @F.pandas_udf(MEASURES)
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([vars(measure(x)) for x in texts], columns=NAMES)

    return measured(text)


def policy_mask(version: int) -> int:
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in POLICIES[version])


def _fails(rule: str) -> Column:
    return F.expr(RULES[rule])


def _with_bits(rows: DataFrame) -> DataFrame:
    """Adds fail_bits: every rule's condition on the measurements, evaluated once."""
    bits = sum((F.when(_fails(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES)), F.lit(0))
    return rows.withColumn("fail_bits", bits.cast("bigint"))


def ledger(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, the measurements and fail_bits: one scan, no shuffle.

    Null and empty texts measure zero everywhere and fail few_words; very long texts are measured whole; repeated rows
    and null ids are kept; an empty table gives an empty ledger; other columns, also of clashing names, are ignored.
    """
    return _with_bits(docs.select("doc_id", measurements(F.col("text")).alias("m")).select("doc_id", "m.*"))


def apply_policy(rows: DataFrame, version: int = POLICY, name: str = "kept") -> DataFrame:
    """Adds the verdict of a policy version: no bit of its mask may be set."""
    return rows.withColumn(name, F.col("fail_bits").bitwiseAND(F.lit(policy_mask(version)).cast("bigint")) == 0)


def ablations(rows: DataFrame, version: int = POLICY) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that dropping the rule would bring back.

    Ledgers collapse to the distinct bit patterns first, at most two to the number of rules, whatever the corpus size.
    """
    mask = policy_mask(version)
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("bigint")).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(1 << k).cast("bigint").alias("bit")) for k, rule in enumerate(RULES) if mask >> k & 1]))
    met = patterns.select("bits", "n", each.alias("r")).select("bits", "n", "r.rule", "r.bit")
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    return met.groupBy("rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(alone | (F.col("bits") == 0), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def keep_good(docs: DataFrame, version: int = POLICY) -> DataFrame:
    """Drops the documents that the policy rejects by their ledger bits; columns stay, and nothing is shuffled.

    Null and empty texts go (too few words), repeated rows and null ids stay as often as they are, an empty table
    stays empty, and columns named like measurements are left alone.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), measurements(F.col("text")).alias("m"))
    return apply_policy(_with_bits(held.select("_row", "m.*")), version, "_kept").where("_kept").select("_row.*")
