"""Content rules that every reader query shares: quality tiers, eligibility, effective time, staleness, strict duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import collapse

#: Fixed values.
PARTIAL_CHARS, STRICT_CHARS, FULL_CHARS = 200, 200, 400
ZONE = "Asia/Shanghai"


def _blank(body: str) -> Column:
    return F.coalesce(F.col(body), F.lit("")).rlike(r"\A(?U)\s*\z")


def quality_tier(prefix: str = "") -> Column:
    """verified_full, partial or needs_enrichment."""
    c = lambda name: F.col(prefix + name)
    lacking = F.coalesce(c("metadata_only"), F.lit(False)) | c("published_at").isNull() | _blank(prefix + "body")
    long_enough = F.length(F.coalesce(c("body"), F.lit(""))) >= PARTIAL_CHARS
    return F.when(lacking, "needs_enrichment").when(c("body_complete"), "verified_full").when(long_enough, "partial").otherwise("needs_enrichment")


def eligible(items: DataFrame) -> DataFrame:
    """Dated, full or substantial content: what readers may see."""
    return items.where(quality_tier().isin("verified_full", "partial"))


def effective_time(prefix: str = "") -> Column:
    return F.coalesce(F.col(prefix + "published_at"), F.col(prefix + "discovered_at"))


def local_day(time: str = "published_at") -> Column:
    return F.to_date(F.from_utc_timestamp(F.col(time), ZONE))


def current(derived: DataFrame, items: DataFrame) -> DataFrame:
    """Derived rows whose input is still the item's content, with the item's columns."""
    return derived.join(items.withColumnRenamed("id", "content_item_id"), "content_item_id").where("input_content_hash = content_hash")


def strict_duplicates(items: DataFrame, least_chars: int = STRICT_CHARS) -> DataFrame:
    """id, duplicate_of_id: in groups of equal hash that span two sources, every item but the smallest id.

    Groups are found by an aggregate that combines before the shuffle, and only its few rows with two sources are
    joined back, so that a common page does not gather its copies in one task.
    """
    long = items.where(F.length(collapse("body")) >= least_chars).select("id", "source_id", "content_hash")
    groups = long.groupBy("content_hash").agg(F.min("id").alias("duplicate_of_id"), F.min("source_id").alias("a"), F.max("source_id").alias("b")).where("a <> b")
    return long.join(groups.drop("a", "b"), "content_hash").where("id <> duplicate_of_id").select("id", "duplicate_of_id", "content_hash")


def duplicate_summary(items: DataFrame) -> DataFrame:
    """One row: items scanned, groups and duplicates."""
    found = strict_duplicates(items).agg(F.countDistinct("content_hash").alias("groups"), F.count("*").alias("duplicates"))
    return items.agg(F.count("*").alias("scanned")).crossJoin(F.broadcast(found))


def needs_enrichment(body_complete: str = "body_complete") -> Column:
    """Undated, short or incomplete content is worth another fetch."""
    return F.col("published_at").isNull() | (F.length(F.coalesce("body", F.lit(""))) < FULL_CHARS) | ~F.coalesce(F.col(body_complete), F.lit(False))


def direct_completeness() -> Column:
    """What a directly fetched article is worth: full, partial or unknown."""
    n = F.length(F.coalesce("body", F.lit("")))
    return F.when(F.col("published_at").isNull(), "unknown").when(n >= FULL_CHARS, "full").when(n >= PARTIAL_CHARS, "partial").otherwise("unknown")


def in_window(end: Column, days: int, time: str = "published_at") -> Column:
    """Is the local day among the `days` days up to `end`? Undated content is; so is all content without a window."""
    day = local_day(time)
    return F.lit(True) if days <= 0 else F.col(time).isNull() | day.between(F.date_sub(end, days - 1), end)
