"""Discovered pages and search results as snapshots, contents and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.sources.store import Store

#: Characters of a body that is whole, and of a description that is cut from a body.
FULL_CHARS, DESCRIPTION_CHARS = 400, 240

SNAPSHOTS = "canonical_url string, page_type string, body string, body_sha256 string"
CONTENTS = "canonical_url string, title string, excerpt string, body string, content_completeness string"
MATCHES = "topic_id bigint, canonical_url string, action string"


def outcomes(candidates: DataFrame, contents: DataFrame) -> DataFrame:
    """One row per candidate with its action and what it would store.

    candidates: topic_id, url, title, host, description and, for a page that was fetched, page_title, page_description
    and markdown. contents: canonical_url, body and needs_enrichment of what there is. A page is reused if its content is
    there and needs nothing, else new or updated; without text a candidate is a search result, which is reused if there
    is any content, else new with what the search said. An update keeps the longer body. The first candidate of an
    address, by topic, speaks for the content; the others are matches only. Candidates without an address are left out.
    """
    said = lambda *names: F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names])
    rows = candidates.where("trim(url) <> ''").withColumn("canonical_url", text.normalize_url("url")).withColumn("page", F.nullif(F.trim("markdown"), F.lit("")))
    known = contents.select("canonical_url", F.col("body").alias("old_body"), F.coalesce("needs_enrichment", F.lit(False)).alias("needs"), F.lit(True).alias("there"))
    rows = rows.join(known, "canonical_url", "left").withColumn("whole", F.col("page").isNotNull())
    action = F.when(F.col("there").isNull(), "new").when(F.col("whole") & F.col("needs"), "updated").otherwise("reused")
    title = F.when(F.col("whole"), said("page_title", "title", "canonical_url")).otherwise(said("title", "host", "canonical_url"))
    rows = rows.withColumn("action", action).withColumn("title", title)
    excerpt = F.when(F.col("whole"), F.coalesce(said("page_description", "description"), F.substring("page", 1, DESCRIPTION_CHARS))).otherwise(F.coalesce(said("description"), F.col("title")))
    rows = rows.withColumn("excerpt", excerpt)
    evidence = F.concat(*[x for key, c in (("description", "excerpt"), ("title", "title"), ("url", "canonical_url")) for x in (F.lit("{" if key == "description" else ", "), F.lit(f'"{key}": '), F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2))], F.lit("}"))
    longer = F.when(F.length(F.coalesce("old_body", F.lit(""))) > F.length("page"), F.col("old_body")).otherwise(F.col("page"))
    return rows.select(
        "topic_id", "canonical_url", "action", F.when(F.col("whole"), "article").otherwise("search_result").alias("page_type"), F.coalesce("page", evidence).alias("snapshot"), "title", "excerpt",
        F.when(F.col("whole"), longer).otherwise(F.col("excerpt")).alias("body"),
        F.when(~F.col("whole"), "metadata_only").when(F.length("page") >= FULL_CHARS, "full").otherwise("partial").alias("content_completeness"),
    )


def stored(found: DataFrame) -> dict[str, tuple[DataFrame, list[str]]]:
    """outcomes -> rows and keys of the three tables: snapshots and contents of what is new or updated, matches of all."""
    fresh = found.where("action <> 'reused'")
    columns = ("topic_id", "page_type", "snapshot", "title", "excerpt", "body", "content_completeness")
    first = fresh.groupBy("canonical_url").agg(F.min_by(F.struct(*columns), F.struct("topic_id", F.xxhash64(*columns))).alias("f")).select("canonical_url", "f.*")
    return {
        "snapshots": (first.select("canonical_url", "page_type", F.col("snapshot").alias("body"), F.sha2("snapshot", 256).alias("body_sha256")), ["canonical_url", "body_sha256"]),
        "contents": (first.select("canonical_url", "title", "excerpt", "body", "content_completeness"), ["canonical_url"]),
        "matches": (found.select("topic_id", "canonical_url", "action"), ["topic_id", "canonical_url"]),
    }


def ingest(store: Store, batch_id: int, candidates: DataFrame) -> bool:
    """Stores a batch of candidates against the contents there are; partial and bare contents may be enriched. A batch is stored once."""
    contents = store.read("contents", CONTENTS).withColumn("needs_enrichment", F.col("content_completeness") != "full")
    return store.upsert(batch_id, stored(outcomes(candidates, contents)))
