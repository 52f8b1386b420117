"""Rule-based relevance and domain assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import bounded


def _words(*columns: str) -> Column:
    return F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in columns])


def _found(text: Column, keywords: list[str]) -> Column:
    """The keywords that a text holds in any case, in order."""
    lowered = F.lower(text)
    hits = F.array(*[F.when(F.contains(lowered, F.lit(k.lower())), F.lit(k)) for k in sorted(set(keywords))]) if keywords else F.array()
    return F.array_compact(hits.cast("array<string>"))


def evaluate(items: DataFrame, industry: list[str], events: list[str], dedicated: Column | bool = False) -> DataFrame:
    """Adds is_relevant, matched_topics, matched_events and reason.

    A dedicated source's items are relevant as they are. Others must hold an industry keyword in text or topics, and an
    event keyword in the text where the configuration has any.
    """
    dedicated = F.lit(dedicated) if isinstance(dedicated, bool) else dedicated
    text, tags = _words("title", "excerpt", "body"), F.array_join(F.col("topics"), " ")
    by_tag, by_event = _found(tags, industry), _found(text, events)
    matched = F.array_sort(F.array_union(_found(text, industry), by_tag))
    none = F.array().cast("array<string>")
    off, quiet = F.size(matched) == 0, (F.size(by_event) == 0) if events else F.lit(False)
    reason = F.when(dedicated, "dedicated_source").when(off, "no_industry_match").when(quiet, "no_event_match").when(F.size(by_tag) > 0, "tag_match").otherwise("rule_match")
    return items.withColumns({
        "is_relevant": dedicated | (~off & ~quiet),
        "matched_topics": F.when(dedicated, none).otherwise(matched),
        "matched_events": F.when(dedicated | quiet & ~off, none).otherwise(by_event),
        "reason": reason,
    })


def domain_relevance(items: DataFrame, keywords: list[str], dedicated_tags: list[str], source_tags: Column) -> DataFrame:
    """Adds is_relevant, matched_topics, matched_source_tags and reason; keyword evidence alone asks for a review."""
    text = _words("title", "excerpt", "body")
    text = F.concat_ws(" ", F.nullif(text, F.lit("")), F.nullif(F.array_join(F.col("topics"), " "), F.lit("")))
    wanted = F.array(*[F.lit(t.strip().lower()) for t in dedicated_tags if t.strip()]).cast("array<string>")
    tags = F.array_sort(F.array_distinct(F.filter(F.transform(source_tags, lambda t: F.trim(t)), lambda t: (t != "") & F.array_contains(wanted, F.lower(t)))))
    hits = F.array_compact(F.array(*[F.when(bounded(text, k), F.lit(k.strip())) for k in sorted(set(keywords))]).cast("array<string>"))
    own, none = F.size(tags) > 0, F.array().cast("array<string>")
    hits = F.when(own, none).otherwise(hits)
    reason = F.when(own, "dedicated_domain_source").when(F.size(hits) > 0, "needs_llm_domain_review").otherwise("no_domain_evidence")
    return items.withColumns({"is_relevant": own, "matched_topics": hits, "matched_source_tags": tags, "reason": reason})


def needs_processing(items: DataFrame, results: DataFrame, name: str, version: str) -> DataFrame:
    """Items without a result of this processor for their present content."""
    done = results.where((F.col("processor_name") == name) & (F.col("processor_version") == version))
    done = done.select(F.col("content_item_id").alias("id"), F.col("input_content_hash").alias("content_hash"))
    return items.join(done, ["id", "content_hash"], "left_anti")


def project_assignments(results: DataFrame, existing: DataFrame) -> DataFrame:
    """Current processing results as domain assignments, with what each would do: created, updated or skipped."""
    new = results.select("content_item_id", F.when(F.col("is_relevant"), "include").otherwise("exclude").alias("decision"), F.lit(1.0).alias("confidence"), "input_content_hash", "reason")
    old = existing.select("content_item_id", F.col("decision").alias("old_decision"), F.col("input_content_hash").alias("old_hash"))
    same = F.col("decision").eqNullSafe(F.col("old_decision")) & F.col("input_content_hash").eqNullSafe(F.col("old_hash"))
    action = F.when(F.col("old_decision").isNull(), "created").when(same, "skipped").otherwise("updated")
    return new.join(old, "content_item_id", "left").withColumn("action", action).drop("old_decision", "old_hash")


def hybrid_baseline(results: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Rule decisions carried over to the hybrid classifier, but for items under review."""
    decided = results.where("reason <> 'needs_llm_domain_review'")
    return decided.join(reviewed.select("content_item_id"), "content_item_id", "left_anti")


def valid_reviews(reviews: DataFrame, items: DataFrame) -> DataFrame:
    """Model reviews of present content whose every quote is in the text, white space and case aside."""
    flat = lambda x: F.lower(F.regexp_replace(x, r"(?U)\s+", " "))
    rows = reviews.join(items.select(F.col("id").alias("content_item_id"), "content_hash", _words("title", "excerpt", "body").alias("_text")), "content_item_id")
    quoted = F.forall("quotes", lambda q: F.contains(flat(F.col("_text")), flat(q)))
    return rows.where((F.col("input_content_hash") == F.col("content_hash")) & quoted).drop("_text", "content_hash")


def latest_per_item(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest `order`."""
    window = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")
