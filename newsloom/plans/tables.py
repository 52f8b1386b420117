"""The logical tables, derived from the star schema and the text tables; each has its DuckDB twin in TABLE_SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import content

#: Statuses of the event types as crawl runs; `signup` also fails in the harsher mapping, which opens circuits.
STATUS = {"error": "failed", "signup": "partial", "click": "unchanged"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def content_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels as content items."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "quality")
    source = F.substring("source", 4, 10).cast("bigint")
    kind = F.element_at(F.array(*map(F.lit, ("research_media", "trade_media", "consumer_media", "wechat_official_account"))), (source % 4 + 1).cast("int"))
    access = F.when(F.col("doc_id") % 7 == 0, "subscriber").when(F.col("doc_id") % 5 == 0, "partial").otherwise("public")
    published = F.when(F.col("doc_id") % 17 != 0, F.expr("timestampadd(HOUR, CAST(doc_id % 720 AS INT), TIMESTAMP '2024-01-01 00:00:00')"))
    rows = docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        source.alias("source_id"),
        F.substring(F.split("text", "\n")[0], 1, 80).alias("title"),
        F.col("text").alias("body"),
        F.substring("text", 1, 160).alias("excerpt"),
        F.col("lang").alias("language"),
        F.array("lang", F.concat(F.lit("desk "), source % 3)).alias("topics"),
        kind.alias("source_type"),
        access.alias("access_level"),
        (F.col("doc_id") % 23 == 0).alias("is_sponsored"),
        (F.col("n_chars") < 60).alias("metadata_only"),
        F.when(F.col("quality") == 1, True).when(F.col("quality") == 0, False).alias("body_complete"),
        published.alias("published_at"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("discovered_at"),
    )
    return rows.withColumn("content_hash", text.content_hash("title", "body", "excerpt", "topics"))


def crawl_runs(spark: SparkSession, sf_dir: str, harsh: bool = False) -> DataFrame:
    """events as crawl runs: a user is a source."""
    mapping = STATUS | ({"signup": "failed", "click": "failed"} if harsh else {})
    status = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in mapping.items()], F.lit("succeeded"))
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("started_at"), status.alias("status"),
        F.floor("value").cast("bigint").alias("fetched_count"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suppliers as sources: every seventh disabled, every eleventh blocked, every thirteenth a user's topic."""
    key = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        key.alias("id"),
        F.col("s_name").alias("name"),
        (key % 7 != 0).alias("is_enabled"),
        F.when(key % 11 == 0, "blocked").alias("crawl_strategy"),
        F.when(key % 13 == 0, "user_topic").otherwise("catalog").alias("discovery_method"),
        F.element_at(F.array(*map(F.lit, ("web", "rss", "api", "wechat"))), (key % 4 + 1).cast("int")).alias("channel_type"),
    )


def event_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as events: a turn is a member, its role the source."""
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("event_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("content_item_id"), F.col("role").alias("source_key"),
        (F.length("text") > 20).alias("is_active"), "turn",
    )


def item_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content items as event members, so that scores have corroboration: items of one 40-item stretch share an event."""
    return read(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 4).cast("bigint").alias("event_id"), F.col("doc_id").alias("content_item_id"), (F.col("doc_id") % 5 != 0).alias("is_active")
    )


def assignments(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> DataFrame:
    """labels as domain assignments, with a stale hash for every thirty-first."""
    items = items if items is not None else content_items(spark, sf_dir)
    rows = read(spark, sf_dir, "labels").join(items.select("id", "content_hash"), F.col("doc_id") == F.col("id"))
    return rows.select(
        (F.col("doc_id") + 1).alias("id"), F.col("doc_id").alias("content_item_id"), F.lit(1).cast("bigint").alias("domain_id"),
        F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("decision"),
        (F.lit(0.5) + F.col("doc_id") % 50 / 100).alias("confidence"),
        F.when(F.col("doc_id") % 31 == 0, "stale").otherwise(F.col("content_hash")).alias("input_content_hash"),
    )


TABLE_SQL = {
    "content_items": r"""content_base AS (
 SELECT d.doc_id AS id, CAST(substr(d.source, 4) AS BIGINT) AS source_id, substr(split_part(d.text, chr(10), 1), 1, 80) AS title, d.text AS body,
  substr(d.text, 1, 160) AS excerpt, d.lang AS language, [d.lang, 'desk ' || (CAST(substr(d.source, 4) AS BIGINT) % 3)] AS topics,
  CASE CAST(substr(d.source, 4) AS BIGINT) % 4 WHEN 0 THEN 'research_media' WHEN 1 THEN 'trade_media' WHEN 2 THEN 'consumer_media' ELSE 'wechat_official_account' END AS source_type,
  CASE WHEN d.doc_id % 7 = 0 THEN 'subscriber' WHEN d.doc_id % 5 = 0 THEN 'partial' ELSE 'public' END AS access_level,
  d.doc_id % 23 = 0 AS is_sponsored, d.n_chars < 60 AS metadata_only,
  CASE WHEN l.quality = 1 THEN TRUE WHEN l.quality = 0 THEN FALSE END AS body_complete,
  CASE WHEN d.doc_id % 17 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(d.doc_id % 720 AS INTEGER)) END AS published_at,
  TIMESTAMP '2024-02-01 00:00:00' AS discovered_at
 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
content_items AS (SELECT *, sha256('{"body_text":' || to_json(trim(regexp_replace(body, '\s+', ' ', 'g')))::VARCHAR || ',"excerpt":' || to_json(trim(regexp_replace(excerpt, '\s+', ' ', 'g')))::VARCHAR
  || ',"title":' || to_json(trim(regexp_replace(title, '\s+', ' ', 'g')))::VARCHAR || ',"topics":' || to_json(topics)::VARCHAR || '}') AS content_hash FROM content_base),
eligible AS (SELECT * FROM content_items WHERE published_at IS NOT NULL AND NOT metadata_only AND trim(body, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND (coalesce(body_complete, FALSE) OR length(body) >= 200))""",
    "crawl_runs": """crawl_runs AS (SELECT event_id AS id, user_id AS source_id, ts AS started_at, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'partial' WHEN 'click' THEN 'unchanged' ELSE 'succeeded' END AS status,
 CAST(floor(value) AS BIGINT) AS fetched_count FROM events)""",
    "harsh_runs": """crawl_runs AS (SELECT event_id AS id, user_id AS source_id, ts AS started_at, CASE WHEN event_type IN ('error', 'signup', 'click') THEN 'failed' ELSE 'succeeded' END AS status,
 CAST(floor(value) AS BIGINT) AS fetched_count FROM events)""",
    "sources": """sources AS (SELECT s_suppkey AS id, s_name AS name, s_suppkey % 7 <> 0 AS is_enabled, CASE WHEN s_suppkey % 11 = 0 THEN 'blocked' END AS crawl_strategy,
 CASE WHEN s_suppkey % 13 = 0 THEN 'user_topic' ELSE 'catalog' END AS discovery_method, CASE s_suppkey % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'rss' WHEN 2 THEN 'api' ELSE 'wechat' END AS channel_type FROM supplier)""",
    "event_members": "event_members AS (SELECT conv_id AS event_id, conv_id * 1000 + turn AS content_item_id, role AS source_key, length(text) > 20 AS is_active, turn FROM conversations)",
    "item_events": "item_events AS (SELECT CAST(floor(doc_id / 4.0) AS BIGINT) AS event_id, doc_id AS content_item_id, doc_id % 5 <> 0 AS is_active FROM documents)",
    "assignments": """assignments AS (SELECT l.doc_id + 1 AS id, l.doc_id AS content_item_id, 1 AS domain_id, CASE WHEN l.quality = 1 THEN 'include' ELSE 'exclude' END AS decision, 0.5::DOUBLE + CAST(l.doc_id % 50 AS DOUBLE) / 100 AS confidence,
 CASE WHEN l.doc_id % 31 = 0 THEN 'stale' ELSE c.content_hash END AS input_content_hash FROM labels l JOIN content_items c ON c.id = l.doc_id)""",
}


def with_tables(*names: str) -> str:
    """A WITH clause of logical tables, to which more may be added after a comma."""
    return "WITH " + ",\n".join(TABLE_SQL[n] for n in names)


__all__ = ["assignments", "content", "content_items", "crawl_runs", "event_members", "item_events", "read", "sources", "with_tables"]
