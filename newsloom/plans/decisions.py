"""Queries of evidence, idempotent runs, applied reviews and coverage, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import entities, events, ingest, scoring
from newsloom.plans import tables
from newsloom.plans.registry import query
from newsloom.plans.tables import with_tables

MEMBERS_SQL = """m AS (SELECT content_item_id, event_id AS event_key, min(content_item_id) OVER (PARTITION BY event_id) AS representative_id FROM item_events WHERE is_active),
p AS (SELECT representative_id AS l, content_item_id AS r, CAST(content_item_id % 100 AS DOUBLE) / 100 AS score FROM m WHERE content_item_id > representative_id AND content_item_id % 3 = 0)"""


def _members(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events with their least member as representative, and scores of every third member's pair with it."""
    rows = tables.item_events(spark, d).where("is_active").select("content_item_id", F.col("event_id").alias("event_key"))
    heads = rows.groupBy("event_key").agg(F.min("content_item_id").alias("representative_id"))
    rows = rows.join(heads, "event_key")
    pairs = rows.where("content_item_id > representative_id AND content_item_id % 3 = 0")
    return rows, pairs.select(F.col("content_item_id").alias("left"), F.col("representative_id").alias("right"), (F.col("content_item_id") % 100 / 100).alias("score"))


@query("e9_cluster_evidence", with_tables("item_events") + f""", {MEMBERS_SQL}
SELECT content_item_id, event_key, representative_id, CASE WHEN content_item_id = representative_id THEN 1.0 ELSE p.score END AS score,
 CASE WHEN content_item_id = representative_id THEN 'representative' WHEN content_item_id % 10 IN (4, 5) THEN 'must_link' WHEN content_item_id % 11 = 0 OR content_item_id % 11 = 1 THEN 'duplicate' WHEN p.score IS NOT NULL THEN 'pair_score' ELSE 'block' END AS evidence
FROM m LEFT JOIN p ON p.l = representative_id AND p.r = content_item_id""")
def e9(spark: SparkSession, d: str) -> DataFrame:
    rows, pairs = _members(spark, d)
    must = rows.where("content_item_id % 10 = 4").select(F.col("content_item_id").alias("left"), (F.col("content_item_id") + 1).alias("right"))
    must = must.unionByName(rows.where("content_item_id % 10 = 5").select((F.col("content_item_id") - 1).alias("left"), F.col("content_item_id").alias("right")))
    copies = rows.select(F.col("content_item_id").alias("id"), F.when(F.col("content_item_id") % 11 == 1, F.col("content_item_id") - 1).when(F.col("content_item_id") % 11 == 0, F.col("content_item_id") + 1).alias("duplicate_of_id"))
    return events.cluster_evidence(rows, pairs, must, copies)


@query("e10_input_hash", with_tables("content_items") + """, r AS (SELECT 'item' AS part, CAST(floor(id / 64) AS BIGINT) AS b, id || ':' || content_hash AS line FROM content_items
UNION ALL SELECT 'constraint', CAST(floor(id / 64) AS BIGINT), id || ':' || (id + 1) || ':must_link' FROM content_items WHERE id % 5 = 0 UNION ALL SELECT 'locked', CAST(floor(id / 64) AS BIGINT), '7:' || id FROM content_items WHERE id % 9 = 0),
g AS (SELECT part, b, sha256(string_agg(line, ',' ORDER BY line)) AS digest FROM r GROUP BY ALL)
SELECT sha256('{"match": 0.78}' || string_agg(part || ':' || lpad(CAST(b AS VARCHAR), 20, '0') || ':' || digest, ',' ORDER BY part, b)) AS input_hash FROM g""")
def e10(spark: SparkSession, d: str) -> DataFrame:
    items = tables.content_items(spark, d).select("id", "content_hash")
    links = items.where("id % 5 = 0").select((F.col("id") + 1).alias("left"), F.col("id").alias("right"), F.lit("must_link").alias("relation"))
    locked = items.where("id % 9 = 0").select(F.lit(7).alias("event_key"), F.col("id").alias("content_item_id"))
    return events.input_hash(items, '{"match": 0.78}', links, locked, 64)


@query("v6_score_runs", """SELECT DISTINCT 'h' || o_custkey AS input_hash, CASE WHEN o_custkey % 4 = 0 THEN 'created' WHEN o_custkey % 4 = 1 OR o_custkey % 3 = 0 THEN 'reused' ELSE 'conflict' END AS action FROM orders""")
def v6(spark: SparkSession, d: str) -> DataFrame:
    planned = tables.read(spark, d, "orders").select("o_custkey", F.concat(F.lit("h"), F.col("o_custkey").cast("string")).alias("input_hash"))
    failed = planned.where("o_custkey % 4 <> 0").withColumn("status", F.lit("failed"))
    done = planned.where("o_custkey % 4 = 1 OR o_custkey % 4 <> 0 AND o_custkey % 3 = 0").withColumn("status", F.lit("succeeded"))
    return scoring.apply_runs(planned, failed.unionByName(done))


REVIEWS_SQL = """WITH m AS (SELECT o_orderkey AS mention_id, o_orderpriority AS entity_type, 'Buyer ' || (o_custkey % 300) || CASE WHEN o_orderkey % 2 = 0 THEN ' inc' ELSE ' INC' END AS surface FROM orders),
n AS (SELECT *, regexp_replace(lower(surface), '[^a-z0-9]', '', 'g') AS normalized_name FROM m), k AS (SELECT *, sha256(entity_type || ':' || normalized_name) AS candidate_key FROM n),
r AS (SELECT candidate_key, min(mention_id) AS entity_id FROM k GROUP BY 1), s AS (SELECT *, CASE entity_id % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'unresolved' END AS resolution FROM r)"""


def _reviews(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    end = F.when(F.col("o_orderkey") % 2 == 0, " inc").otherwise(" INC")
    mentions = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("mention_id"), F.col("o_orderpriority").alias("entity_type"), F.concat(F.lit("Buyer "), (F.col("o_custkey") % 300).cast("string"), end).alias("surface"), F.lit("e").alias("evidence_text"))
    queue = entities.review_queue(mentions)
    status = F.when(F.col("first_mention") % 3 == 0, "confirmed").when(F.col("first_mention") % 3 == 1, "rejected").otherwise("pending")
    return mentions, queue.select("candidate_key", status.alias("status"), F.col("first_mention").alias("entity_id"))


@query("x11_reviewed_mentions", REVIEWS_SQL + " SELECT mention_id, candidate_key, CASE WHEN resolution = 'confirmed' THEN entity_id END AS entity_id, resolution FROM k JOIN s USING (candidate_key)")
def x11(spark: SparkSession, d: str) -> DataFrame:
    return entities.apply_reviews(*_reviews(spark, d))[0]


@query("x12_review_aliases", REVIEWS_SQL + " SELECT DISTINCT entity_id, entity_type, surface AS alias, normalized_name AS normalized_alias FROM k JOIN s USING (candidate_key) WHERE resolution = 'confirmed'")
def x12(spark: SparkSession, d: str) -> DataFrame:
    return entities.apply_reviews(*_reviews(spark, d))[1]


@query("n27_run_coverage", """SELECT event_id AS run_id, CASE WHEN user_id % 2 = 0 THEN coalesce(asked, today - 1) END AS coverage_date, CASE WHEN user_id % 2 = 0 THEN coalesce(asked, today - 1) < today ELSE asked IS NULL END AS is_valid
FROM (SELECT *, CAST(ts + INTERVAL 8 HOUR AS DATE) AS today, CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) END AS asked FROM events)""")
def n27(spark: SparkSession, d: str) -> DataFrame:
    asked = F.when(F.col("event_id") % 3 == 0, F.to_date("ts"))
    mode = F.when(F.col("user_id") % 2 == 0, "date").otherwise("latest")
    return ingest.coverage_dates(tables.read(spark, d, "events").select(F.col("event_id").alias("run_id"), mode.alias("mode"), F.col("ts").alias("reference_time"), asked.alias("requested_date")))


@query("n52_exact_candidates", """WITH c AS (SELECT p_brand AS name, p_size % 5 AS identity FROM part WHERE p_size % 5 = p_partkey % 2 UNION ALL SELECT lower(p_type), 100 FROM part), n AS (SELECT p_brand AS name FROM part UNION SELECT p_type FROM part UNION SELECT lower(p_type) FROM part UNION SELECT p_name FROM part),
l AS (SELECT name, min(identity) AS i FROM c GROUP BY 1 HAVING min(identity) = max(identity)), p AS (SELECT regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS plain, min(identity) AS i FROM c GROUP BY 1 HAVING min(identity) = max(identity))
SELECT n.name, coalesce(l.i, p.i) AS identity, CASE WHEN l.i IS NOT NULL THEN 'literal' WHEN p.i IS NOT NULL THEN 'normalized' END AS how FROM n LEFT JOIN l ON l.name = n.name LEFT JOIN p ON p.plain = regexp_replace(lower(n.name), '[^a-z0-9]+', '', 'g')""")
def n52(spark: SparkSession, d: str) -> DataFrame:
    part = tables.read(spark, d, "part")
    known = part.where("p_size % 5 = p_partkey % 2").select(F.col("p_brand").alias("name"), (F.col("p_size") % 5).alias("identity"))
    known = known.unionByName(part.select(F.lower("p_type").alias("name"), F.lit(100).alias("identity")))
    names = [part.select(c.alias("name")) for c in (F.col("p_brand"), F.col("p_type"), F.lower("p_type"), F.col("p_name"))]
    wanted = names[0].unionByName(names[1]).unionByName(names[2]).unionByName(names[3])
    return ingest.exact_candidates(wanted, known)
