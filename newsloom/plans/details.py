"""Queries of detail views, run distribution and editions, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import detail, editions, reader, topics
from newsloom.plans import tables
from newsloom.plans.queries import _topic_sql, TOPICS
from newsloom.plans.registry import query
from newsloom.plans.tables import with_tables
from newsloom.session import written


def _stale(every: int):
    return F.when(F.col("id") % every == 0, "stale").otherwise(F.col("content_hash"))


@query("q3_content_cards", with_tables("content_items") + """ SELECT id AS content_item_id, CASE WHEN id % 2 = 0 THEN id % 3 END AS topic_id, source_id,
 CASE WHEN id % 2 = 0 AND id % 3 = 1 AND id % 5 <> 0 THEN 'topic ' || id WHEN id % 7 <> 0 THEN 'general ' || id ELSE title END AS headline,
 CASE WHEN id % 2 = 0 AND id % 3 = 1 AND id % 5 <> 0 THEN 'topic' WHEN id % 7 <> 0 THEN 'general' ELSE 'none' END AS copy FROM eligible""")
def q3(spark: SparkSession, d: str) -> DataFrame:
    items = tables.content_items(spark, d)
    key = F.col("id").alias("content_item_id")
    asked = items.select(key, F.when(F.col("id") % 2 == 0, F.col("id") % 3).alias("topic_id"))
    general = items.select(key, _stale(7).alias("input_content_hash"), F.concat(F.lit("general "), "id").alias("output"))
    by_topic = items.select(key, F.lit(1).alias("topic_id"), _stale(5).alias("input_content_hash"), F.concat(F.lit("topic "), "id").alias("output"))
    return detail.content_cards(asked, items, general, by_topic)


@query("q7_domain_scores", with_tables("content_items") + """, r AS (SELECT n_nationkey AS id FROM nation WHERE n_nationkey % 3 <> 0 AND n_regionkey = 1 ORDER BY n_nationkey % 4 DESC, n_nationkey DESC LIMIT 1)
SELECT c.id AS content_item_id, title, source_id, CAST(c.id % 97 AS DOUBLE) / 100 AS total_score FROM content_items c JOIN r ON c.id % 25 = r.id WHERE c.id % 2 = 0 AND c.id % 31 <> 0 ORDER BY total_score DESC, c.id LIMIT 50""")
def q7(spark: SparkSession, d: str) -> DataFrame:
    items, key = tables.content_items(spark, d), F.col("n_nationkey")
    runs = tables.read(spark, d, "nation").select(key.alias("id"), F.col("n_regionkey").alias("domain_id"), F.when(key % 3 == 0, "failed").otherwise("succeeded").alias("status"), (key % 4).alias("as_of"))
    scores = items.select("id", F.col("id").alias("content_item_id"), (F.col("id") % 25).alias("run_id"), (F.col("id") % 97 / 100).alias("total_score"), F.when(F.col("id") % 2 == 0, "selected").otherwise("full_pool").alias("decision"), _stale(31).alias("input_content_hash"))
    return detail.value_scores(runs, scores, items, 1, "selected").select("content_item_id", "title", "source_id", "total_score")


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    items = tables.content_items(spark, d)
    mentions = items.select(F.col("id").alias("mention_id"), F.col("id").alias("content_item_id"), F.col("id").alias("processing_result_id"), (F.col("id") % 150 + 1).alias("entity_id"))
    results = items.select("id", F.when(F.col("id") % 4 == 0, "failed").otherwise("succeeded").alias("status"), _stale(31).alias("input_content_hash"))
    return detail.current_mentions(mentions, results, items)


@query("q9_entity_mentions", with_tables("content_items") + " SELECT id % 150 + 1 AS entity_id, id AS mention_id, id AS content_item_id, title AS content_title FROM content_items WHERE id % 4 <> 0 AND id % 31 <> 0")
def q9_mentions(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d).select("entity_id", "mention_id", "content_item_id", "content_title")


@query("q9_entity_details", """WITH m AS (SELECT doc_id % 150 + 1 AS id, count(*) AS n FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 31 <> 0 GROUP BY 1)
SELECT c_custkey AS id, c_name AS canonical_name, CASE WHEN c_custkey % 3 <> 0 THEN c_name || '|buyer ' || c_custkey ELSE '' END AS aliases, coalesce(n, 0) AS mention_count FROM customer LEFT JOIN m ON m.id = c_custkey WHERE c_custkey % 10 <> 0""")
def q9(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    entities = tables.read(spark, d, "customer").select(key.alias("id"), F.col("c_name").alias("canonical_name"), F.when(key % 10 == 0, "retired").otherwise("active").alias("status"))
    known = entities.where("id % 3 <> 0")
    aliases = known.select((F.col("id") * 2 + 1).alias("id"), F.col("id").alias("entity_id"), F.concat(F.lit("buyer "), "id").alias("alias"))
    aliases = aliases.unionByName(known.select((F.col("id") * 2).alias("id"), F.col("id").alias("entity_id"), F.col("canonical_name").alias("alias")))
    rows = detail.entity_details(entities, aliases, _mentions(spark, d))
    return rows.select("id", "canonical_name", F.array_join("aliases", "|").alias("aliases"), "mention_count")


@query("q13_event_members", with_tables("content_items", "item_events", "sources") + " SELECT event_id, content_item_id, title, source_id, s.name AS source_name, published_at FROM item_events e JOIN content_items c ON c.id = e.content_item_id JOIN sources s ON s.id = c.source_id WHERE is_active AND event_id % 6 <> 0")
def q13(spark: SparkSession, d: str) -> DataFrame:
    members = tables.item_events(spark, d)
    events = members.select("event_id").distinct().withColumn("status", F.when(F.col("event_id") % 6 == 0, "merged").otherwise("active"))
    return detail.event_details(events, members, tables.content_items(spark, d), tables.sources(spark, d)).select("event_id", "content_item_id", "title", "source_id", "source_name", "published_at")


@query("q14_candidate_reviews", "SELECT o_orderkey AS id, o_orderpriority AS entity_type, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'confirmed' ELSE 'rejected' END AS status FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_orderkey < 1200 ORDER BY o_orderkey DESC LIMIT 50")
def q14(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "confirmed").otherwise("rejected")
    reviews = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("entity_type"), status.alias("status"))
    return reader.page(reviews, before_id=1200, status="pending", entity_type="1-URGENT")


@query("q16_subscriptions", "SELECT user_id, event_id AS id, lower(r_name) AS domain_key, r_name AS domain_name, event_type AS delivery_type, CASE WHEN event_id % 4 = 0 THEN 'paused' ELSE 'active' END AS status FROM events JOIN region ON r_regionkey = event_id % 6")
def q16(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("event_id")
    rows = tables.read(spark, d, "events").select("user_id", key.alias("id"), (key % 6).alias("domain_id"), F.col("event_type").alias("delivery_type"), F.when(key % 4 == 0, "paused").otherwise("active").alias("status"))
    domains = tables.read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.lower("r_name").alias("key"), F.col("r_name").alias("name"))
    return detail.subscriptions(rows, domains)


@query("q20_event_detail", with_tables("content_items", "item_events") + """, p AS (SELECT event_id, count(DISTINCT source_id) AS s, count(*) FILTER (WHERE id % 3 = 0) AS k, max(published_at) AS t, count(*) AS member_count FROM item_events JOIN eligible c ON c.id = content_item_id WHERE is_active GROUP BY 1 HAVING count(*) >= 2),
v AS (SELECT * FROM p ORDER BY s DESC, k DESC, t DESC, member_count DESC, event_id DESC LIMIT 200)
SELECT v.event_id, member_count, content_item_id, title, published_at FROM v JOIN item_events e ON e.event_id = v.event_id JOIN eligible c ON c.id = e.content_item_id WHERE is_active AND v.event_id % 2 = 0""")
def q20(spark: SparkSession, d: str) -> DataFrame:
    items, members = tables.content_items(spark, d), tables.item_events(spark, d)
    decisions = items.select(F.col("id").alias("content_item_id"), F.when(F.col("id") % 3 == 0, "selected").otherwise("full_pool").alias("decision"))
    asked = members.where("event_id % 2 = 0").select("event_id")
    return detail.visible_event_details(asked, reader.event_payloads(members, items, decisions), members, items)


def _contents(spark: SparkSession, d: str) -> DataFrame:
    items = tables.content_items(spark, d)
    raw = items.select((F.col("id") + 7).alias("id"), (F.col("id") % 200 + 1).alias("crawl_run_id"))
    owned = items.withColumn("raw_item_id", F.col("id") + 7).withColumn("duplicate_of_id", F.when(F.col("id") % 11 == 0, F.col("id") - 1))
    return detail.run_contents(raw, owned)


@query("t12_run_contents", "SELECT doc_id % 200 + 1 AS run_id, doc_id AS id FROM documents WHERE doc_id % 11 <> 0")
def t12(spark: SparkSession, d: str) -> DataFrame:
    return _contents(spark, d).select("run_id", "id")


@query("t23_distribution", _topic_sql() + """, runs AS (SELECT event_id AS run_id, event_type <> 'error' AS open FROM events), brought AS (SELECT id % 200 + 1 AS run_id, id FROM eligible WHERE id % 11 <> 0),
counted AS (SELECT run_id, count(*) AS contents FROM brought GROUP BY 1), hits AS (SELECT run_id, count(DISTINCT topic_id) AS topics, count(*) AS included FROM brought JOIN matches m ON m.content_item_id = brought.id WHERE m.decision = 'include' GROUP BY 1)
SELECT run_id, CASE WHEN NOT open THEN 'skipped' WHEN contents IS NULL THEN 'empty' ELSE 'distributed' END AS outcome, CASE WHEN open THEN coalesce(contents, 0) ELSE 0 END AS contents, CASE WHEN open THEN coalesce(topics, 0) ELSE 0 END AS topics, CASE WHEN open THEN coalesce(included, 0) ELSE 0 END AS included FROM runs LEFT JOIN counted USING (run_id) LEFT JOIN hits USING (run_id)""")
def t23(spark: SparkSession, d: str) -> DataFrame:
    contents = _contents(spark, d)
    return detail.distribution(tables.crawl_runs(spark, d), contents, topics.match(contents, TOPICS))


LINES = "l AS (SELECT l_orderkey AS e, l_linenumber AS n, min(l_returnflag) AS tag, min(l_suppkey) AS s, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Orders as editions: a line is a story, its supplier the section, its return flag the tag."""
    lines = tables.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("edition_id"), F.col("l_linenumber").alias("story_ref"))
    return lines.agg(F.min("l_returnflag").alias("tag"), F.min("l_suppkey").alias("s"), F.max("l_quantity").alias("q"))


def _placed(rows: DataFrame, section, ref, place, intro) -> DataFrame:
    return rows.select("edition_id", section.alias("section_place"), F.concat(F.lit("s"), section.cast("string")).alias("section_key"), ref.alias("story_ref"), place.alias("story_place"), intro.alias("in_intro"))


@query("q40_completed_editions", f"""WITH {LINES},
pl AS (SELECT e, s % 3 AS sp, n AS ref, n AS place, q > 10 AS intro FROM l WHERE n % 3 <> 0 UNION ALL SELECT e, 0, 101, 50, TRUE FROM l WHERE n = 1 UNION ALL SELECT e, 2, 2, 60, TRUE FROM l WHERE n = 2),
g AS (SELECT e, sp, ref, min(place) AS place, bool_or(intro) AS intro FROM pl WHERE EXISTS (SELECT 1 FROM l WHERE l.e = pl.e AND l.n = pl.ref) GROUP BY 1, 2, 3),
f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY e, ref ORDER BY sp, place) = 1), k AS (SELECT e, sp FROM f GROUP BY 1, 2 HAVING bool_or(intro)),
o AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.e = l.e AND f.ref = l.n)),
a AS (SELECT o.e, n, coalesce(min(sp) FILTER (WHERE sp = 0 AND tag IN ('A', 'X') OR sp = 2 AND tag = 'R'), min(sp) FILTER (WHERE sp = 1), max(sp)) AS sp FROM o JOIN k ON k.e = o.e GROUP BY 1, 2)
SELECT e AS edition_id, sp AS section_place, 's' || sp AS section_key, ref AS story_ref, place AS story_place, intro AS in_intro, 'editor' AS origin FROM f WHERE EXISTS (SELECT 1 FROM k WHERE k.e = f.e AND k.sp = f.sp)
UNION ALL SELECT e, sp, 's' || sp, n, n, FALSE, 'appended' FROM a UNION ALL SELECT e, sp, 's' || sp, ref, place, intro, 'unchanged' FROM pl WHERE e NOT IN (SELECT e FROM k)""")
def q40(spark: SparkSession, d: str) -> DataFrame:
    lines, ref = written(_lines(spark, d), "lines"), F.col("story_ref")
    yes = F.lit(True)
    placed = _placed(lines.where("story_ref % 3 <> 0"), F.col("s") % 3, ref, ref, F.col("q") > 10)
    placed = placed.unionByName(_placed(lines.where("story_ref = 1"), F.lit(0), F.lit(101), F.lit(50), yes)).unionByName(_placed(lines.where("story_ref = 2"), F.lit(2), ref, F.lit(60), yes))
    stories = lines.select("edition_id", "story_ref", ref.alias("story_place"), F.array("tag").alias("tags"))
    catalog = spark.createDataFrame([("s0", "A"), ("s0", "X"), ("s2", "R")], "section_key string, tag_key string")
    return editions.complete(placed, stories, catalog, "s1")


@query("q41_reused_editions", f"""WITH {LINES}, c AS (SELECT e, n FROM l WHERE n % 3 <> 0 AND q > 20 OR e % 5 = 0 AND n % 3 = 0)
SELECT e AS edition_id, s % 3 AS section_place, 's' || (s % 3) AS section_key, n AS story_ref, n AS story_place FROM l JOIN c USING (e, n) WHERE e NOT IN (SELECT e FROM c WHERE n % 3 = 0)""")
def q41(spark: SparkSession, d: str) -> DataFrame:
    lines, ref = _lines(spark, d), F.col("story_ref")
    prior = _placed(lines.where("story_ref % 3 <> 0"), F.col("s") % 3, ref, ref, F.lit(True))
    return editions.reuse(prior, lines.where("story_ref % 3 <> 0 AND q > 20 OR edition_id % 5 = 0 AND story_ref % 3 = 0"))


@query("q43_cache_keys", """SELECT doc_id AS id, sha256('{"client":"local","input":"' || sha256(text) || '","prompt":"' || sha256('Summarise.') || '","schema":"' || sha256('{}') || '","task":"content","validator":"2","version":"1"}') AS cache_key FROM documents""")
def q43(spark: SparkSession, d: str) -> DataFrame:
    key = editions.cache_key("content", "1", "2", "Summarise.", "{}", "local", F.col("text"))
    return tables.read(spark, d, "documents").select(F.col("doc_id").alias("id"), key.alias("cache_key"))
