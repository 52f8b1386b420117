"""Queries of sources, ingestion, assignments, entities and event plans, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import content, entities, events, health, ingest, relevance, topics
from newsloom.plans import tables
from newsloom.plans.queries import _topic_sql, AS_OF, NOW, TOPICS, at
from newsloom.plans.registry import query
from newsloom.plans.tables import with_tables
from newsloom.sources import feeds, pages

NONE = "array<string>"


# Sources ------------------------------------------------------------------------------------------------------------


@query("s2_feed_entries", """SELECT s_suppkey AS source_id, unnest([0, 1, 2]) AS position, unnest(['g' || s_suppkey, 'https://f.example/b' || s_suppkey, 'g' || (s_suppkey + 1)]) AS entry_id, unnest(['https://f.example/a' || s_suppkey, 'https://f.example/b' || s_suppkey, NULL]) AS url,
 unnest([TIMESTAMP '2024-01-05 10:00:00', NULL, TIMESTAMP '2024-01-06 00:00:00']) AS published FROM supplier""")
def s2(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    xml = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0"><channel><item><guid>g'), k, F.lit("</guid><title>A</title><link>https://F.example/a"), k,
        F.lit("#top</link><pubDate>2024-01-05 10:00:00</pubDate></item><item><title>B</title><link>https://f.example/b"), k,
        F.lit("?utm_source=rss</link></item><item><guid>g"), (F.col("s_suppkey") + 1).cast("string"), F.lit("</guid><title>C</title><pubDate>2024-01-06</pubDate></item></channel></rss>"),
    )
    rows = tables.read(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), xml.alias("feed"))
    return feeds.feed_entries(rows).select("source_id", "position", "entry_id", "url", "published")


@query("s3_json_urls", "SELECT s_suppkey AS source_id, unnest([1, 2]) AS position, unnest(['https://j.example/a/' || s_suppkey, 'https://j.example/a/x' || s_suppkey]) AS url FROM supplier")
def s3(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    payload = F.concat(F.lit('{"data":{"items":[{"id":"'), k, F.lit('"},{"slug":"none"},{"id":"x'), k, F.lit('"},{"id":"'), k, F.lit('"}]}}'))
    rows = tables.read(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.lit("https://j.example/list").alias("start_url"), payload.alias("payload"))
    return feeds.json_urls(rows, "data.items", "/a/{id}").select("source_id", "position", "url")


@query("s4_sitemap_urls", "SELECT s_suppkey AS source_id, unnest([1, 2]) AS position, unnest(['https://m.example/news/' || s_suppkey, 'https://m.example/news/' || (s_suppkey + 1) || '?a=1&b=2']) AS url FROM supplier")
def s4(spark: SparkSession, d: str) -> DataFrame:
    loc = lambda x: F.concat(F.lit("<url><loc>"), x, F.lit("</loc></url>"))
    one = F.concat(F.lit("https://m.example/news/"), F.col("s_suppkey").cast("string"))
    two = F.concat(F.lit(" https://M.example/news/"), (F.col("s_suppkey") + 1).cast("string"), F.lit("?b=2&amp;a=1 "))
    xml = F.concat(F.lit("<urlset>"), loc(one), loc(F.lit("https://m.example/about")), loc(two), loc(one), F.lit("</urlset>"))
    rows = tables.read(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), xml.alias("xml"))
    return feeds.sitemap_urls(rows, "/news/").select("source_id", "position", "url")


@query("s11_engines", """WITH s AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'rss' WHEN 1 THEN 'api' WHEN 2 THEN 'web' ELSE 'mail' END AS channel, CASE WHEN s_suppkey % 3 = 0 THEN 'p' END AS provider, CASE WHEN s_suppkey % 5 = 0 THEN 'sitemap' END AS method, CASE WHEN s_suppkey % 7 = 0 THEN 'static_http' END AS k FROM supplier),
e AS (SELECT id, k, CASE WHEN channel = 'rss' THEN 'feed_direct' WHEN channel = 'api' AND provider IS NOT NULL THEN 'provider_api' WHEN method = 'sitemap' THEN 'sitemap_http' WHEN channel = 'api' THEN 'json_api' WHEN channel = 'web' THEN 'static_http' END AS engine FROM s)
SELECT id, engine, CASE WHEN engine IS NULL THEN 'no_engine' WHEN k <> engine THEN 'engine_mismatch' END AS engine_error FROM e""")
def s11(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    channel = F.when(k % 4 == 0, "rss").when(k % 4 == 1, "api").when(k % 4 == 2, "web").otherwise("mail")
    rows = tables.read(spark, d, "supplier").select(k.alias("id"), channel.alias("channel_type"), F.when(k % 3 == 0, "p").alias("provider"), F.when(k % 5 == 0, "sitemap").alias("method"), F.when(k % 7 == 0, "static_http").alias("engine_key"))
    return feeds.resolve_engine(rows).select("id", "engine", "engine_error")


@query("s19_cached_requests", """WITH r AS (SELECT c_custkey AS id, c_mktsegment || ' ' || (c_custkey % 50) AS q FROM customer), c AS (SELECT DISTINCT c_mktsegment || ' ' || (c_custkey % 50) AS q FROM customer WHERE c_custkey % 50 < 20)
SELECT id, sha256('web' || chr(10) || 'search' || chr(10) || q) AS request_hash, CASE WHEN q IN (SELECT q FROM c) THEN 0 ELSE 2 END AS credits FROM r""")
def s19(spark: SparkSession, d: str) -> DataFrame:
    q = F.concat_ws(" ", "c_mktsegment", (F.col("c_custkey") % 50).cast("string"))
    requests = tables.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("web").alias("provider"), F.lit("search").alias("operation"), q.alias("query"))
    held = tables.read(spark, d, "customer").select(q.alias("q"), (F.col("c_custkey") % 50).alias("m")).distinct()
    expires = F.when(F.col("m") < 20, at("2024-02-01 00:00:00")).otherwise(at("2024-01-01 00:00:00"))
    cache = held.select(F.sha2(F.concat_ws("\n", F.lit("web"), F.lit("search"), "q"), 256).alias("request_hash"), F.lit("{}").alias("response"), expires.alias("expires_at"))
    return ingest.cached_requests(requests, cache, at(NOW)).select("id", "request_hash", "credits")


@query("s28_robots", "SELECT page_id, page_id % 3 <> 0 OR page_id % 2 = 0 AS allowed FROM pages")
def s28(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("https://h.example/"), F.when(F.col("page_id") % 3 == 0, "private/x").otherwise("open/x"))
    rules = F.when(F.col("page_id") % 2 == 1, "User-agent: *\nDisallow: /private").otherwise("")
    return tables.read(spark, d, "pages").select("page_id", pages.robots_allow(rules, url).alias("allowed"))


@query("n16_parsed_dates", "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 5 THEN NULL WHEN 4 THEN date_trunc('day', o_orderdate) ELSE date_trunc('day', o_orderdate) - INTERVAL 8 HOUR END AS parsed FROM orders")
def n16(spark: SparkSession, d: str) -> DataFrame:
    forms = ("yyyy-MM-dd", "yyyy/M/d", "MMMM d, yyyy", "d MMM yyyy", "EEE, dd MMM yyyy 00:00:00 'GMT'")
    day = F.coalesce(*[F.when(F.col("o_orderkey") % 6 == k, F.date_format("o_orderdate", f)) for k, f in enumerate(forms)], F.lit("some day soon"))
    return tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), pages.parse_date(day, content.ZONE).alias("parsed"))


@query("n5_media", "SELECT doc_id AS id, CASE WHEN doc_id % 7 = doc_id % 3 THEN 'image https://m.example/' || (doc_id % 7) ELSE 'image https://m.example/' || (doc_id % 7) || '|image https://m.example/' || (doc_id % 3) END AS media FROM documents")
def n5(spark: SparkSession, d: str) -> DataFrame:
    url = lambda n: F.concat(F.lit(" https://m.example/"), (F.col("doc_id") % n).cast("string"))
    one = lambda kind, u: F.struct(F.lit(kind).alias("type"), u.alias("url"), F.lit("").alias("alt"))
    found = text.normalize_media(F.array(one("image/png", url(7)), one("video/mp4", F.lit("ftp://m.example/x")), one("", url(3))))
    listed = F.array_join(F.transform(found, lambda m: F.concat_ws(" ", m["type"], m["url"])), "|")
    return tables.read(spark, d, "documents").select(F.col("doc_id").alias("id"), listed.alias("media"))


# Ingestion ----------------------------------------------------------------------------------------------------------


@query("n8_contracts", """WITH a AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'A SPONSORED post' WHEN doc_id % 10 = 1 THEN 'The Weekly Review' ELSE 'News' END AS title, ['full', 'partial', 'metadata_only', NULL][CAST(doc_id % 4 AS INT) + 1] AS w FROM documents)
SELECT id, contains(lower(title), 'sponsored') AS is_sponsored, contains(lower(title), 'weekly review') AS is_roundup, CASE WHEN w = 'full' THEN TRUE WHEN w IS NOT NULL THEN FALSE END AS body_complete, coalesce(w = 'metadata_only', FALSE) AS metadata_only,
 CASE WHEN w IS NULL THEN 'completeness_unknown' WHEN w = 'partial' THEN 'partial_content' WHEN w = 'metadata_only' THEN 'metadata_only' ELSE '' END AS warnings FROM a""")
def n8(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    rows = tables.read(spark, d, "documents").select(
        k.alias("id"), F.when(k % 10 == 0, "A SPONSORED post").when(k % 10 == 1, "The Weekly Review").otherwise("News").alias("title"), F.col("text").alias("body"), F.lit("").alias("excerpt"),
        F.array().cast(NONE).alias("topics"), F.lit(None).cast(NONE).alias("warnings"), F.lit("en").alias("default_language"),
        F.when(k % 4 == 0, "full").when(k % 4 == 1, "partial").when(k % 4 == 2, "metadata_only").alias("content_completeness"),
    )
    return ingest.contract(rows).select("id", "is_sponsored", "is_roundup", "body_complete", "metadata_only", F.array_join("warnings", "|").alias("warnings"))


@query("n22_merged_enrichment", """SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 AND length(text) > 200 THEN length(text) ELSE length(substr(text, 1, 200)) END AS body_chars, CASE WHEN doc_id % 2 = 1 THEN 'feed' WHEN doc_id % 4 = 0 THEN 'web' ELSE NULL END AS author,
 CASE WHEN doc_id % 3 <> 0 THEN TIMESTAMP '2024-01-01' WHEN doc_id % 4 = 0 THEN TIMESTAMP '2024-01-05' END AS published_at, CASE WHEN doc_id % 4 = 0 THEN lang || '|' || source ELSE lang END AS topics FROM documents""")
def n22(spark: SparkSession, d: str) -> DataFrame:
    docs, k = tables.read(spark, d, "documents"), F.col("doc_id")
    url, none = F.concat(F.lit("https://e.example/"), k.cast("string")).alias("canonical_url"), F.array().cast(NONE)
    feed = docs.select(k.alias("id"), url, F.substring("text", 1, 200).alias("body"), F.when(k % 2 == 1, "feed").alias("author"), F.when(k % 3 != 0, at("2024-01-01")).alias("published_at"), F.lit("e").alias("excerpt"), F.array("lang").alias("topics"), none.alias("warnings"))
    web = docs.where("doc_id % 4 = 0").select(url, F.col("text").alias("body"), F.lit("web").alias("author"), at("2024-01-05").alias("published_at"), F.lit("w").alias("excerpt"), F.array("source").alias("topics"), none.alias("warnings"))
    return ingest.merge_enrichment(feed, web).select("id", F.length("body").alias("body_chars"), "author", "published_at", F.array_join("topics", "|").alias("topics"))


@query("n23_kept_verified", """SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 AND (doc_id % 2 <> 0 OR length(text) > 100) THEN length(text) ELSE length(substr(text, 1, 100)) END AS body_chars, doc_id % 2 = 0 OR (doc_id % 3 = 0 AND (doc_id % 2 <> 0 OR length(text) > 100)) AS body_complete FROM documents""")
def n23(spark: SparkSession, d: str) -> DataFrame:
    docs, k = tables.read(spark, d, "documents"), F.col("doc_id")
    new = docs.select(k.alias("identity_key"), F.substring("text", 1, 100).alias("body"), (k % 2 == 0).alias("body_complete"))
    old = docs.select(k.alias("identity_key"), F.col("text").alias("body"), (k % 3 == 0).alias("body_complete"))
    return ingest.keep_verified(new, old).select(F.col("identity_key").alias("id"), F.length("body").alias("body_chars"), "body_complete")


@query("i7_refreshed_duplicates", with_tables("content_items") + r""", l AS (SELECT id, source_id, content_hash FROM content_items WHERE length(trim(regexp_replace(body, '\s+', ' ', 'g'))) >= 200 AND content_hash IN (SELECT content_hash FROM content_items WHERE id >= 500)),
g AS (SELECT content_hash, min(id) AS duplicate_of_id FROM l GROUP BY 1 HAVING count(DISTINCT source_id) > 1) SELECT l.id, g.duplicate_of_id FROM l JOIN g ON g.content_hash = l.content_hash WHERE l.id <> g.duplicate_of_id""")
def i7(spark: SparkSession, d: str) -> DataFrame:
    items = tables.content_items(spark, d)
    touched = items.where("id >= 500").select("content_hash").distinct()
    return content.strict_duplicates(items.join(touched, "content_hash", "left_semi")).select("id", "duplicate_of_id")


@query("i8_timezone_repair", "SELECT o_orderkey AS id, o_orderdate - INTERVAL 8 HOUR AS published_at FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 2 = 0")
def i8(spark: SparkSession, d: str) -> DataFrame:
    raw = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("published_at"), (F.col("o_orderkey") % 3 == 0).alias("naive_time"), F.when(F.col("o_custkey") % 2 == 1, "UTC").alias("provider_zone"))
    return ingest.repair_timezone(raw, content.ZONE).select("id", "published_at")


@query("i12_existing_content", "WITH u AS (SELECT DISTINCT 'u' || o_custkey AS url FROM orders WHERE o_custkey % 2 = 0) SELECT url, (SELECT max(o_orderkey) FROM orders o WHERE 'u' || o.o_custkey = url OR 'u' || (o.o_custkey + 1) = url) AS content_id FROM u")
def i12(spark: SparkSession, d: str) -> DataFrame:
    orders, key = tables.read(spark, d, "orders"), lambda n: F.concat(F.lit("u"), (F.col("o_custkey") + n).cast("string"))
    items = orders.select(F.col("o_orderkey").alias("id"), key(0).alias("canonical_url"), key(1).alias("original_url"))
    return ingest.existing_for_url(orders.where("o_custkey % 2 = 0").select(key(0).alias("url")).distinct(), items)


@query("i13_source_for_url", "SELECT n_nationkey AS id, (SELECT arg_min(s_suppkey, (CASE s_suppkey % 4 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 0 THEN 3 ELSE 4 END, s_suppkey)) FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 9 = n_nationkey) AS source_id FROM nation")
def i13_source(spark: SparkSession, d: str) -> DataFrame:
    held = tables.sources(spark, d).withColumn("start_url", F.concat(F.lit("https://www.h"), (F.col("id") % 9).cast("string"), F.lit(".example/list")))
    urls = tables.read(spark, d, "nation").select(F.concat(F.lit("https://h"), F.col("n_nationkey").cast("string"), F.lit(".example/a")).alias("url"))
    found = ingest.source_for_url(urls, held)
    return found.select(F.regexp_extract("url", r"h(\d+)\.", 1).cast("int").alias("id"), "source_id")


@query("i14_retry_due", with_tables("content_items") + f" SELECT id FROM content_items WHERE (published_at IS NULL OR length(body) < 400) AND (id % 5 = 0 OR TIMESTAMP '{AS_OF}' + to_hours(CAST(id % 72 AS INTEGER)) <= TIMESTAMP '2024-01-28 00:00:00' - INTERVAL 24 HOUR)")
def i14(spark: SparkSession, d: str) -> DataFrame:
    tried = F.when(F.col("id") % 5 != 0, F.expr(f"timestampadd(HOUR, CAST(id % 72 AS INT), TIMESTAMP '{AS_OF}')"))
    return tables.content_items(spark, d).withColumn("last_attempt_at", tried).where(ingest.retry_due(at("2024-01-28 00:00:00"))).select("id")


@query("i15_discovered_matches", _topic_sql() + f""", a AS (SELECT m.*, coalesce(published_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND TIMESTAMP '{AS_OF}', FALSE) AS inside FROM m JOIN content_items c ON c.id = m.id)
SELECT id AS content_item_id, topic_id, inside OR id % 2 = 0 AS admitted, CASE WHEN barred OR NOT (inside OR id % 2 = 0) THEN 'exclude' ELSE 'include' END AS decision,
 CASE WHEN barred OR NOT (inside OR id % 2 = 0) THEN 0.0::DOUBLE ELSE greatest(CASE WHEN inside THEN least(1.0::DOUBLE, p) ELSE 0.0 END, 0.65::DOUBLE) END AS score FROM a""")
def i15(spark: SparkSession, d: str) -> DataFrame:
    items = tables.content_items(spark, d)
    found = topics.match(items, TOPICS)
    rows = topics.admit(found.join(items.select(F.col("id").alias("content_item_id"), "published_at"), "content_item_id"), "published_at", at(AS_OF) - F.expr("INTERVAL 7 DAYS"), at(AS_OF))
    prior = found.where("content_item_id % 2 = 0").select("topic_id", "content_item_id", F.lit(True).alias("admitted"))
    return topics.attach_discovered(rows, prior).select("content_item_id", "topic_id", "admitted", "decision", "score")


@query("i16_startable_sources", "SELECT s_suppkey AS source_id FROM supplier WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = s_suppkey AND o_orderstatus = 'P')")
def i16(spark: SparkSession, d: str) -> DataFrame:
    runs = tables.read(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded").alias("status"))
    return health.may_start(tables.read(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id")), runs)


# Health, assignments, entities, event plans -------------------------------------------------------------------------


@query("h11_viable_paths", """WITH p AS (SELECT l_suppkey AS source_id, l_returnflag AS kind, l_linestatus AS url, l_linenumber % 3 AS r FROM lineitem)
SELECT source_id, kind, url, CASE min(r) WHEN 0 THEN 'configured' WHEN 1 THEN 'verified' ELSE 'detected' END AS status FROM p GROUP BY 1, 2, 3""")
def h11(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("l_linenumber") % 3
    rows = tables.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("url"), F.when(r == 0, "configured").when(r == 1, "verified").otherwise("detected").alias("status"))
    return health.viable_paths(rows)


@query("h13_website_sources", with_tables("sources") + " SELECT id, channel_type FROM sources WHERE channel_type IN ('web', 'rss', 'api') AND discovery_method <> 'user_topic'")
def h13(spark: SparkSession, d: str) -> DataFrame:
    return health.website_sources(tables.sources(spark, d)).select("id", "channel_type")


@query("r2_pending_items", with_tables("content_items") + " SELECT id FROM content_items WHERE id % 3 = 0 OR id % 5 = 0")
def r2(spark: SparkSession, d: str) -> DataFrame:
    items = tables.content_items(spark, d)
    done = items.where("id % 3 <> 0").select(F.col("id").alias("content_item_id"), F.when(F.col("id") % 5 == 0, "old").otherwise(F.col("content_hash")).alias("input_content_hash"), F.lit("rules").alias("processor_name"), F.lit("v1").alias("processor_version"))
    return relevance.needs_processing(items, done, "rules", "v1").select("id")


@query("r8_valid_reviews", with_tables("content_items") + " SELECT id AS content_item_id FROM content_items WHERE id % 4 <> 0 AND id % 7 <> 0")
def r8(spark: SparkSession, d: str) -> DataFrame:
    items = tables.content_items(spark, d)
    quote = F.when(F.col("id") % 4 == 0, "no text holds this").otherwise(F.substring("body", 1, 20))
    reviews = items.select(F.col("id").alias("content_item_id"), F.when(F.col("id") % 7 == 0, "old").otherwise(F.col("content_hash")).alias("input_content_hash"), F.array(quote).alias("quotes"))
    return relevance.valid_reviews(reviews, items).select("content_item_id")


@query("r10_hybrid_baseline", "SELECT doc_id AS content_item_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0")
def r10(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.read(spark, d, "documents")
    decided = docs.select(F.col("doc_id").alias("content_item_id"), F.when(F.col("doc_id") % 3 == 0, "needs_llm_domain_review").otherwise("no_domain_evidence").alias("reason"))
    return relevance.hybrid_baseline(decided, docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("content_item_id"))).select("content_item_id")


@query("x4_registry_seed", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'created' WHEN s_suppkey % 5 = 0 THEN 'updated' ELSE 'kept' END AS action FROM supplier")
def x4(spark: SparkSession, d: str) -> DataFrame:
    k, rows = F.col("s_suppkey"), tables.read(spark, d, "supplier")
    old = rows.where("s_suppkey % 3 <> 0").select(k.cast("string").alias("registry_key"), F.when(k % 5 == 0, "Old Name").otherwise(F.col("s_name")).alias("canonical_name"), F.lit("organization").alias("entity_type"))
    policy = rows.select(k.alias("id"), k.cast("string").alias("registry_key"), F.col("s_name").alias("canonical_name"), F.lit("organization").alias("entity_type"))
    return entities.seed_registry(old, policy).select("id", "action")


@query("x7_alias_candidates", """WITH w AS (SELECT c_custkey AS mention_id, unnest(['n' || c_nationkey, 'm' || (c_nationkey % 10)]) AS a FROM customer), h AS (SELECT n_nationkey AS entity_id, CASE WHEN n_nationkey % 2 = 0 THEN 'n' || n_nationkey ELSE 'm' || (n_nationkey % 10) END AS a FROM nation)
SELECT DISTINCT mention_id, entity_id FROM w JOIN h ON h.a = w.a""")
def x7(spark: SparkSession, d: str) -> DataFrame:
    kind, n = F.lit("organization").alias("entity_type"), F.col("n_nationkey")
    names = tables.read(spark, d, "customer").select(F.col("c_custkey").alias("mention_id"), kind, F.concat(F.lit("N-"), F.col("c_nationkey").cast("string")).alias("surface"), F.concat(F.lit("M "), (F.col("c_nationkey") % 10).cast("string")).alias("canonical_name"))
    alias = F.when(n % 2 == 0, F.concat(F.lit("n"), n.cast("string"))).otherwise(F.concat(F.lit("m"), (n % 10).cast("string")))
    return entities.alias_candidates(names, tables.read(spark, d, "nation").select(n.alias("entity_id"), kind, alias.alias("normalized_alias")))


@query("x10_review_decisions", """WITH l AS (SELECT c_nationkey AS k, max(c_custkey) AS last FROM customer GROUP BY 1), r AS (SELECT n_nationkey AS k, CASE n_nationkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed' ELSE 'rejected' END AS status FROM nation),
m AS (SELECT r.k, r.status, CASE WHEN last % 2 = 0 THEN 'rejected' WHEN last IS NOT NULL THEN 'confirmed' END AS new FROM r LEFT JOIN l ON l.k = r.k)
SELECT k, CASE WHEN status = 'pending' THEN coalesce(new, status) ELSE status END AS status, CASE WHEN new IS NULL THEN 'none' WHEN status = 'pending' THEN 'applied' WHEN new = status THEN 'repeated' ELSE 'conflict' END AS outcome FROM m""")
def x10(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    reviews = tables.read(spark, d, "nation").select(n.alias("k"), n.cast("string").alias("candidate_key"), F.when(n % 3 == 0, "pending").when(n % 3 == 1, "confirmed").otherwise("rejected").alias("status"))
    decisions = tables.read(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("candidate_key"), F.when(F.col("c_custkey") % 2 == 0, "reject").otherwise("link").alias("action"), F.lit(1).alias("entity_id"), F.col("c_custkey").alias("decided_at"))
    return entities.decide(reviews, decisions).select("k", "status", "outcome")


@query("e11_plan_actions", "SELECT DISTINCT 'h' || o_custkey AS membership_hash, CASE WHEN o_custkey % 3 = 0 THEN 'created' WHEN o_custkey % 2 = 0 THEN 'superseded' ELSE 'reused' END AS action FROM orders")
def e11(spark: SparkSession, d: str) -> DataFrame:
    keyed = tables.read(spark, d, "orders").select("o_custkey", F.concat(F.lit("h"), F.col("o_custkey").cast("string")).alias("membership_hash"), F.lit("active").alias("status"))
    return events.apply_plan(keyed.where("o_custkey % 3 = 0 OR o_custkey % 2 <> 0"), keyed.where("o_custkey % 3 <> 0"))


@query("i17_discovered_pages", """WITH d AS (SELECT doc_id AS id, 'https://' || source || '.example/a/' || doc_id AS url, trim(text) AS text, trim(substr(text, 1, 30)) AS head FROM documents WHERE trim(text) <> '' AND trim(substr(text, 1, 30)) <> ''),
c AS (SELECT *, CASE WHEN id % 3 <> 0 THEN 'new' WHEN id % 5 <> 0 AND id % 6 = 0 THEN 'updated' ELSE 'reused' END AS action, id % 5 <> 0 AS whole FROM d)
SELECT id AS topic_id, url AS canonical_url, action, CASE WHEN whole THEN 'article' ELSE 'search_result' END AS page_type, CASE WHEN whole THEN 'Page ' || id ELSE head END AS title,
 CASE WHEN whole THEN substr(text, 1, 240) ELSE head END AS excerpt, CASE WHEN NOT whole THEN 'metadata_only' WHEN length(text) >= 400 THEN 'full' ELSE 'partial' END AS content_completeness,
 sha256(CASE WHEN NOT whole THEN head WHEN id % 3 = 0 AND length(text) < 500 THEN repeat('o', 500) ELSE text END) AS body_sha256 FROM c""")
def i17(spark: SparkSession, d: str) -> DataFrame:
    """Documents as candidates: a third is there, half of that needs enrichment; every fifth is a search result only."""
    from newsloom.operators import discovery

    key, body = F.col("doc_id"), F.trim("text")
    rows = tables.read(spark, d, "documents").where((body != "") & (F.trim(F.substring("text", 1, 30)) != "")).withColumn("url", F.concat(F.lit("https://"), "source", F.lit(".example/a/"), key.cast("string")))
    candidates = rows.select(
        key.alias("topic_id"), "url", F.substring("text", 1, 30).alias("title"), F.lit("h").alias("host"), F.lit("").alias("description"), F.concat(F.lit("Page "), key.cast("string")).alias("page_title"),
        F.lit(None).cast("string").alias("page_description"), F.when(key % 5 != 0, F.col("text")).alias("markdown"),
    )
    there = rows.where("doc_id % 3 = 0").select(F.col("url").alias("canonical_url"), F.repeat(F.lit("o"), F.lit(500)).alias("body"), (key % 6 == 0).alias("needs_enrichment"))
    found = discovery.outcomes(candidates, there)
    return found.select("topic_id", "canonical_url", "action", "page_type", "title", "excerpt", "content_completeness", F.sha2("body", 256).alias("body_sha256"))
