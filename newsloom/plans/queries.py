"""Queries over the logical tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import content, events, graph, health, ingest, reader, relevance, scoring, topics
from newsloom.plans import tables
from newsloom.plans.registry import query
from newsloom.plans.tables import with_tables

AS_OF, NOW, DAY = "2024-01-25 00:00:00", "2024-01-31 03:00:00", "2024-01-05"
FOLD = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def at(x: str):
    return F.lit(x).cast("timestamp")


# Scalars ------------------------------------------------------------------------------------------------------------


@query("n1_normalize_url", r"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS query FROM pages),
k AS (SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^utm_') AND NOT regexp_matches(lower(x), '^(fbclid|gclid|mc_cid|mc_eid|ref_src)(=|$)'))), '&') AS kept FROM p)
SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS normalized_url, regexp_replace(host, '^www\.', '') AS host_key FROM k""")
def n1(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "pages").select("page_id", text.normalize_url("url").alias("normalized_url"), text.host_key("url").alias("host_key"))


@query("n2_identity_key", with_tables("content_items") + " SELECT id, sha256(CASE WHEN id % 3 = 0 THEN 'guid:' || id WHEN id % 3 = 1 THEN 'url:http://h/' || id ELSE 'fallback:' || trim(title) || '|' || coalesce(strftime(published_at, '%Y-%m-%d %H:%M:%S'), '') END) AS identity_key FROM content_items")
def n2(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.content_items(spark, d).withColumns({"external": F.when(F.col("id") % 3 == 0, F.col("id").cast("string")), "url": F.when(F.col("id") % 3 == 1, F.concat(F.lit("http://h/"), "id"))})
    return rows.select("id", text.identity_key("external", "url", "title", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")).alias("identity_key"))


@query("n3_content_hash", with_tables("content_items") + " SELECT id, content_hash FROM content_items")
def n3(spark: SparkSession, d: str) -> DataFrame:
    return tables.content_items(spark, d).select("id", "content_hash")


@query("n4_normalize_topics", r"""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'AI|news|' || s_name ELSE 'AI|Ai robots|' || s_name END AS topics FROM supplier""")
def n4(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.read(spark, d, "supplier")
    given = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("AI, news"), F.lit("#ai"), F.lit("https://x/y"), F.col("s_name"))).otherwise(F.array(F.lit(" AI ;Ai  robots"), F.col("s_name"), F.lit("")))
    return rows.select(F.col("s_suppkey").alias("id"), F.array_join(text.normalize_topics(given), "|").alias("topics"))


@query("n6_word_counts_and_language", r"""SELECT doc_id AS id, len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)*|[\x{3400}-\x{9fff}]')) AS word_count,
 CASE WHEN len(regexp_extract_all(text, '[\x{3400}-\x{9fff}]')) >= 0.08 * len(regexp_extract_all(text, '[A-Za-z\x{3400}-\x{9fff}]')) AND len(regexp_extract_all(text, '[A-Za-z\x{3400}-\x{9fff}]')) > 0 THEN 'zh-CN' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'und' END AS language FROM documents""")
def n6(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "documents").select(F.col("doc_id").alias("id"), text.count_words("text").alias("word_count"), text.detect_language("text", F.lit("und")).alias("language"))


@query("n10_quality_tier", with_tables("content_items") + """ SELECT id, CASE WHEN metadata_only OR published_at IS NULL OR trim(body) = '' THEN 'needs_enrichment' WHEN body_complete THEN 'verified_full'
 WHEN length(body) >= 200 THEN 'partial' ELSE 'needs_enrichment' END AS quality_tier FROM content_items""")
def n10(spark: SparkSession, d: str) -> DataFrame:
    return tables.content_items(spark, d).select("id", content.quality_tier().alias("quality_tier"))


@query("n11_eligible_items", with_tables("content_items") + " SELECT id, coalesce(published_at, discovered_at) AS effective_at FROM eligible")
def n11(spark: SparkSession, d: str) -> DataFrame:
    return content.eligible(tables.content_items(spark, d)).select("id", content.effective_time().alias("effective_at"))


@query("n17_url_dates", "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS url_date FROM orders")
def n17(spark: SparkSession, d: str) -> DataFrame:
    form = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy/M/d")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    far = F.when(F.year("o_orderdate") < 2000, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(form)
    url = F.concat(F.lit("https://h/news/"), far, F.lit("/a.html"))
    return tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.coalesce(text.url_date(url), F.to_date("o_orderdate")).alias("url_date"))


@query("n21_enrichment_needs", with_tables("content_items") + " SELECT id, published_at IS NULL OR length(body) < 400 OR NOT coalesce(body_complete, FALSE) AS needs_enrichment, CASE WHEN published_at IS NULL THEN 'unknown' WHEN length(body) >= 400 THEN 'full' WHEN length(body) >= 200 THEN 'partial' ELSE 'unknown' END AS completeness FROM content_items")
def n21(spark: SparkSession, d: str) -> DataFrame:
    return tables.content_items(spark, d).select("id", content.needs_enrichment().alias("needs_enrichment"), content.direct_completeness().alias("completeness"))


@query("n24_publication_window", with_tables("content_items") + f" SELECT id, published_at IS NULL OR CAST(published_at + INTERVAL 8 HOUR AS DATE) BETWEEN DATE '{DAY}' - 6 AND DATE '{DAY}' AS admitted FROM content_items")
def n24(spark: SparkSession, d: str) -> DataFrame:
    return ingest.gate(tables.content_items(spark, d), F.lit(DAY).cast("date"), 7).select("id", "admitted")


@query("n46_title_similarity", with_tables("content_items") + r""", g AS (SELECT id, source_id, regexp_replace(lower(title), '[^\p{L}\p{N}]', '', 'g') AS t FROM content_items WHERE title <> ''),
n AS (SELECT id, source_id, CASE WHEN length(t) = 0 THEN [] WHEN length(t) <= 3 THEN [t] ELSE list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) END AS grams FROM g),
p AS (SELECT a.id AS id, b.id AS next_id, a.grams AS x, b.grams AS y FROM n a JOIN n b ON b.id = a.id + 1)
SELECT id, next_id, CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN CAST(len(list_intersect(x, y)) AS DOUBLE) / len(list_distinct(list_concat(x, y))) END AS similarity FROM p""")
def n46(spark: SparkSession, d: str) -> DataFrame:
    grams = tables.content_items(spark, d).where("title <> ''").select("id", text.char_ngrams("title", 3).alias("g"))
    other = grams.select((F.col("id") - 1).alias("id"), F.col("id").alias("next_id"), F.col("g").alias("h"))
    return grams.join(other, "id").select("id", "next_id", text.jaccard(F.col("g"), F.col("h")).alias("similarity"))


@query("n51_summaries", r"""WITH f AS (SELECT doc_id AS id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT id, CASE WHEN length(t) <= 260 THEN t ELSE rtrim(substr(t, 1, 259), '，。；;,. ') || '…' END AS summary FROM f""")
def n51(spark: SparkSession, d: str) -> DataFrame:
    return tables.read(spark, d, "documents").select(F.col("doc_id").alias("id"), text.summary("text").alias("summary"))


# Sources ------------------------------------------------------------------------------------------------------------


@query("s30_page_snapshots", r"""SELECT page_id, sha256(html) AS body_sha256, strlen(html) AS body_bytes FROM pages""")
def s30(spark: SparkSession, d: str) -> DataFrame:
    from newsloom.sources.pages import snapshots

    return snapshots(tables.read(spark, d, "pages")).drop("url")


@query("s1_article_links")
def s1(spark: SparkSession, d: str) -> DataFrame:
    from newsloom.sources.pages import discover_articles, page_facts

    return discover_articles(tables.read(spark, d, "pages").select("page_id", "url", page_facts(F.col("html")).alias("facts")))


@query("n12_extracted_articles")
def n12(spark: SparkSession, d: str) -> DataFrame:
    from newsloom.sources.pages import extract_articles, page_facts

    return extract_articles(tables.read(spark, d, "pages").select("page_id", "url", page_facts(F.col("html")).alias("facts")))


@query("n20_page_topics", """SELECT page_id, concat_ws('|', 'k' || (page_id % 3), 'A', 'B', 'Topic ' || (page_id % 5), 'tag ' || (page_id % 4), 'X' || (page_id % 2), 'Label ' || (page_id % 6)) AS topics FROM pages""")
def n20(spark: SparkSession, d: str) -> DataFrame:
    """Pages behind a head with a graph of structured data, an article tag, keywords and a link marked as a tag."""
    from newsloom.sources.pages import page_facts, page_topics

    left = lambda n: (F.col("page_id") % n).cast("string")
    head = F.concat(
        F.lit('<script type="application/ld+json">{"@graph":[{"@type":"WebPage","keywords":"no"},{"@type":["NewsArticle"],"keywords":["k'), left(3), F.lit('",["A, B"]],"about":{"name":"Topic '), left(5),
        F.lit('"}}]}</script><meta property="article:tag" content="tag '), left(4), F.lit('"><meta name="keywords" content="a;X'), left(2), F.lit('"><a rel="tag" href="/t">Label '), left(6), F.lit("</a>"),
    )
    rows = tables.read(spark, d, "pages").select("page_id", page_facts(F.concat(head, F.coalesce("html", F.lit("")))).alias("facts"))
    return rows.select("page_id", F.array_join(page_topics(F.col("facts")), "|").alias("topics"))


@query("s15_exclusion_reasons", """SELECT doc_id, ['explicit_pinned_flag', 'explicit_advertising_flag', 'explicit_advertising_type', 'explicit_pinned_label', 'explicit_advertising_label', NULL, NULL][CAST(doc_id % 7 AS INT) + 1] AS reason FROM documents""")
def s15(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a provider's items, a seventh for each reason, the rest with harmless flags and labels."""
    from newsloom.sources.feeds import exclusion_reason

    told = ('"isTop":1,"isAd":true', '"sponsored":" Yes ","tags":["top"]', '"itemType":"","contentType":"Promotion"', '"tagList":[{"name":"","label":"news，置顶"}]', '"categories":"world; Ad","isTop":0', '"isPinned":"no","labels":["topic"]', '"contentKeywords":[]')
    member = F.element_at(F.array(*map(F.lit, told)), (F.col("doc_id") % 7 + 1).cast("int"))
    rows = tables.read(spark, d, "documents").select("doc_id", F.concat(F.lit("{"), member, F.lit(',"title":'), F.substring(F.to_json(F.array(F.coalesce("text", F.lit("")))), F.lit(2), F.length(F.to_json(F.array(F.coalesce("text", F.lit(""))))) - 2), F.lit("}")).alias("item"))
    return rows.select("doc_id", exclusion_reason(F.col("item")).alias("reason"))


@query("s24_json_list_paths", """SELECT doc_id, concat_ws('|', 'data.items', CASE WHEN doc_id % 3 = 0 THEN 'k0' END, 'deep.a.b', 'rows') AS paths FROM documents""")
def s24(spark: SparkSession, d: str) -> DataFrame:
    """A nested listing for every document, which holds its text as a title."""
    from newsloom.sources.pages import json_list_paths

    rows = tables.read(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("title"))).alias("one"))
    key = (F.col("doc_id") % 3).cast("string")
    whole = F.concat(
        F.lit('{"data":{"items":['), "one", F.lit(',{}],"meta":[1]},"k'), key, F.lit('":'), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("["), "one", F.lit("]"))).otherwise("[]"),
        F.lit(',"deep":{"a":{"b":['), "one", F.lit('],"c":{"d":[{}]}}},"rows":[{},{}]}'),
    )
    return rows.select("doc_id", F.array_join(json_list_paths(whole), "|").alias("paths"))


@query("s21_probe", "SELECT url, CASE WHEN page_id % 9 = 0 THEN 'blocked' ELSE 'html' END AS detected_format, CASE WHEN page_id % 9 = 0 THEN 'rate_limited' END AS block_reason FROM pages")
def s21(spark: SparkSession, d: str) -> DataFrame:
    from newsloom.sources.pages import page_facts, probe

    rows = tables.read(spark, d, "pages").select("url", F.when(F.col("page_id") % 9 == 0, 429).otherwise(200).alias("status"), F.lit("text/html").alias("content_type"), F.col("html").alias("body"), page_facts(F.col("html")).alias("facts"))
    return probe(rows).select("url", "detected_format", "block_reason")


@query("s27_url_policy", r"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'private_address' WHEN page_id % 4 = 1 THEN 'unsupported_scheme' END AS error FROM pages""")
def s27(spark: SparkSession, d: str) -> DataFrame:
    from newsloom.sources.pages import url_errors

    url = F.when(F.col("page_id") % 4 == 0, "http://10.0.0.1/x").when(F.col("page_id") % 4 == 1, "ftp://h.example/x").otherwise(F.col("url"))
    return tables.read(spark, d, "pages").select("page_id", url_errors(url).alias("error"))


# Duplicates, relevance, domains -------------------------------------------------------------------------------------


@query("d1_strict_duplicates", with_tables("content_items") + r""", long AS (SELECT id, source_id, content_hash FROM content_items WHERE length(trim(regexp_replace(body, '\s+', ' ', 'g'))) >= 200),
g AS (SELECT content_hash, min(id) AS first FROM long GROUP BY content_hash HAVING count(DISTINCT source_id) >= 2)
SELECT l.id, g.first AS duplicate_of_id FROM long l JOIN g USING (content_hash) WHERE l.id <> g.first""")
def d1(spark: SparkSession, d: str) -> DataFrame:
    return content.strict_duplicates(tables.content_items(spark, d)).select("id", "duplicate_of_id")


@query("d2_duplicate_summary", with_tables("content_items") + r""", long AS (SELECT id, source_id, content_hash FROM content_items WHERE length(trim(regexp_replace(body, '\s+', ' ', 'g'))) >= 200),
g AS (SELECT content_hash, count(*) - 1 AS n FROM long GROUP BY content_hash HAVING count(DISTINCT source_id) >= 2)
SELECT (SELECT count(*) FROM content_items) AS scanned, (SELECT count(*) FROM g) AS groups, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM g) AS duplicates""")
def d2(spark: SparkSession, d: str) -> DataFrame:
    return content.duplicate_summary(tables.content_items(spark, d))


INDUSTRY, EVENTS = ["the", "und", "desk 1"], ["that", "nicht", "para"]


@query("r1_rule_relevance", with_tables("content_items") + """, t AS (SELECT id, lower(concat_ws(' ', nullif(title, ''), nullif(excerpt, ''), nullif(body, ''))) AS x, lower(array_to_string(topics, ' ')) AS g FROM content_items),
m AS (SELECT id, list_filter(['desk 1', 'the', 'und'], lambda k: contains(x, k) OR contains(g, k)) AS a, list_filter(['desk 1', 'the', 'und'], lambda k: contains(g, k)) AS b, list_filter(['nicht', 'para', 'that'], lambda k: contains(x, k)) AS e FROM t)
SELECT id, len(a) > 0 AND len(e) > 0 AS is_relevant, array_to_string(a, '|') AS matched_topics, CASE WHEN len(a) = 0 THEN 'no_industry_match' WHEN len(e) = 0 THEN 'no_event_match' WHEN len(b) > 0 THEN 'tag_match' ELSE 'rule_match' END AS reason FROM m""")
def r1(spark: SparkSession, d: str) -> DataFrame:
    rows = relevance.evaluate(tables.content_items(spark, d), INDUSTRY, EVENTS)
    return rows.select("id", "is_relevant", F.array_join("matched_topics", "|").alias("matched_topics"), "reason")


@query("r3_domain_relevance", with_tables("content_items") + r""", t AS (SELECT id, source_id, lower(concat_ws(' ', nullif(title, ''), nullif(excerpt, ''), nullif(body, ''), array_to_string(topics, ' '))) AS x FROM content_items),
m AS (SELECT id, source_id % 5 = 0 AS own, list_filter(['that', 'trash'], lambda k: regexp_matches(x, '(^|[^a-z0-9])' || k || '($|[^a-z0-9])')) AS k FROM t)
SELECT id, own AS is_relevant, CASE WHEN own THEN '' ELSE array_to_string(k, '|') END AS matched_topics, CASE WHEN own THEN 'dedicated_domain_source' WHEN len(k) > 0 THEN 'needs_llm_domain_review' ELSE 'no_domain_evidence' END AS reason FROM m""")
def r3(spark: SparkSession, d: str) -> DataFrame:
    tags = F.when(F.col("source_id") % 5 == 0, F.array(F.lit("Beauty"))).otherwise(F.array(F.lit("general")))
    rows = relevance.domain_relevance(tables.content_items(spark, d), ["that", "trash"], ["beauty"], tags)
    return rows.select("id", "is_relevant", F.array_join("matched_topics", "|").alias("matched_topics"), "reason")


@query("r6_domain_assignments", with_tables("content_items", "assignments") + """, n AS (SELECT id AS content_item_id, CASE WHEN id % 2 = 0 THEN 'include' ELSE 'exclude' END AS decision, content_hash FROM content_items)
SELECT n.content_item_id, n.decision, CASE WHEN a.decision IS NULL THEN 'created' WHEN a.decision = n.decision AND a.input_content_hash = n.content_hash THEN 'skipped' ELSE 'updated' END AS action FROM n LEFT JOIN assignments a USING (content_item_id)""")
def r6(spark: SparkSession, d: str) -> DataFrame:
    items = tables.content_items(spark, d)
    results = items.select(F.col("id").alias("content_item_id"), (F.col("id") % 2 == 0).alias("is_relevant"), F.col("content_hash").alias("input_content_hash"), F.lit("rule").alias("reason"))
    return relevance.project_assignments(results, tables.assignments(spark, d, items)).select("content_item_id", "decision", "action")


# Value scores -------------------------------------------------------------------------------------------------------

SCORES_SQL = with_tables("content_items", "assignments", "item_events") + f""",
long AS (SELECT id, source_id, content_hash FROM content_items WHERE length(trim(regexp_replace(body, '\\s+', ' ', 'g'))) >= 200),
dg AS (SELECT content_hash, min(id) AS first FROM long GROUP BY content_hash HAVING count(DISTINCT source_id) >= 2),
dup AS (SELECT l.id FROM long l JOIN dg USING (content_hash) WHERE l.id <> dg.first),
ev AS (SELECT e.event_id, count(*) AS m, count(DISTINCT c.source_id) AS s FROM item_events e JOIN content_items c ON c.id = e.content_item_id WHERE e.is_active GROUP BY 1),
st AS (SELECT e.content_item_id AS id, ev.s FROM item_events e JOIN ev USING (event_id) WHERE e.is_active),
j AS (SELECT c.*, a.confidence, coalesce(st.s, 1) AS s, dup.id IS NOT NULL AS is_dup, (epoch(TIMESTAMP '{AS_OF}') - epoch(c.published_at)) / 3600 AS age FROM assignments a JOIN content_items c ON c.id = a.content_item_id AND c.content_hash = a.input_content_hash
  LEFT JOIN st ON st.id = c.id LEFT JOIN dup ON dup.id = c.id WHERE a.decision = 'include' AND (c.published_at IS NULL OR c.published_at <= TIMESTAMP '{AS_OF}')),
q AS (SELECT *, CASE WHEN published_at IS NULL THEN 0.0::DOUBLE WHEN age <= 24 THEN 1.0::DOUBLE WHEN age >= 168 THEN 0.0::DOUBLE ELSE (168 - age)::DOUBLE / 144 END AS r,
  CASE source_type WHEN 'research_media' THEN 0.95::DOUBLE WHEN 'trade_media' THEN 0.85::DOUBLE WHEN 'wechat_official_account' THEN 0.72::DOUBLE ELSE 0.65::DOUBLE END AS sq,
  CASE WHEN body_complete THEN 1.0::DOUBLE WHEN NOT body_complete THEN 0.35::DOUBLE ELSE 0.6::DOUBLE END * 0.5::DOUBLE + least(1.0::DOUBLE, length(trim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))::DOUBLE / 1200) * 0.3::DOUBLE
   + CASE access_level WHEN 'public' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.6::DOUBLE ELSE 0.45::DOUBLE END * 0.2::DOUBLE AS cp,
  CASE WHEN s < 2 THEN 0.0::DOUBLE WHEN s >= 3 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS co FROM j),
p AS (SELECT id AS content_item_id, floor(r * 0.25::DOUBLE * 100 * 10000 + 0.5) / 10000 AS recency_points, floor(sq * 0.2::DOUBLE * 100 * 10000 + 0.5) / 10000 AS source_quality_points, floor(cp * 0.2::DOUBLE * 100 * 10000 + 0.5) / 10000 AS completeness_points,
  floor(co * 0.25::DOUBLE * 100 * 10000 + 0.5) / 10000 AS corroboration_points, floor(confidence * 0.1::DOUBLE * 100 * 10000 + 0.5) / 10000 AS domain_confidence_points, CASE WHEN is_sponsored THEN 25.0::DOUBLE ELSE 0.0::DOUBLE END AS penalty_points,
  concat_ws(',', CASE WHEN published_at IS NULL THEN 'missing_published_at' END, CASE WHEN is_dup THEN 'duplicate' END) AS gates FROM q),
t AS (SELECT *, floor(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 0.0::DOUBLE + recency_points + source_quality_points + completeness_points + corroboration_points + 0.0::DOUBLE + domain_confidence_points - penalty_points)) * 100 + 0.5) / 100 AS total_score FROM p),
scores AS (SELECT content_item_id, recency_points, source_quality_points, completeness_points, corroboration_points, domain_confidence_points, penalty_points, gates, total_score, CASE WHEN total_score >= 50 AND gates = '' THEN 'selected' ELSE 'full_pool' END AS decision FROM t)"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    items = tables.content_items(spark, d)
    found = scoring.event_statistics(tables.item_events(spark, d), items)
    return scoring.value_scores(items, tables.assignments(spark, d, items), found, None, content.strict_duplicates(items), at(AS_OF))


@query("v1_value_scores", SCORES_SQL + " SELECT * FROM scores")
def v1(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).drop("input_content_hash", "confirmed_entities_points")


@query("v5_event_statistics", with_tables("content_items", "item_events") + """, ev AS (SELECT e.event_id, count(*) AS m, count(DISTINCT c.source_id) AS s FROM item_events e JOIN content_items c ON c.id = e.content_item_id WHERE e.is_active GROUP BY 1)
SELECT e.content_item_id, ev.m AS member_count, ev.s AS source_count FROM item_events e JOIN ev USING (event_id) WHERE e.is_active""")
def v5(spark: SparkSession, d: str) -> DataFrame:
    return scoring.event_statistics(tables.item_events(spark, d), tables.content_items(spark, d))


def _runs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two runs of one domain and one of another, of which the later and the other's count."""
    spread = rows.select("content_item_id", "decision", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("run_id"))
    flip = F.when((F.col("run_id") == 1) & (F.col("content_item_id") % 2 == 0), "selected").when((F.col("run_id") == 3) & (F.col("content_item_id") % 10 == 0), "selected").otherwise(F.when(F.col("run_id") == 3, "full_pool").otherwise(F.col("decision")))
    runs = rows.sparkSession.createDataFrame([(1, 1, "succeeded"), (2, 1, "succeeded"), (3, 2, "succeeded"), (4, 2, "failed")], "id int, domain_id int, status string")
    return spread.withColumn("decision", flip), runs


@query("v8_latest_decisions", SCORES_SQL + " SELECT content_item_id, CASE WHEN decision = 'selected' OR content_item_id % 10 = 0 THEN 'selected' ELSE 'full_pool' END AS decision FROM scores")
def v8(spark: SparkSession, d: str) -> DataFrame:
    return scoring.latest_decisions(*_runs(scores(spark, d)))


@query("v9_curated_items", SCORES_SQL + " SELECT id FROM content_items WHERE id NOT IN (SELECT content_item_id FROM scores WHERE decision = 'full_pool')")
def v9(spark: SparkSession, d: str) -> DataFrame:
    return scoring.curated(tables.content_items(spark, d), scores(spark, d)).select("id")


# Source health ------------------------------------------------------------------------------------------------------

RECENT_SQL = ", r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS place FROM crawl_runs)"


@query("h1_schedule_slots", """WITH e AS (SELECT event_id AS id, ts, ts + INTERVAL 8 HOUR AS l FROM events), s AS (SELECT id, ts, l, CAST(CAST(l AS DATE) AS TIMESTAMP) AS day FROM e)
SELECT id, CASE WHEN l >= day + INTERVAL 18 HOUR THEN day + INTERVAL 10 HOUR WHEN l >= day + INTERVAL 570 MINUTE THEN day + INTERVAL 90 MINUTE ELSE day - INTERVAL 14 HOUR END AS slot_start,
 CASE WHEN l < day + INTERVAL 570 MINUTE THEN day + INTERVAL 90 MINUTE WHEN l < day + INTERVAL 18 HOUR THEN day + INTERVAL 10 HOUR ELSE day + INTERVAL 1530 MINUTE END AS next_start FROM s""")
def h1(spark: SparkSession, d: str) -> DataFrame:
    now = F.col("ts").cast("timestamp")
    return tables.read(spark, d, "events").select(F.col("event_id").alias("id"), health.current_slot(now).alias("slot_start"), health.next_slot(now).alias("next_start"))


@query("h4_recent_runs", with_tables("crawl_runs") + RECENT_SQL + " SELECT source_id, place, id, status FROM r WHERE place <= 5")
def h4(spark: SparkSession, d: str) -> DataFrame:
    return health.recent_runs(tables.crawl_runs(spark, d)).select("source_id", "place", "id", "status")


@query("h5_failure_streaks", with_tables("harsh_runs") + RECENT_SQL + " SELECT source_id, count(*) FILTER (WHERE ok = 0) AS consecutive_failures FROM (SELECT source_id, sum(CASE WHEN status = 'failed' THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY place) AS ok FROM r WHERE place <= 5) GROUP BY source_id")
def h5(spark: SparkSession, d: str) -> DataFrame:
    return health.failure_streaks(tables.crawl_runs(spark, d, harsh=True))


HEALTH_SQL = with_tables("harsh_runs", "sources") + RECENT_SQL + f""", k AS (SELECT source_id, count(*) FILTER (WHERE ok = 0) AS consecutive_failures FROM (SELECT source_id, sum(CASE WHEN status = 'failed' THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY place) AS ok FROM r WHERE place <= 5) GROUP BY source_id),
h AS (SELECT r.source_id, r.id AS last_run_id, r.status AS last_run_status, r.started_at AS last_started_at, k.consecutive_failures, k.consecutive_failures >= 3 AND r.started_at + INTERVAL 6 HOUR > TIMESTAMP '{NOW}' AS circuit_open FROM r JOIN k USING (source_id) WHERE r.place = 1)"""


@query("h7_source_health", HEALTH_SQL + " SELECT * FROM h")
def h7(spark: SparkSession, d: str) -> DataFrame:
    return health.source_health(tables.crawl_runs(spark, d, harsh=True), at(NOW)).drop("last_finished_at")


@query("h8_due_sources", HEALTH_SQL + " SELECT s.id, s.name FROM sources s LEFT JOIN h ON h.source_id = s.id WHERE s.is_enabled AND s.crawl_strategy IS NULL AND s.discovery_method <> 'user_topic' AND NOT coalesce(h.circuit_open, FALSE) AND (h.last_started_at IS NULL OR h.last_started_at < TIMESTAMP '2024-01-31 01:30:00') ORDER BY s.id LIMIT 100")
def h8(spark: SparkSession, d: str) -> DataFrame:
    return health.due_sources(tables.sources(spark, d), tables.crawl_runs(spark, d, harsh=True), at(NOW)).select("id", "name")


@query("h9_stale_runs", with_tables("crawl_runs") + f" SELECT id, CASE WHEN id % 50 = 0 AND started_at < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR THEN 'failed' WHEN id % 50 = 0 THEN 'running' ELSE status END AS status, CASE WHEN id % 50 = 0 AND started_at < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR THEN 'stale_run_recovered' END AS error_code FROM crawl_runs")
def h9(spark: SparkSession, d: str) -> DataFrame:
    runs = tables.crawl_runs(spark, d).withColumn("status", F.when(F.col("id") % 50 == 0, "running").otherwise(F.col("status")))
    return health.recover_stale(runs, at(NOW)).select("id", "status", "error_code")


@query("h10_health_totals", with_tables("crawl_runs", "sources") + RECENT_SQL + " SELECT count(*) AS enabled, count(*) FILTER (WHERE status IN ('succeeded', 'unchanged')) AS succeeded, count(*) FILTER (WHERE status NOT IN ('succeeded', 'unchanged')) AS failed, count(*) FILTER (WHERE status IS NULL) AS never FROM sources s LEFT JOIN r ON r.source_id = s.id AND r.place = 1 WHERE is_enabled")
def h10(spark: SparkSession, d: str) -> DataFrame:
    return health.health_totals(tables.sources(spark, d), tables.crawl_runs(spark, d))


@query("h12_catalog_report", with_tables("crawl_runs", "sources") + RECENT_SQL + " SELECT s.id, s.name, coalesce(r.status, 'never') AS last_status, r.id AS last_run_id, coalesce(r.fetched_count, 0) AS fetched_count FROM sources s LEFT JOIN r ON r.source_id = s.id AND r.place = 1")
def h12(spark: SparkSession, d: str) -> DataFrame:
    return health.catalog_report(tables.sources(spark, d), tables.crawl_runs(spark, d))


# Topics and search --------------------------------------------------------------------------------------------------

TOPICS = [topics.Topic(1, ("that", "loser"), ("trash",)), topics.Topic(2, ("nicht", "para", "it"), ()), topics.Topic(3, ("人工智能",), ())]
NORM = "trim(regexp_replace(lower({}), '[\\s_]+', ' ', 'g'))"
_HIT = "regexp_matches({f}, '(^|[^a-z0-9])({v})($|[^a-z0-9])')"


def _topic_sql() -> str:
    hit = lambda f, v: "CAST(" + _HIT.format(f=f, v=v) + " AS INT)"
    words = {1: ["that|thats", "loser|losers"], 2: ["nicht|nichts", "para|paras", "it"]}
    fields = {"title": 0.42, "excerpt": 0.24, "topics": 0.28, "body": 0.10}
    parts = []
    for topic, vs in words.items():
        points = " + ".join("(" + " + ".join(hit(f, v) for v in vs if v != "it" or f == "title") + f") * {w}::DOUBLE" for f, w in fields.items())
        out = _HIT.format(f="everything", v="trash|trashes") if topic == 1 else "FALSE"
        parts.append(f"SELECT id, {topic} AS topic_id, {out} AS barred, 0.0::DOUBLE + {points} AS p, FALSE AS gap FROM n")
    parts.append("SELECT id, 3 AS topic_id, FALSE AS barred, 0.0::DOUBLE AS p, language LIKE 'en%' OR regexp_matches(lower(coalesce(title, '') || coalesce(excerpt, '') || substr(body, 1, 1200)), '[a-z0-9]') AS gap FROM n")
    return with_tables("content_items") + ", n AS (SELECT id, language, " + ", ".join(NORM.format(c) + f" AS {c}" for c in ("title", "excerpt", "body")) + ", " + NORM.format("array_to_string(topics, ' ')") + " AS topics, concat_ws(chr(10), " + ", ".join(NORM.format(c) for c in ("title", "excerpt", "body")) + ", " + NORM.format("array_to_string(topics, ' ')") + ") AS everything FROM content_items), m AS (" + " UNION ALL ".join(parts) + """),
matches AS (SELECT id AS content_item_id, topic_id, CASE WHEN barred THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, p) END AS score, CASE WHEN barred THEN 'exclude' WHEN p >= 0.2 THEN 'include' WHEN p >= 0.1 THEN 'review' WHEN gap THEN 'review' ELSE 'exclude' END AS decision FROM m)"""


@query("t7_topic_matches", _topic_sql() + " SELECT * FROM matches")
def t7(spark: SparkSession, d: str) -> DataFrame:
    return topics.match(tables.content_items(spark, d), TOPICS).select("content_item_id", "topic_id", "score", "decision")


@query("t11_admitted_matches", _topic_sql() + f" SELECT content_item_id, topic_id, coalesce(published_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND TIMESTAMP '{AS_OF}', FALSE) AS admitted, CASE WHEN published_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND TIMESTAMP '{AS_OF}' THEN m.decision ELSE 'exclude' END AS decision, CASE WHEN published_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND TIMESTAMP '{AS_OF}' THEN score ELSE 0.0::DOUBLE END AS score FROM matches m JOIN content_items c ON c.id = m.content_item_id")
def t11(spark: SparkSession, d: str) -> DataFrame:
    items = tables.content_items(spark, d)
    rows = topics.match(items, TOPICS).join(items.select(F.col("id").alias("content_item_id"), "published_at"), "content_item_id")
    return topics.admit(rows, "published_at", at(AS_OF) - F.expr("INTERVAL 7 DAYS"), at(AS_OF)).select("content_item_id", "topic_id", "admitted", "decision", "score")


@query("t24_recent_pool", _topic_sql() + f""" SELECT m.topic_id, m.decision, count(*) AS contents FROM matches m JOIN content_items c ON c.id = m.content_item_id JOIN m AS raw ON raw.id = m.content_item_id AND raw.topic_id = m.topic_id
WHERE coalesce(c.published_at, c.discovered_at) BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND TIMESTAMP '{AS_OF}' AND (raw.barred OR raw.p > 0 OR raw.gap) GROUP BY 1, 2""")
def t24(spark: SparkSession, d: str) -> DataFrame:
    return topics.distribute(tables.content_items(spark, d), TOPICS, at(AS_OF) - F.expr("INTERVAL 7 DAYS"), at(AS_OF))


@query("t16_search", with_tables("content_items") + ", n AS (SELECT id, title, coalesce(published_at, discovered_at) AS effective_at, " + NORM.format("concat_ws(chr(10), title, excerpt, substr(body, 1, 4000))") + " AS blob FROM eligible) SELECT id, title, effective_at FROM n WHERE " + _HIT.format(f="blob", v="pathetic|pathetics") + " ORDER BY effective_at DESC, id DESC LIMIT 50")
def t16(spark: SparkSession, d: str) -> DataFrame:
    return topics.search(content.eligible(tables.content_items(spark, d)), "pathetic")


# Entities -----------------------------------------------------------------------------------------------------------


ALIASES_SQL = r""", alias AS (SELECT * FROM (VALUES (1, 'loser'), (2, 'scum'), (3, 'scum'), (4, 'mit'), (5, 'the')) AS v(entity_id, form)),
f AS (SELECT id, 'title' AS field, title AS text FROM content_items UNION ALL SELECT id, 'excerpt', excerpt FROM content_items UNION ALL SELECT id, 'body', body FROM content_items),
c AS (SELECT id, field, text, entity_id, form, string_split(lower(text), form) AS parts FROM f JOIN alias ON contains(lower(text), form)),
o AS (SELECT * EXCLUDE (parts), len(parts) AS n, unnest(list_transform(range(1, len(parts)), lambda k: list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(form))) AS start FROM c),
m AS (SELECT id, field, CAST(start AS INT) AS start_offset, CAST(start + length(form) AS INT) AS end_offset, substr(text, CAST(start AS BIGINT) + 1, length(form)) AS surface, entity_id FROM o
 WHERE NOT regexp_matches(substr(text, CAST(start AS BIGINT), 1), '[\p{L}\p{N}_]') AND NOT regexp_matches(substr(text, CAST(start + length(form) AS BIGINT) + 1, 1), '[\p{L}\p{N}_]'))"""


@query("x1_entity_mentions", with_tables("content_items") + ALIASES_SQL + """
SELECT id AS content_item_id, field, start_offset, end_offset, surface, CASE WHEN count(DISTINCT entity_id) = 1 THEN CAST(min(entity_id) AS BIGINT) END AS entity_id,
 CASE WHEN count(DISTINCT entity_id) = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution_status, CASE WHEN count(DISTINCT entity_id) = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence
FROM m GROUP BY id, field, start_offset, end_offset, surface""")
def x1(spark: SparkSession, d: str) -> DataFrame:
    from newsloom.operators.entities import Alias, find_mentions, resolve

    found = find_mentions(tables.content_items(spark, d), [Alias(1, "loser"), Alias(2, "scum"), Alias(3, "scum"), Alias(4, "MIT"), Alias(5, "The")])
    return resolve(found).select("content_item_id", "field", "start_offset", "end_offset", "surface", "entity_id", "resolution_status", "confidence")


@query("x2_mention_counts", r"""WITH t AS (SELECT doc_id AS id, text FROM documents) SELECT id AS content_item_id, len(regexp_extract_all(text, '(?i)\bloser\b')) AS n FROM t WHERE regexp_matches(text, '(?i)\bloser\b')""")
def x2(spark: SparkSession, d: str) -> DataFrame:
    from newsloom.operators.entities import Alias, find_mentions

    return find_mentions(tables.content_items(spark, d), [Alias(1, "loser")]).where("field = 'body'").groupBy("content_item_id").agg(F.count("*").alias("n"))


@query("x9_entity_reviews", """WITH m AS (SELECT o_orderkey AS mention_id, o_orderpriority AS entity_type, o_orderstatus || ' Corp' AS surface FROM orders)
SELECT entity_type, regexp_replace(lower(surface), '[^a-z0-9]', '', 'g') AS normalized_name, count(*) AS mention_count, min(mention_id) AS first_mention, sha256(entity_type || ':' || regexp_replace(lower(surface), '[^a-z0-9]', '', 'g')) AS candidate_key FROM m GROUP BY ALL""")
def x9(spark: SparkSession, d: str) -> DataFrame:
    from newsloom.operators.entities import review_queue

    rows = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("mention_id"), F.col("o_orderpriority").alias("entity_type"), F.concat("o_orderstatus", F.lit(" Corp")).alias("surface"), F.lit("e").alias("evidence_text"))
    return review_queue(rows).select("entity_type", "normalized_name", "mention_count", "first_mention", "candidate_key")


# Events -------------------------------------------------------------------------------------------------------------


@query("e6_event_clusters")
def e6(spark: SparkSession, d: str) -> DataFrame:
    items = tables.content_items(spark, d)
    return events.Plan(items, content.strict_duplicates(items).select("id", "duplicate_of_id")).members()


@query("e6_review_pairs")
def e6_review(spark: SparkSession, d: str) -> DataFrame:
    """With every ninety-seventh item in an event that a person fixed, and links between neighbours."""
    items = tables.content_items(spark, d)
    locked = items.where("id % 97 = 0").select(F.floor(F.col("id") / 970).cast("bigint").alias("event_key"), F.col("id").alias("content_item_id"))
    links = items.where("id % 50 = 3").select(F.col("id").alias("left"), (F.col("id") + 1).alias("right"), F.when(F.col("id") % 100 == 3, "must_link").otherwise("cannot_link").alias("relation"))
    return events.Plan(items, content.strict_duplicates(items).select("id", "duplicate_of_id"), links, locked).review()


@query("e12_components", """WITH RECURSIVE e AS (SELECT o_custkey AS u, o_custkey - (o_custkey % 7) AS v FROM orders), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r AS (SELECT u AS id, u AS c FROM b UNION SELECT b.u, r.c FROM r JOIN b ON b.v = r.id)
SELECT id, min(c) AS component FROM r GROUP BY id""")
def e12(spark: SparkSession, d: str) -> DataFrame:
    links = tables.read(spark, d, "orders").select(F.col("o_custkey").alias("u"), (F.col("o_custkey") - F.col("o_custkey") % 7).alias("v")).distinct()
    nodes = links.select(F.col("u").alias("id")).union(links.select("v")).distinct()
    return graph.components(nodes, links)


@query("e8_membership_hashes", with_tables("content_items", "item_events") + """ SELECT event_id AS event_key, sha256('[' || string_agg('{"content_hash": "' || content_hash || '", "content_item_id": ' || c.id || '}', ', ' ORDER BY c.id) || ']') AS membership_hash FROM item_events e JOIN content_items c ON c.id = e.content_item_id WHERE is_active GROUP BY 1""")
def e8(spark: SparkSession, d: str) -> DataFrame:
    return events.membership_hash(tables.item_events(spark, d).where("is_active").select(F.col("event_id").alias("event_key"), "content_item_id"), tables.content_items(spark, d))


# Ingestion ----------------------------------------------------------------------------------------------------------

FEED_SQL = """, e AS (SELECT user_id AS source_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS position, CAST(event_id AS VARCHAR) AS entry_id, event_type AS fingerprint, ts AS published, event_id FROM events),
f AS (SELECT * FROM e WHERE position <= 100), k AS (SELECT *, NOT (event_id % 3 = 0) AS is_changed FROM f),
c AS (SELECT *, sum(CAST(is_changed AS INT)) OVER w AS nth, sum(CAST(is_changed AS INT)) OVER (PARTITION BY source_id) AS total FROM k WINDOW w AS (PARTITION BY source_id ORDER BY position)),
s AS (SELECT *, is_changed AND nth <= 10 AS chosen FROM c), a AS (SELECT *, NOT chosen AND position <= 5 AS again FROM s), g AS (SELECT *, sum(CAST(again AS INT)) OVER (PARTITION BY source_id ORDER BY position) AS nth_again FROM a),
plan AS (SELECT source_id, position, entry_id, is_changed, published, fingerprint, chosen OR (again AND nth_again <= greatest(10 - total, 0)) AS selected, total > 10 AS has_backlog FROM g)"""


def _feed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    rows = tables.read(spark, d, "events").select(F.col("user_id").alias("source_id"), newest.alias("position"), F.col("event_id").cast("string").alias("entry_id"), F.col("event_type").alias("fingerprint"), F.col("ts").alias("published"), "event_id").where("position <= 100")
    state = rows.where("event_id % 3 = 0").select("source_id", "entry_id", "fingerprint")
    return rows.drop("event_id"), state


@query("i1_feed_plan", "WITH x AS (SELECT 1)" + FEED_SQL + " SELECT source_id, position, entry_id, is_changed, selected, has_backlog FROM plan")
def i1(spark: SparkSession, d: str) -> DataFrame:
    return ingest.plan_feeds(*_feed(spark, d)).select("source_id", "position", "entry_id", "is_changed", "selected", "has_backlog")


@query("i1_feed_state", "WITH x AS (SELECT 1)" + FEED_SQL + " SELECT source_id, entry_id, fingerprint FROM plan WHERE selected OR NOT is_changed")
def i1_state(spark: SparkSession, d: str) -> DataFrame:
    entries, state = _feed(spark, d)
    return ingest.next_state(ingest.plan_feeds(entries, state), state).drop("place")


@query("i5_watermarks", "WITH x AS (SELECT 1)" + FEED_SQL + " SELECT source_id, max(published) FILTER (WHERE selected) AS published_watermark, bool_or(has_backlog) AS has_backlog FROM plan GROUP BY source_id")
def i5(spark: SparkSession, d: str) -> DataFrame:
    entries, state = _feed(spark, d)
    held = entries.select("source_id").distinct().withColumn("published_watermark", F.lit(None).cast("timestamp_ntz"))
    return ingest.watermarks(ingest.plan_feeds(entries, state), held)


@query("i6_ingest_actions", """WITH b AS (SELECT doc_id % 20 AS source_id, CAST(doc_id % 400 AS VARCHAR) AS external_id, doc_id, text FROM documents), old AS (SELECT DISTINCT source_id, external_id, text FROM b WHERE doc_id < 300), new AS (SELECT source_id, external_id, text, min(doc_id) AS doc_id FROM b WHERE doc_id >= 200 GROUP BY ALL)
SELECT n.source_id, n.external_id, n.doc_id, CASE WHEN EXISTS (SELECT 1 FROM old o WHERE o.source_id = n.source_id AND o.external_id = n.external_id AND o.text = n.text) THEN 'skipped' WHEN EXISTS (SELECT 1 FROM old o WHERE o.source_id = n.source_id AND o.external_id = n.external_id) THEN 'updated' ELSE 'new' END AS action FROM new n""")
def i6(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.read(spark, d, "documents").select(
        (F.col("doc_id") % 20).alias("source_id"), (F.col("doc_id") % 400).cast("string").alias("external_id"), F.lit("t").alias("title"), F.lit(None).cast("timestamp").alias("published"),
        F.col("text").alias("body"), F.lit("").alias("excerpt"), F.array().cast("array<string>").alias("topics"), "doc_id", F.lit(None).cast("string").alias("url"),
    )
    nothing = spark.createDataFrame([], "source_id bigint, identity_key string, payload_sha256 string")
    old = ingest.ingest(rows.where("doc_id < 300"), nothing).select("source_id", "identity_key", "payload_sha256")
    first = rows.where("doc_id >= 200").groupBy("source_id", "external_id", "title", "published", "body", "excerpt", "topics", "url").agg(F.min("doc_id").alias("doc_id"))
    return ingest.ingest(first, old).select("source_id", "external_id", "doc_id", "action")


@query("i13_latest_versions", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) SELECT o_custkey AS source_id, o_orderkey AS id, o_totalprice AS price FROM r WHERE n = 1")
def i13(spark: SparkSession, d: str) -> DataFrame:
    raw = tables.read(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.lit("k").alias("identity_key"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return ingest.latest_versions(raw).drop("identity_key")


# Reader -------------------------------------------------------------------------------------------------------------


@query("q1_for_you_feed", _topic_sql() + """, f AS (SELECT m.content_item_id, m.topic_id, m.score, coalesce(c.published_at, c.discovered_at) AS effective_at, c.id IN (SELECT id FROM eligible) AS readable FROM matches m JOIN content_items c ON c.id = m.content_item_id WHERE decision = 'include'
 ORDER BY effective_at DESC, score DESC, content_item_id DESC, topic_id LIMIT 200)
SELECT content_item_id, max(score) AS score, arg_min(topic_id, (-score, topic_id)) AS topic_id, array_to_string(list_sort(list(topic_id)), '|') AS topics FROM f WHERE readable GROUP BY content_item_id, effective_at ORDER BY effective_at DESC, score DESC, content_item_id DESC LIMIT 50""")
def q1(spark: SparkSession, d: str) -> DataFrame:
    items = tables.content_items(spark, d)
    return reader.topic_feed(topics.match(items, TOPICS, all_topics=False), items).select("content_item_id", "score", "topic_id", F.array_join("topics", "|").alias("topics"))


@query("q2_explore", with_tables("content_items") + ", l AS (SELECT id, title, coalesce(published_at, discovered_at) AS effective_at FROM content_items ORDER BY effective_at DESC, id DESC LIMIT 300) SELECT * FROM l WHERE id IN (SELECT id FROM eligible) ORDER BY effective_at DESC, id DESC LIMIT 50")
def q2(spark: SparkSession, d: str) -> DataFrame:
    return reader.explore(tables.content_items(spark, d))


@query("q4_content_items", with_tables("content_items", "assignments") + " SELECT id, language, coalesce(published_at, discovered_at) AS effective_at FROM content_items c WHERE language = 'en' AND EXISTS (SELECT 1 FROM assignments a WHERE a.content_item_id = c.id AND a.input_content_hash = c.content_hash AND a.decision = 'include') ORDER BY effective_at DESC, id DESC LIMIT 100")
def q4(spark: SparkSession, d: str) -> DataFrame:
    items = tables.content_items(spark, d)
    return reader.list_items(items, language="en", domain=tables.assignments(spark, d, items).where("decision = 'include'"), limit=100).select("id", "language", "effective_at")


@query("q5_raw_item_page", "SELECT o_orderkey AS id, o_custkey AS source_id FROM orders WHERE o_custkey = 7 AND o_orderkey < 50000 ORDER BY o_orderkey DESC LIMIT 50")
def q5(spark: SparkSession, d: str) -> DataFrame:
    return reader.page(tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id")), 50000, source_id=7)


@query("q8_search_entities", "SELECT c_custkey AS id, c_name AS canonical_name FROM customer c WHERE c_name ILIKE '%#0000000_7%' OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority ILIKE '%#0000000_7%') ORDER BY id DESC LIMIT 50")
def q8(spark: SparkSession, d: str) -> DataFrame:
    names = tables.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("canonical_name"))
    other = tables.read(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderpriority").alias("alias"))
    return reader.search_entities(names, other, "#0000000_7")


@query("q11_event_sizes", with_tables("event_members") + " SELECT event_id, count(*) AS member_count, count(DISTINCT source_key) AS source_count FROM event_members WHERE is_active GROUP BY event_id HAVING count(*) >= 2")
def q11(spark: SparkSession, d: str) -> DataFrame:
    return reader.event_sizes(tables.event_members(spark, d), 2)


@query("q19_event_payloads", SCORES_SQL + """ SELECT e.event_id, count(DISTINCT c.source_id) AS source_count, CAST(coalesce(sum(CASE WHEN s.decision = 'selected' THEN 1 WHEN s.decision IS NOT NULL THEN 0 END), 0) AS BIGINT) AS selected_count, count(*) AS member_count, min(published_at) AS first_published_at, max(published_at) AS last_published_at, arg_min(c.id, (published_at, c.id)) AS representative_id
 FROM item_events e JOIN eligible c ON c.id = e.content_item_id LEFT JOIN scores s ON s.content_item_id = c.id WHERE e.is_active GROUP BY e.event_id HAVING count(*) >= 2""")
def q19(spark: SparkSession, d: str) -> DataFrame:
    return reader.event_payloads(tables.item_events(spark, d), tables.content_items(spark, d), scores(spark, d)).drop("title")


@query("q25_report_dates", with_tables("content_items") + " SELECT CAST(published_at + INTERVAL 8 HOUR AS DATE) AS report_date, count(*) AS item_count FROM eligible GROUP BY 1")
def q25(spark: SparkSession, d: str) -> DataFrame:
    return reader.report_dates(tables.content_items(spark, d))


@query("q28_daily_stories", with_tables("content_items", "item_events") + f""", a AS (SELECT * FROM item_events WHERE is_active), w AS (SELECT event_id, count(*) AS m, count(DISTINCT source_id) AS s FROM a JOIN content_items c ON c.id = a.content_item_id GROUP BY 1),
r AS (SELECT c.*, a.event_id, coalesce('event:' || a.event_id, 'content:' || c.id) AS g FROM eligible c LEFT JOIN a ON a.content_item_id = c.id WHERE CAST(published_at + INTERVAL 8 HOUR AS DATE) = DATE '{DAY}'),
t AS (SELECT g, max(event_id) AS event_id, arg_max(id, (length(body), -id)) AS content_item_id FROM r GROUP BY g)
SELECT t.event_id, t.content_item_id, coalesce(w.m, 1) AS member_count, coalesce(w.s, 1) AS source_count FROM t LEFT JOIN w ON w.event_id = t.event_id""")
def q28(spark: SparkSession, d: str) -> DataFrame:
    rows = reader.daily_stories(tables.content_items(spark, d), tables.item_events(spark, d), F.lit(DAY).cast("date"))
    return rows.select("event_id", "content_item_id", "member_count", "source_count")


@query("q28_week_totals", with_tables("content_items", "item_events") + f" SELECT count(DISTINCT coalesce('event:' || event_id, 'content:' || id)) AS story_count, count(DISTINCT source_id) AS source_count FROM eligible c LEFT JOIN (SELECT * FROM item_events WHERE is_active) a ON a.content_item_id = c.id WHERE CAST(published_at + INTERVAL 8 HOUR AS DATE) BETWEEN DATE '{DAY}' - 6 AND DATE '{DAY}'")
def q28_week(spark: SparkSession, d: str) -> DataFrame:
    return reader.week_totals(tables.content_items(spark, d), tables.item_events(spark, d), F.lit(DAY).cast("date"))


@query("q21_latest_artifacts", "SELECT l_orderkey AS subject_key, 'v' || max(l_partkey) AS output, max(l_partkey) AS id FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def q21(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("subject_key"), F.col("l_partkey").alias("id"), F.concat(F.lit("v"), "l_partkey").alias("output"), F.when(F.col("l_returnflag") != "R", "succeeded").otherwise("failed").alias("status"))
    return reader.latest_artifacts(rows, ["subject_key"])


@query("q15_topic_counts", "SELECT n_nationkey AS topic_id, (SELECT count(*) FROM supplier s WHERE s.s_nationkey = n_nationkey AND s_acctbal > 0) AS included_count, (SELECT count(*) FROM customer c WHERE c.c_nationkey = n_nationkey) AS candidate_count FROM nation")
def q15(spark: SparkSession, d: str) -> DataFrame:
    named = tables.read(spark, d, "nation").select(F.col("n_nationkey").alias("topic_id"))
    matches = tables.read(spark, d, "supplier").select(F.col("s_nationkey").alias("topic_id"), F.when(F.col("s_acctbal") > 0, "include").otherwise("exclude").alias("decision"))
    return reader.topic_counts(named, matches, tables.read(spark, d, "customer").select(F.col("c_nationkey").alias("topic_id")))


# Incremental flows --------------------------------------------------------------------------------------------------


@query("stream_run_statistics", with_tables("crawl_runs") + " SELECT date_trunc('day', started_at) AS window_start, status, count(*) AS runs FROM crawl_runs GROUP BY ALL")
def stream_runs(spark: SparkSession, d: str) -> DataFrame:
    """The batch twin of the streamed statistics: the same plan over the table at rest."""
    from newsloom.streaming.flows import run_statistics

    return run_statistics(tables.crawl_runs(spark, d))
