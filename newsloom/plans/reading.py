"""Queries of readers' pages, reports and editorial work, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import half_up
from newsloom.operators import cards, content, reader, topics
from newsloom.plans import tables
from newsloom.plans.queries import _HIT, _topic_sql, AS_OF, DAY, NORM, SCORES_SQL, TOPICS, at, scores
from newsloom.plans.registry import query
from newsloom.plans.tables import with_tables
from newsloom.session import materialize

EFFECTIVE = "coalesce(published_at, discovered_at)"
LOCAL_DAY = "CAST(published_at + INTERVAL 8 HOUR AS DATE)"


def _included(spark: SparkSession, d: str, recent: bool = True) -> tuple[DataFrame, DataFrame]:
    items = tables.content_items(spark, d)
    return reader.included(topics.match(items, TOPICS, all_topics=False), items, at(AS_OF) if recent else None), items


@query("t17_explore_search", with_tables("content_items") + f", l AS (SELECT * FROM content_items ORDER BY {EFFECTIVE} DESC, id DESC LIMIT 600), n AS (SELECT id, title, {EFFECTIVE} AS effective_at, " + NORM.format("concat_ws(chr(10), title, excerpt, substr(body, 1, 4000))") + " AS blob FROM l WHERE id IN (SELECT id FROM eligible)) SELECT id, title, effective_at FROM n WHERE " + _HIT.format(f="blob", v="pathetic|pathetics") + " ORDER BY effective_at DESC, id DESC LIMIT 50")
def t17(spark: SparkSession, d: str) -> DataFrame:
    return reader.explore_search(tables.content_items(spark, d), "pathetic")


@query("t25_review_articles", _topic_sql() + f" SELECT m.topic_id, c.id, c.title, {EFFECTIVE} AS effective_at FROM matches m JOIN content_items c ON c.id = m.content_item_id WHERE m.decision = 'review' ORDER BY effective_at DESC, c.id DESC, m.topic_id LIMIT 50")
def t25(spark: SparkSession, d: str) -> DataFrame:
    items = tables.content_items(spark, d)
    return reader.review_articles(topics.match(items, TOPICS, all_topics=False), items)


@query("t13_recent_contents", with_tables("content_items") + f" SELECT id, published_at FROM content_items WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND id NOT IN (SELECT id FROM (SELECT id, min(id) OVER w AS first_id, min(source_id) OVER w AS a, max(source_id) OVER w AS b FROM content_items WHERE length(trim(regexp_replace(body, '\\s+', ' ', 'g'))) >= 200 WINDOW w AS (PARTITION BY content_hash)) WHERE a <> b AND id <> first_id)")
def t13(spark: SparkSession, d: str) -> DataFrame:
    items = tables.content_items(spark, d)
    recent = items.where(F.col("published_at") >= at(AS_OF) - F.expr("INTERVAL 7 DAYS"))
    return recent.join(content.strict_duplicates(items).select("id"), "id", "left_anti").select("id", "published_at")


@query("t15_hits_by_field", with_tables("content_items") + ", n AS (SELECT id, " + ", ".join(NORM.format(c) + f" AS {c}" for c in ("title", "body")) + " FROM content_items) SELECT id, " + _HIT.format(f="title", v="loser|losers") + " AS in_title, " + _HIT.format(f="body", v="loser|losers") + " AS in_body FROM n")
def t15(spark: SparkSession, d: str) -> DataFrame:
    hit = lambda c: topics.holds(topics.normalized(F.col(c)), "loser")
    return tables.content_items(spark, d).select("id", hit("title").alias("in_title"), hit("body").alias("in_body"))


@query("q17_included_contents", _topic_sql() + f" SELECT m.topic_id, c.id, m.score, c.published_at FROM matches m JOIN eligible c ON c.id = m.content_item_id WHERE m.decision = 'include' AND published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")
def q17(spark: SparkSession, d: str) -> DataFrame:
    return _included(spark, d)[0].select("topic_id", "id", "score", "published_at")


@query("q18_topic_events", SCORES_SQL + ", " + _topic_sql().removeprefix(with_tables("content_items") + ", ") + f""", tables_members AS (SELECT * FROM item_events WHERE is_active), wanted AS (SELECT DISTINCT e.event_id FROM matches m JOIN eligible c ON c.id = m.content_item_id JOIN tables_members e ON e.content_item_id = c.id WHERE m.decision = 'include' AND c.published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY)
SELECT e.event_id, count(DISTINCT c.source_id) AS source_count, count(*) AS member_count, min(published_at) AS first_published_at, max(published_at) AS last_published_at FROM tables_members e JOIN wanted w ON w.event_id = e.event_id JOIN eligible c ON c.id = e.content_item_id GROUP BY e.event_id HAVING count(*) >= 2""")
def q18(spark: SparkSession, d: str) -> DataFrame:
    found, items = _included(spark, d)
    return reader.topic_events(found, tables.item_events(spark, d), items, scores(spark, d)).select("event_id", "source_count", "member_count", "first_published_at", "last_published_at")


@query("q26_topic_report_dates", _topic_sql() + f" SELECT m.topic_id, {LOCAL_DAY} AS report_date, count(*) AS item_count FROM matches m JOIN eligible c ON c.id = m.content_item_id WHERE m.decision = 'include' GROUP BY ALL")
def q26(spark: SparkSession, d: str) -> DataFrame:
    return reader.topic_report_dates(_included(spark, d, recent=False)[0])


@query("q29_topic_daily_stories", _topic_sql() + f""" SELECT m.topic_id, {LOCAL_DAY} AS report_date, CAST({LOCAL_DAY} + INTERVAL 1 DAY AS DATE) AS issue_date, row_number() OVER (PARTITION BY m.topic_id, {LOCAL_DAY} ORDER BY c.published_at DESC, c.id DESC) AS place,
 c.id AS content_item_id, c.source_id, c.published_at, length(c.body) AS body_chars, c.language FROM matches m JOIN eligible c ON c.id = m.content_item_id WHERE m.decision = 'include'""")
def q29(spark: SparkSession, d: str) -> DataFrame:
    return reader.topic_daily_stories(_included(spark, d, recent=False)[0]).drop("title", "summary")


@query("q33_topic_editorials")
def q33(spark: SparkSession, d: str) -> DataFrame:
    contents, items = _included(spark, d, recent=False)
    # Kept: texts are matched once for the stories and for the cards they need.
    stories = materialize(reader.topic_daily_stories(contents).select("topic_id", "report_date", "place", "content_item_id"))
    wanted = items.join(stories.select(F.col("content_item_id").alias("id")).distinct(), "id", "left_semi")
    tags = wanted.select(F.col("id").alias("content_item_id"), cards.editorial_tags(F.col("topics")).alias("tags"))
    return reader.topic_editorials(stories, cards.cards(wanted).join(tags, "content_item_id"))


@query("q23_topic_rss", with_tables("content_items") + r""", u AS (SELECT id, title, 'https://reader.example/' || id || '?a=1&b=2' AS url, published_at FROM eligible ORDER BY published_at DESC, id DESC LIMIT 50),
x AS (SELECT *, replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t, replace(url, '&', '&amp;') AS l FROM u)
SELECT '<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>Latest</title><link>https://reader.example/</link>' || string_agg('<item><title>' || t || '</title><link>' || l || '</link><guid>' || l || '</guid><pubDate>' || strftime(published_at, '%a, %d %b %Y %H:%M:%S +0000') || '</pubDate></item>', '' ORDER BY published_at DESC, id DESC) || '</channel></rss>' AS rss FROM x""")
def q23(spark: SparkSession, d: str) -> DataFrame:
    items = content.eligible(tables.content_items(spark, d)).withColumn("url", F.concat(F.lit("https://reader.example/"), F.col("id").cast("string"), F.lit("?a=1&b=2")))
    return reader.render_rss(items, "Latest", "https://reader.example/")


@query("q31_edition", with_tables("content_items") + f""", s AS (SELECT id, 'desk ' || (id % 4) AS section, row_number() OVER (ORDER BY published_at DESC, id DESC) AS place FROM eligible WHERE {LOCAL_DAY} = DATE '{DAY}')
SELECT section, min(place) AS first, string_agg(id, '|' ORDER BY place) AS content_item_ids, count(*) AS n FROM s GROUP BY section""")
def q31(spark: SparkSession, d: str) -> DataFrame:
    day = content.eligible(tables.content_items(spark, d)).where(content.local_day() == F.lit(DAY).cast("date"))
    stories = day.select(F.concat(F.lit("desk "), (F.col("id") % 4).cast("string")).alias("section"), "published_at", F.col("id").alias("content_item_id"))
    return reader.compose_edition(stories).withColumn("content_item_ids", F.array_join(F.col("content_item_ids").cast("array<string>"), "|"))


@query("q34_credits_today", "SELECT user_id AS topic_id, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS used FROM events WHERE ts >= TIMESTAMP '2024-01-24 16:00:00' GROUP BY 1")
def q34(spark: SparkSession, d: str) -> DataFrame:
    runs = tables.read(spark, d, "events").select(F.col("user_id").alias("topic_id"), F.col("ts").cast("timestamp").alias("started_at"), F.floor("value").alias("credits_used"))
    return reader.credits_today(runs, at("2024-01-25 10:00:00"))


@query("q35_missing_artifacts", with_tables("content_items") + " SELECT id FROM content_items WHERE NOT (id % 3 <> 0 AND id % 4 <> 0 AND id % 5 <> 0)")
def q35(spark: SparkSession, d: str) -> DataFrame:
    items = tables.content_items(spark, d)
    stale = F.when(F.col("id") % 3 == 0, "old").otherwise(F.col("content_hash"))
    results = items.select(
        F.col("id").alias("subject_key"), stale.alias("input_hash"), F.when(F.col("id") % 4 == 0, "failed").otherwise("succeeded").alias("status"),
        F.when(F.col("id") % 5 == 0, "v1").otherwise("v2").alias("validator_version"),
    )
    return reader.missing_artifacts(items, results, "v2").select("id")


@query("q30_sections", r"""WITH t AS (SELECT doc_id AS id, lower(substr(text, 1, 300)) AS t FROM documents)
SELECT id, CASE WHEN regexp_matches(t, '融资|获投|funding|raises') THEN '融资' WHEN regexp_matches(t, '收购|并购|acqui|merger') THEN '并购' WHEN regexp_matches(t, '任命|离职|appoint|resign') THEN '人事' WHEN regexp_matches(t, '监管|处罚|regulat|recall') THEN '监管' WHEN regexp_matches(t, '发布|推出|launch|unveil') THEN '产品' ELSE '要闻' END AS section FROM t""")
def q30(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("title"), F.substring("text", 1, 300).alias("summary"))
    return rows.select("id", reader.section().alias("section"))


@query("n34_reader_cards")
def n34(spark: SparkSession, d: str) -> DataFrame:
    return cards.cards(tables.content_items(spark, d))


@query("n35_editorial_tags", "SELECT doc_id AS id, array_to_string(list_filter([lang, CASE WHEN source <> lang THEN source END, 'x'], lambda t: t IS NOT NULL), '|') AS tags FROM documents")
def n35(spark: SparkSession, d: str) -> DataFrame:
    tags = cards.editorial_tags(F.array(F.concat(F.lit(" "), "lang"), "lang", "source", F.lit(""), F.lit("x")))
    return tables.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_join(tags, "|").alias("tags"))


@query("n48_evidence", with_tables("content_items") + r""", l AS (SELECT id, content_hash, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS n FROM content_items),
o AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS opens FROM l),
k AS (SELECT id, content_hash, line, opens, unnest(range((length(line) + 699) // 700)) AS k FROM o WHERE line <> ''),
s AS (SELECT id, content_hash, opens + k * 700 AS start_char, substr(line, k * 700 + 1, 700) AS t FROM k)
SELECT id AS content_item_id, start_char, start_char + length(t) AS end_char, 'content:' || id || '@' || substr(content_hash, 1, 12) || ':body:' || start_char || '-' || (start_char + length(t)) || ':' || substr(sha256(t), 1, 8) AS ref FROM s""")
def n48(spark: SparkSession, d: str) -> DataFrame:
    return cards.evidence(tables.content_items(spark, d))


@query("n49_number_support")
def n49(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.content_items(spark, d)
    return rows.select("id", cards.unsupported_numbers(F.col("title"), F.col("body")).alias("unsupported"))


@query("v2_component_scores", with_tables("content_items") + f""" SELECT id, floor((CASE WHEN published_at IS NULL THEN 0.0::DOUBLE WHEN h <= 24 THEN 1.0 WHEN h >= 168 THEN 0.0 ELSE (168 - h) / 144.0::DOUBLE END) * 10000 + 0.5) / 10000 AS recency FROM (SELECT *, greatest(0.0::DOUBLE, epoch(TIMESTAMP '{AS_OF}') - epoch(published_at)) / 3600.0::DOUBLE AS h FROM content_items)""")
def v2(spark: SparkSession, d: str) -> DataFrame:
    from newsloom.operators import scoring

    return tables.content_items(spark, d).select("id", half_up(scoring.recency(at(AS_OF), scoring.Config()), 4).alias("recency"))
