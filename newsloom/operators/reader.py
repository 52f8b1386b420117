"""Reader queries: feeds, search pages, events, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import summary
from newsloom.operators.content import effective_time, eligible, local_day, quality_tier
from newsloom.operators.topics import search

#: First matching section of a story, else the last.
SECTIONS = (("融资", r"融资|获投|funding|raises"), ("并购", r"收购|并购|acqui|merger"), ("人事", r"任命|离职|appoint|resign"), ("监管", r"监管|处罚|regulat|recall"), ("产品", r"发布|推出|launch|unveil"))
OTHER_SECTION = "要闻"


def topic_feed(matches: DataFrame, items: DataFrame, topic_id: int | None = None, limit: int = 50, enrichment: bool = False, decisions: DataFrame | None = None) -> DataFrame:
    """A reader's feed over included, current matches: one row per item with its best match and its topics.

    More rows than the limit are read before ineligible ones go (10, 8 or 4 times as many, with enrichment, curation or
    neither), so a feed may come up short, by design.
    """
    rows = matches.where("decision = 'include'").select("topic_id", "content_item_id", "input_content_hash", "score").join(items.withColumnRenamed("id", "content_item_id"), "content_item_id").where("input_content_hash = content_hash")
    rows = rows.where(F.col("topic_id") == topic_id) if topic_id is not None else rows
    rows = rows.withColumn("effective_at", effective_time()).withColumn("readable", quality_tier() != "needs_enrichment")
    by_score, by_time = F.desc("score"), F.desc("effective_at")
    order = [by_score, by_time] if topic_id is not None else [by_time, by_score]
    read = limit * (10 if enrichment else 8 if decisions is not None else 4)
    columns = ["content_item_id", "topic_id", "score", "effective_at", "readable", "title"]
    rows = rows.select(*columns).orderBy(*order, F.desc("content_item_id"), "topic_id").limit(read)
    rows = rows if enrichment else rows.where("readable")
    best = rows.groupBy("content_item_id").agg(
        F.max("score").alias("score"), F.min_by("topic_id", F.struct(-F.col("score"), "topic_id")).alias("topic_id"), F.array_sort(F.collect_set("topic_id")).alias("topics"),
        F.first("effective_at").alias("effective_at"), F.first("readable").alias("readable"), F.first("title").alias("title"),
    )
    if decisions is not None:
        dropped = decisions.where("decision = 'full_pool'").select("content_item_id", F.lit(True).alias("_out"))
        best = best.join(dropped, "content_item_id", "left").where(~(F.col("readable") & F.coalesce("_out", F.lit(False)))).drop("_out")
    final = [F.desc("readable"), by_score, F.asc("effective_at")] if enrichment else order
    return best.orderBy(*final, F.desc("content_item_id")).limit(limit)


def explore(items: DataFrame, limit: int = 50) -> DataFrame:
    """The latest six times `limit` items, of them the readable ones, up to the limit."""
    latest = items.withColumn("effective_at", effective_time()).orderBy(F.desc("effective_at"), F.desc("id")).limit(limit * 6)
    return eligible(latest).select("id", "title", "effective_at").orderBy(F.desc("effective_at"), F.desc("id")).limit(limit)


def explore_search(items: DataFrame, q: str, limit: int = 50) -> DataFrame:
    """A search among the latest items only (twelve times the limit, at least 80), so it may come up short, by design."""
    latest = items.orderBy(F.desc(effective_time()), F.desc("id")).limit(max(limit * 12, 80))
    return search(eligible(latest), q, limit)


def included(matches: DataFrame, items: DataFrame, now: Column | None = None, days: int = 7) -> DataFrame:
    """Readable items with an included, current match, of the last days if `now` is given: topic_id with the item's columns."""
    rows = matches.where("decision = 'include'").select("topic_id", F.col("content_item_id").alias("id"), F.col("input_content_hash").alias("content_hash"), "score")
    rows = rows.join(eligible(items), ["id", "content_hash"])
    return rows if now is None else rows.where(F.col("published_at") >= now - F.expr(f"INTERVAL {days} DAYS"))


def review_articles(matches: DataFrame, items: DataFrame, limit: int = 50) -> DataFrame:
    """The newest items whose match with a topic is for a person to decide."""
    rows = matches.where("decision = 'review'").select("topic_id", F.col("content_item_id").alias("id"), F.col("input_content_hash").alias("content_hash"))
    rows = rows.join(items, ["id", "content_hash"]).select("topic_id", "id", "title", effective_time().alias("effective_at"))
    return rows.orderBy(F.desc("effective_at"), F.desc("id"), "topic_id").limit(limit)


def topic_events(contents: DataFrame, members: DataFrame, items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Payloads of the events that any of the contents belongs to."""
    wanted = members.where("is_active").join(contents.select(F.col("id").alias("content_item_id")), "content_item_id", "left_semi").select("event_id").distinct()
    return event_payloads(members.join(wanted, "event_id", "left_semi"), items, decisions)


def topic_report_dates(contents: DataFrame) -> DataFrame:
    """topic_id, report_date, item_count: a topic's included items per local day."""
    return contents.groupBy("topic_id", local_day().alias("report_date")).agg(F.count("*").alias("item_count"))


def topic_daily_stories(contents: DataFrame, day: Column | None = None) -> DataFrame:
    """The stories of every topic's report, one an included item, of one local day or of all: newest first within a report.

    topic_id, report_date, issue_date (the day after), place, content_item_id, title, summary, source_id, published_at,
    body_chars, language. A day without stories has no report.
    """
    rows = contents.withColumn("report_date", local_day()).where(F.col("report_date").isNotNull() if day is None else F.col("report_date") == day)
    place = F.row_number().over(Window.partitionBy("topic_id", "report_date").orderBy(F.desc("published_at"), F.desc("id")))
    return rows.select(
        "topic_id", "report_date", F.date_add("report_date", 1).alias("issue_date"), place.alias("place"), F.col("id").alias("content_item_id"), "title",
        summary(F.coalesce(F.nullif(F.col("excerpt"), F.lit("")), F.col("body"))).alias("summary"), "source_id", "published_at", F.length(F.coalesce("body", F.lit(""))).alias("body_chars"), "language",
    )


def topic_editorials(stories: DataFrame, cards: DataFrame) -> DataFrame:
    """topic_id, report_date, place, story_key, title, summary, tags: what the reader's cards say of a report's stories.

    The summary is a card's paragraphs in one, else its excerpt, else empty; a story without a card has none of it.
    """
    own = cards.select("content_item_id", F.col("title").alias("card_title"), "paragraphs", F.col("excerpt").alias("card_excerpt"), "tags")
    said = F.coalesce(F.nullif(F.array_join("paragraphs", " "), F.lit("")), F.col("card_excerpt"), F.lit(""))
    return stories.select("topic_id", "report_date", "place", "content_item_id").join(own, "content_item_id", "left").select(
        "topic_id", "report_date", "place", F.concat(F.lit("content:"), F.col("content_item_id").cast("string")).alias("story_key"), F.col("card_title").alias("title"), said.alias("summary"), "tags"
    )


def list_items(items: DataFrame, results: DataFrame | None = None, *, source_id: int | None = None, language: str | None = None, relevant: bool | None = None, domain: DataFrame | None = None, mentions: DataFrame | None = None, before_id: int | None = None, limit: int = 50) -> DataFrame:
    """Content with its current processing result, filtered, newest first; domain and mentions are semi-joins."""
    rows = items
    for column, value in (("source_id", source_id), ("language", language)):
        rows = rows.where(F.col(column) == value) if value is not None else rows
    rows = rows.where(F.col("id") < before_id) if before_id is not None else rows
    if results is not None:
        now = results.select(F.col("content_item_id").alias("id"), F.col("input_content_hash").alias("content_hash"), "is_relevant", "reason")
        rows = rows.join(now, ["id", "content_hash"], "left")
        rows = rows.where(F.col("is_relevant") == relevant) if relevant is not None else rows
    if domain is not None:
        rows = rows.join(domain.select(F.col("content_item_id").alias("id"), F.col("input_content_hash").alias("content_hash")), ["id", "content_hash"], "left_semi")
    if mentions is not None:
        rows = rows.join(mentions.select(F.col("content_item_id").alias("id")), "id", "left_semi")
    keep = [c for c in ("is_relevant", "reason") if c in rows.columns]
    return rows.select("id", "source_id", "language", "title", effective_time().alias("effective_at"), quality_tier().alias("quality_tier"), *keep).orderBy(F.desc("effective_at"), F.desc("id")).limit(limit)


def page(rows: DataFrame, before_id: int | None = None, limit: int = 50, **equal: object) -> DataFrame:
    """A keyset page, newest first."""
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value) if value is not None else rows
    rows = rows.where(F.col("id") < before_id) if before_id is not None else rows
    return rows.orderBy(F.desc("id")).limit(limit)


def search_entities(entities: DataFrame, aliases: DataFrame, q: str, limit: int = 50) -> DataFrame:
    """Entities whose name or one of whose aliases contains q in any case."""
    like = f"%{q}%"
    named = aliases.where(F.ilike("alias", F.lit(like))).select(F.col("entity_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    return entities.join(named, "id", "left").where(F.ilike("canonical_name", F.lit(like)) | F.coalesce("_hit", F.lit(False))).drop("_hit").orderBy(F.desc("id")).limit(limit)


def event_sizes(members: DataFrame, least: int = 1) -> DataFrame:
    """event_id, member_count, source_count over active members."""
    counts = members.where("is_active").groupBy("event_id").agg(F.count("*").alias("member_count"), F.countDistinct("source_key").alias("source_count"))
    return counts.where(F.col("member_count") >= least)


def event_payloads(members: DataFrame, items: DataFrame, decisions: DataFrame, representative: DataFrame | None = None) -> DataFrame:
    """Events of two readable members or more with their heat: sources, selected members, last time, members, id.

    representative: event_id and representative_content_id; without one, or if it isn't readable, the earliest member
    stands for the event.
    """
    item = eligible(items).select(F.col("id").alias("content_item_id"), "source_id", "title", "published_at")
    rows = members.where("is_active").select("event_id", "content_item_id").join(item, "content_item_id")
    rows = rows.join(decisions.select("content_item_id", (F.col("decision") == "selected").cast("int").alias("picked")), "content_item_id", "left")
    if representative is not None:
        rows = rows.join(representative, "event_id", "left")
    head = F.when(F.col("content_item_id") == F.col("representative_content_id"), 0).otherwise(1) if representative is not None else F.lit(1)
    out = rows.groupBy("event_id").agg(
        F.countDistinct("source_id").alias("source_count"), F.coalesce(F.sum("picked"), F.lit(0)).alias("selected_count"),
        F.min("published_at").alias("first_published_at"), F.max("published_at").alias("last_published_at"), F.count("*").alias("member_count"),
        F.min_by("title", F.struct(head, "published_at", "content_item_id")).alias("title"), F.min_by("content_item_id", F.struct(head, "published_at", "content_item_id")).alias("representative_id"),
    )
    return out.where("member_count >= 2")


HEAT = ("source_count", "selected_count", "last_published_at", "member_count", "event_id")


def hottest(payloads: DataFrame, limit: int = 50) -> DataFrame:
    return payloads.orderBy(*[F.desc(c) for c in HEAT]).limit(limit)


def report_dates(items: DataFrame) -> DataFrame:
    """Readable items per local day, newest first."""
    return eligible(items).groupBy(local_day().alias("report_date")).agg(F.count("*").alias("item_count")).orderBy(F.desc("report_date"))


def section() -> Column:
    text = F.lower(F.concat_ws(" ", "title", "summary"))
    out = F.when(F.lit(False), "")
    for name, pattern in SECTIONS:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(OTHER_SECTION)


def daily_stories(items: DataFrame, members: DataFrame, day: Column, representative: DataFrame | None = None) -> DataFrame:
    """A day's stories: one per event, or per item without one, counted over the whole event.

    The event's representative tells the story if it is of the day, else the longest body.
    """
    active = members.where("is_active")
    whole = active.join(items.select(F.col("id").alias("content_item_id"), "source_id"), "content_item_id").groupBy("event_id").agg(F.count("*").alias("m"), F.countDistinct("source_id").alias("s"))
    rows = eligible(items).where(local_day() == day).join(active.select("event_id", F.col("content_item_id").alias("id")), "id", "left")
    if representative is not None:
        rows = rows.join(representative, "event_id", "left")
    head = F.coalesce((F.col("id") == F.col("representative_content_id")).cast("int"), F.lit(0)) if representative is not None else F.lit(0)
    group = F.when(F.col("event_id").isNotNull(), F.concat(F.lit("event:"), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("content:"), F.col("id").cast("string")))
    story = F.struct("id", "title", summary(F.coalesce(F.nullif(F.col("excerpt"), F.lit("")), F.col("body"))).alias("summary"), "source_id", "published_at", F.length("body").alias("body_chars"))
    told = rows.groupBy(group.alias("g")).agg(F.max("event_id").alias("event_id"), F.max_by(story, F.struct(head, F.length("body"), -F.col("id"))).alias("t"))
    out = told.join(whole, "event_id", "left").select("event_id", F.col("t.id").alias("content_item_id"), "t.title", "t.summary", "t.source_id", "t.published_at", "t.body_chars", F.coalesce("m", F.lit(1)).alias("member_count"), F.coalesce("s", F.lit(1)).alias("source_count"))
    return out.withColumn("section", section()).orderBy(F.desc("published_at"), F.desc("content_item_id"))


def week_totals(items: DataFrame, members: DataFrame, day: Column) -> DataFrame:
    """One row: distinct stories and sources of the seven days up to `day`."""
    rows = eligible(items).where(local_day().between(F.date_sub(day, 6), day)).join(members.where("is_active").select("event_id", F.col("content_item_id").alias("id")), "id", "left")
    group = F.coalesce(F.concat(F.lit("event:"), F.col("event_id").cast("string")), F.concat(F.lit("content:"), F.col("id").cast("string")))
    return rows.agg(F.countDistinct(group).alias("story_count"), F.countDistinct("source_id").alias("source_count"))


def latest_artifacts(results: DataFrame, keys: list[str]) -> DataFrame:
    """The last succeeded output of each subject."""
    return results.where("status = 'succeeded'").groupBy(*keys).agg(F.max_by("output", "id").alias("output"), F.max("id").alias("id"))


def missing_artifacts(items: DataFrame, results: DataFrame, validator: str) -> DataFrame:
    """Items without a valid artefact of the present validator for their present content."""
    valid = results.where((F.col("status") == "succeeded") & (F.col("validator_version") == validator)).select(F.col("subject_key").alias("id"), F.col("input_hash").alias("content_hash"))
    return items.join(valid, ["id", "content_hash"], "left_anti")


def compose_edition(stories: DataFrame) -> DataFrame:
    """Sections in the order of their first story, each with its stories' ids in order."""
    placed = stories.withColumn("place", F.row_number().over(Window.orderBy(F.desc("published_at"), F.desc("content_item_id"))))
    groups = placed.groupBy("section").agg(F.min("place").alias("first"), F.array_sort(F.collect_list(F.struct("place", "content_item_id"))).alias("s"))
    return groups.select("section", "first", F.transform("s", lambda x: x["content_item_id"]).alias("content_item_ids"), F.size("s").alias("n")).orderBy("first")


def _xml(x: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(sign), F.lit(entity))
    return x


def render_rss(items: DataFrame, title: str, link: str, limit: int = 50) -> DataFrame:
    """One row, the RSS 2.0 document of the newest items that have a URL."""
    rows = items.where("url IS NOT NULL AND url <> ''").orderBy(F.desc("published_at"), F.desc("id")).limit(limit)
    stamp = F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss '+0000'")
    one = F.concat(F.lit("<item><title>"), _xml(F.col("title")), F.lit("</title><link>"), _xml(F.col("url")), F.lit("</link><guid>"), _xml(F.col("url")), F.lit("</guid>"), F.coalesce(F.concat(F.lit("<pubDate>"), stamp, F.lit("</pubDate>")), F.lit("")), F.lit("</item>"))
    listed = F.array_sort(F.collect_list(F.struct((-F.unix_timestamp("published_at")).alias("t"), (-F.col("id")).alias("i"), one.alias("x"))))
    body = F.array_join(F.transform(listed, lambda x: x["x"]), "")
    head = f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{title}</title><link>{link}</link>'
    return rows.agg(F.concat(F.lit(head), body, F.lit("</channel></rss>")).alias("rss"))


def topic_counts(topics: DataFrame, matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Topics with their included matches and source candidates."""
    included = matches.where("decision = 'include'").groupBy("topic_id").agg(F.count("*").alias("included_count"))
    sources = candidates.groupBy("topic_id").agg(F.count("*").alias("candidate_count"))
    rows = topics.join(included, "topic_id", "left").join(sources, "topic_id", "left")
    return rows.fillna(0, ["included_count", "candidate_count"])


def credits_today(runs: DataFrame, now: Column, zone: str = "Asia/Shanghai") -> DataFrame:
    """topic_id, used: credits since local midnight."""
    midnight = F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(now, zone)), zone)
    return runs.where(F.col("started_at") >= midnight).groupBy("topic_id").agg(F.coalesce(F.sum("credits_used"), F.lit(0)).alias("used"))
