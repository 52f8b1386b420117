"""Detail views for whole tables of asked keys: cards, entities, events, subscriptions, scores, a crawl run's contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.content import eligible
from newsloom.operators.reader import hottest

#: Crawl runs whose contents go on to topics, and how many events a reader sees.
DISTRIBUTABLE = ("succeeded", "partial", "unchanged")
VISIBLE = 200


def content_cards(asked: DataFrame, items: DataFrame, general: DataFrame, by_topic: DataFrame) -> DataFrame:
    """Readable items asked for by content_item_id and topic_id (or null), with the topic's copy, else the general one.

    general: content_item_id, input_content_hash, output; by_topic: topic_id as well. Copy made for other content is ignored.
    """
    rows = asked.join(eligible(items).select(F.col("id").alias("content_item_id"), "title", "content_hash", "source_id"), "content_item_id")
    g = general.select("content_item_id", F.col("input_content_hash").alias("content_hash"), F.col("output").alias("_general"))
    t = by_topic.select("content_item_id", "topic_id", F.col("input_content_hash").alias("content_hash"), F.col("output").alias("_topic"))
    rows = rows.join(g, ["content_item_id", "content_hash"], "left").join(t, ["content_item_id", "topic_id", "content_hash"], "left")
    return rows.select("content_item_id", "topic_id", "source_id", F.coalesce("_topic", "_general", "title").alias("headline"), F.when(F.col("_topic").isNotNull(), "topic").when(F.col("_general").isNotNull(), "general").otherwise("none").alias("copy"))


def current_mentions(mentions: DataFrame, results: DataFrame, items: DataFrame) -> DataFrame:
    """Mentions whose extraction succeeded on the item's present content, with its title."""
    done = results.where("status = 'succeeded'").select(F.col("id").alias("processing_result_id"), F.col("input_content_hash").alias("content_hash"))
    item = items.select(F.col("id").alias("content_item_id"), "content_hash", F.col("title").alias("content_title"))
    return mentions.join(done, "processing_result_id").join(item, ["content_item_id", "content_hash"]).drop("content_hash")


def entity_details(entities: DataFrame, aliases: DataFrame, mentions: DataFrame) -> DataFrame:
    """Active entities with their aliases in order and the count of current mentions, which stay a table of their own."""
    counts = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("mention_count"))
    named = aliases.groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("alias_id"), "alias"))).alias("a"))
    rows = entities.where("status = 'active'").join(named, "id", "left").join(counts, "id", "left")
    rows = rows.withColumn("aliases", F.coalesce(F.transform("a", lambda x: x["alias"]), F.array().cast("array<string>")))
    return rows.withColumn("mention_count", F.coalesce("mention_count", F.lit(0))).drop("a")


def event_details(events: DataFrame, members: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """Active members of active events with title and source, in the order of publication."""
    rows = members.where("is_active").join(events.where("status = 'active'").select("event_id"), "event_id", "left_semi")
    rows = rows.join(items.select(F.col("id").alias("content_item_id"), "title", "source_id", "published_at"), "content_item_id")
    rows = rows.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id")
    return rows.orderBy("event_id", "published_at", "content_item_id")


def visible_event_details(asked: DataFrame, payloads: DataFrame, members: DataFrame, items: DataFrame, limit: int = VISIBLE) -> DataFrame:
    """Readable members of those asked events (event_id) that are among the hottest, which is all that readers see."""
    seen = hottest(payloads, limit).join(asked.select("event_id").distinct(), "event_id", "left_semi").select("event_id", "member_count")
    rows = members.where("is_active").select("event_id", "content_item_id").join(F.broadcast(seen), "event_id")
    return rows.join(eligible(items).select(F.col("id").alias("content_item_id"), "title", "published_at"), "content_item_id")


def subscriptions(rows: DataFrame, domains: DataFrame) -> DataFrame:
    """Users' subscriptions with their domains, by user, domain name and way of delivery."""
    named = domains.select(F.col("id").alias("domain_id"), F.col("key").alias("domain_key"), F.col("name").alias("domain_name"))
    out = rows.join(named, "domain_id").select("user_id", "id", "domain_key", "domain_name", "delivery_type", "status")
    return out.orderBy("user_id", "domain_name", "delivery_type", "id")


def value_scores(runs: DataFrame, scores: DataFrame, items: DataFrame, domain: object, decision: str | None = None, run_id: int | None = None, limit: int = 50) -> DataFrame:
    """The best scores of a domain's latest succeeded run (or of the given one) that hold for the present content."""
    done = runs.where((F.col("status") == "succeeded") & (F.col("domain_id") == domain))
    done = done.where(F.col("id") == run_id) if run_id is not None else done.orderBy(F.desc("as_of"), F.desc("id")).limit(1)
    rows = scores.join(F.broadcast(done.select(F.col("id").alias("run_id"), "as_of")), "run_id")
    rows = rows.where(F.col("decision") == decision) if decision is not None else rows
    item = items.select(F.col("id").alias("content_item_id"), F.col("content_hash").alias("input_content_hash"), "title", "source_id", "published_at")
    return rows.join(item, ["content_item_id", "input_content_hash"]).orderBy(F.desc("total_score"), "id").limit(limit)


def run_contents(raw_items: DataFrame, items: DataFrame) -> DataFrame:
    """Contents that crawl runs brought, without duplicates: run_id with the item's columns."""
    raw = raw_items.select(F.col("id").alias("raw_item_id"), F.col("crawl_run_id").alias("run_id"))
    return items.where("duplicate_of_id IS NULL").join(raw, "raw_item_id")


def distribution(runs: DataFrame, contents: DataFrame, matches: DataFrame) -> DataFrame:
    """What each run gives to topics: outcome, readable contents, topics that include any of them, and such matches.

    Failed runs are skipped; runs without readable contents are empty. contents is of run_contents.
    """
    state = F.when(F.col("status").isin(*DISTRIBUTABLE), "distributed").otherwise("skipped")
    readable = eligible(contents).select("run_id", F.col("id").alias("content_item_id"), F.col("content_hash").alias("input_content_hash"))
    found = matches.where("decision = 'include'").select("content_item_id", "input_content_hash", "topic_id")
    counts = readable.groupBy("run_id").agg(F.count("*").alias("contents"))
    hits = readable.join(found, ["content_item_id", "input_content_hash"]).groupBy("run_id").agg(F.countDistinct("topic_id").alias("topics"), F.count("*").alias("included"))
    rows = runs.select(F.col("id").alias("run_id"), state.alias("state")).join(counts, "run_id", "left").join(hits, "run_id", "left")
    open_ = F.col("state") == "distributed"
    outcome = F.when(open_ & F.col("contents").isNull(), "empty").otherwise(F.col("state"))
    return rows.select("run_id", outcome.alias("outcome"), *[F.when(open_, F.coalesce(c, F.lit(0))).otherwise(0).alias(c) for c in ("contents", "topics", "included")])
