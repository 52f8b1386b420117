"""Feeds, sitemaps, JSON listings and provider pages saved as text."""

from __future__ import annotations

import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.sources.pages import ARTICLES, MOST_ARTICLES, parse_date, url_join

ENTRIES = "array<struct<entry_id:string,title:string,link:string,published:string,updated:string,summary:string,content:string>>"
FULL_CHARS, SUBTYPE_ENTRIES = 500, 10


def entries_of(feed: str | None) -> list[tuple] | None:
    """RSS or Atom entries in order; None where nothing can be read."""
    try:
        root = ElementTree.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", feed or "").strip())
    except ElementTree.ParseError:
        return None
    plain = lambda tag: tag.rpartition("}")[2].lower()
    out = []
    for node in root.iter():
        if plain(node.tag) not in ("item", "entry"):
            continue
        found: dict[str, str] = {}
        for child in node:
            name, value = plain(child.tag), (child.text or "").strip()
            if name == "link" and child.get("href") and child.get("rel", "alternate") == "alternate":
                value = child.get("href", "").strip()
            found.setdefault(name, value)
        one = lambda *names: next((found[n] for n in names if found.get(n)), None)  # noqa: E731, B023
        out.append((one("guid", "id"), one("title"), one("link"), one("pubdate", "published", "date"), one("updated"), one("description", "summary"), one("encoded", "content")))
    return out


def parse_feed(feed: Column) -> Column:
    @F.pandas_udf(ENTRIES)
    def parsed(feeds: pd.Series) -> pd.Series:
        return feeds.map(entries_of)

    return parsed(feed)


def feed_entries(feeds: DataFrame) -> DataFrame:
    """(source_id, feed) -> one row per entry with position, identity, fingerprint and date; unreadable feeds give none."""
    rows = feeds.select("source_id", F.posexplode(parse_feed(F.col("feed"))).alias("position", "e")).select("source_id", "position", "e.*")
    link = F.when(F.col("link").isNotNull(), text.normalize_url("link"))
    basis = F.concat_ws("|", F.coalesce("title", F.lit("")), F.coalesce("published", F.lit("")), F.coalesce("summary", F.lit("")))
    identity = F.coalesce(F.col("entry_id"), link, F.concat(F.lit("fallback:"), F.sha2(basis, 256)))
    fields = F.to_json(F.struct("content", "entry_id", "link", "published", "summary", "title", "updated"))
    return rows.withColumns({"fingerprint": F.sha2(fields, 256), "url": link, "entry_id": identity, "published": parse_date(F.col("published")), "updated": parse_date(F.col("updated"))})


def _capped(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Distinct URLs of each key in order, up to the limit."""
    first = rows.where("url IS NOT NULL AND url <> ''").groupBy(*keys, "url").agg(F.min("position").alias("position"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("position"))
    return first.withColumn("position", place).where(F.col("position") <= max(1, min(limit, MOST_ARTICLES)))


def feed_urls(feeds: DataFrame, limit: int = ARTICLES) -> DataFrame:
    return _capped(feed_entries(feeds).select("source_id", "position", "url"), ["source_id"], limit)


def feed_subtype(feed: Column) -> Column:
    """full, summary or link_only, by the longest text among the first ten entries; null without entries."""
    first = F.slice(parse_feed(feed), 1, SUBTYPE_ENTRIES)
    longest = lambda *names: F.array_max(F.transform(first, lambda e: F.greatest(*[F.length(F.coalesce(e[n], F.lit(""))) for n in names])))
    return F.when(longest("content", "content") >= FULL_CHARS, "full").when(longest("content", "summary") > 0, "summary").when(F.size(first) > 0, "link_only")


def feed_articles(feeds: DataFrame) -> DataFrame:
    """Entries as articles: full content where there is any, else the summary, with its completeness and warning."""
    rows = feed_entries(feeds)
    strip = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " "), r"(?U)\s+", " "))
    full, short = strip("content"), strip("summary")
    kind = F.when(full != "", "full").when(short != "", "partial").otherwise("metadata_only")
    warn = F.when(kind == "partial", F.array(F.lit("summary_only"))).otherwise(F.array().cast("array<string>"))
    return rows.select("source_id", F.col("entry_id").alias("external_id"), "url", "title", "published", F.when(full != "", full).otherwise(short).alias("body"), short.alias("excerpt"), kind.alias("content_completeness"), warn.alias("warnings"), F.array().cast("array<string>").alias("topics"))


def sitemap_urls(maps: DataFrame, pattern: str | None = None, limit: int = ARTICLES) -> DataFrame:
    """(source_id, xml) -> the locations of url elements, normalized, distinct and capped."""
    found = F.regexp_extract_all("xml", F.lit(r"(?s)<url>(?:(?!</url>).)*?<loc>\s*(.*?)\s*</loc>"), 1)
    rows = maps.select("source_id", F.posexplode(found).alias("position", "loc")).withColumn("url", text.normalize_url(F.replace("loc", F.lit("&amp;"), F.lit("&"))))
    rows = rows.where(F.col("url").rlike(pattern)) if pattern else rows
    return _capped(rows.select("source_id", "position", "url"), ["source_id"], limit)


def json_urls(listings: DataFrame, items_path: str, template: str, limit: int = ARTICLES) -> DataFrame:
    """(source_id, start_url, payload) -> URLs made of the listed items by a template; items without a named key are left out."""
    path = "$" + "".join(f".{p}" for p in items_path.split(".") if p)
    items = F.from_json(F.get_json_object("payload", path), "array<map<string,string>>")
    rows = listings.select("source_id", "start_url", F.posexplode(items).alias("position", "m"))
    url = F.lit(template)
    for key in sorted(set(re.findall(r"\{(\w+)\}", template))):
        url = F.replace(url, F.lit("{" + key + "}"), F.try_element_at(F.col("m"), F.lit(key)))
    return _capped(rows.withColumn("url", text.normalize_url(url_join(F.col("start_url"), url))).select("source_id", "position", "url"), ["source_id"], limit)


def json_articles(pages: DataFrame, paths: dict[str, str]) -> DataFrame:
    """(page_id, payload) -> article fields by dotted paths."""
    return pages.select("page_id", *[F.get_json_object("payload", f"$.{p}").alias(k) for k, p in paths.items()])


def provider_page(pages: DataFrame) -> DataFrame:
    """(page_id, payload) -> page_id, total and the listed items of a provider's answer; other codes give nothing."""
    listed = F.coalesce(*[F.get_json_object("payload", p) for p in ("$.data.list", "$.data.articles", "$.data.records", "$.data")])
    items = F.from_json(listed, "array<struct<id:string,title:string,url:string,publishTime:string,type:string,isTop:boolean,isAd:boolean>>")
    rows = pages.where(F.get_json_object("payload", "$.code").isin("200", "2000"))
    return rows.select("page_id", F.get_json_object("payload", "$.data.total").cast("int").alias("total"), F.posexplode_outer(items).alias("position", "item")).select("page_id", "total", "position", "item.*")


#: Members of a provider's item that say outright that it is pinned or advertising, and the labels that do.
YES = ("true", "yes", "y", "1")
PINNED_FLAGS, AD_FLAGS = ("isTop", "isPinned", "pinned", "topFlag"), ("isAd", "isAdvertisement", "advertisement", "sponsored")
TYPE_MEMBERS, AD_TYPES = ("itemType", "contentType"), ("ad", "advertisement", "promotion", "sponsored")
LABEL_MEMBERS = ("tags", "tagList", "labels", "categories", "contentKeywords")
LABEL_NAMES = ("name", "label", "title", "value", "tagName")
PINNED_LABELS = ("置顶", "pinned", "top")
AD_LABELS = ("广告", "推广", "商业推广", "赞助", "ad", "advertisement", "promotion", "sponsored")


def item_labels(item: Column) -> Column:
    """The labels of a provider's item (JSON text) in lower case: texts, lists of texts or named objects, split at separators."""
    found = []
    for member in LABEL_MEMBERS:
        value = F.get_json_object(item, f"$.{member}")
        each = F.when(F.startswith(value, F.lit("[")), F.from_json(value, "array<string>")).otherwise(F.array(value))
        name = lambda x: F.coalesce(*[F.nullif(F.get_json_object(x, f"$.{k}"), F.lit("")) for k in LABEL_NAMES])
        found.append(F.coalesce(F.transform(each, lambda x: F.when(F.startswith(x, F.lit("{")), name(x)).otherwise(x)), F.array().cast("array<string>")))
    parts = F.flatten(F.transform(F.array_compact(F.concat(*found)), lambda x: F.split(x, "[,，;；|]+")))
    return F.filter(F.transform(parts, lambda x: F.lower(F.trim(x))), lambda x: x != "")


def exclusion_reason(item: Column, pinned: bool = True, advertising: bool = True) -> Column:
    """Why a provider's item (JSON text) is left out, or null: flags come before labels, pinned before advertising.

    Only what the item says outright counts. A null item, or text that isn't JSON, has no reason.
    """
    said = lambda member: F.lower(F.trim(F.get_json_object(item, f"$.{member}")))
    flagged = lambda members: F.coalesce(F.array_contains(F.array(*[F.coalesce(said(m).isin(*YES), F.lit(False)) for m in members]), True), F.lit(False))
    kind = F.coalesce(*[F.nullif(said(m), F.lit("")) for m in TYPE_MEMBERS])
    labelled = lambda names: F.coalesce(F.arrays_overlap(item_labels(item), F.array(*map(F.lit, names))), F.lit(False))
    rules = [
        (pinned, flagged(PINNED_FLAGS), "explicit_pinned_flag"), (advertising, flagged(AD_FLAGS), "explicit_advertising_flag"), (advertising, F.coalesce(kind.isin(*AD_TYPES), F.lit(False)), "explicit_advertising_type"),
        (pinned, labelled(PINNED_LABELS), "explicit_pinned_label"), (advertising, labelled(AD_LABELS), "explicit_advertising_label"),
    ]
    out = F.when(F.lit(False), "")
    for active, holds, reason in rules:
        out = out.when(holds, reason) if active else out
    return out


def pick_day(items: DataFrame, day: Column, zone: str = "Asia/Shanghai") -> DataFrame:
    """Provider items of a local day with why any is left out: pinned before advertising."""
    local = F.to_date(F.try_to_timestamp("publishTime", F.lit("yyyy-MM-dd HH:mm:ss")))
    reason = F.when(F.coalesce("isTop", F.lit(False)), "pinned").when(F.coalesce("isAd", F.lit(False)) | F.coalesce(F.col("type") == "ad", F.lit(False)), "advertising")
    return items.where(local == day).withColumn("exclusion_reason", reason).withColumn("published_at", F.to_utc_timestamp(F.try_to_timestamp("publishTime", F.lit("yyyy-MM-dd HH:mm:ss")), zone))


def needs_next_page(items: DataFrame, day: Column, offset: int) -> DataFrame:
    """page_id, needs_next: until a page reaches an earlier day or the total is read."""
    oldest = F.min(F.to_date(F.try_to_timestamp("publishTime", F.lit("yyyy-MM-dd HH:mm:ss"))))
    seen = items.groupBy("page_id").agg(oldest.alias("oldest"), F.max("total").alias("total"), F.count("id").alias("n"))
    more = F.coalesce(F.col("total") > F.lit(offset) + F.col("n"), F.col("n") > 0)
    return seen.select("page_id", (more & ~F.coalesce(F.col("oldest") < day, F.lit(False))).alias("needs_next"))


def resolve_engine(sources: DataFrame) -> DataFrame:
    """Adds the execution engine of channel and method; an explicit one must agree."""
    rule = F.when(F.col("channel_type") == "rss", "feed_direct").when((F.col("channel_type") == "api") & F.col("provider").isNotNull(), "provider_api").when(F.col("method") == "sitemap", "sitemap_http").when((F.col("method") == "json") | (F.col("channel_type") == "api"), "json_api").when(F.col("channel_type") == "web", "static_http")
    return sources.withColumn("engine", rule).withColumn("engine_error", F.when(rule.isNull(), "no_engine").when(F.col("engine_key").isNotNull() & (F.col("engine_key") != rule), "engine_mismatch"))
