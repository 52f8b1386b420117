"""Versioned ingestion and incremental feed plans as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators.content import FULL_CHARS, in_window

#: Limits of a feed plan, and of a listing by trigger.
MAX_ARTICLES, OVERLAP, WINDOW, MANUAL_FLOOR = 10, 5, 100, 10
RETRY_HOURS = 24
CHANNEL_ORDER = ("rss", "api", "third_party", "web")


def article_limit(configured: int | None, manual: bool = False) -> int:
    limit = max(1, min(int(configured or MAX_ARTICLES), 50))
    return max(limit, MANUAL_FLOOR) if manual else limit


def window_days(has_content: Column, manual: Column) -> Column:
    """Seven days at first and by hand, one day later."""
    return F.when(manual | ~has_content, 7).otherwise(1)


def plan_feeds(entries: DataFrame, state: DataFrame, max_articles: int = MAX_ARTICLES, overlap: int = OVERLAP) -> DataFrame:
    """Feed entries against the state of their source: each entry with is_changed, selected and the source's has_backlog.

    entries: source_id, position, entry_id, fingerprint, published; state: source_id, entry_id, fingerprint. Changed
    entries come first, up to max_articles; what room is left is filled with the first `overlap` entries, to check them
    again. All ranks are within a source.
    """
    overlap = min(overlap, max_articles)
    known = state.select("source_id", "entry_id", F.col("fingerprint").alias("known"))
    rows = entries.join(known, ["source_id", "entry_id"], "left").withColumn("is_changed", ~F.col("fingerprint").eqNullSafe(F.col("known")))
    by = Window.partitionBy("source_id").orderBy("position")
    rows = rows.withColumn("nth_changed", F.sum(F.col("is_changed").cast("int")).over(by)).withColumn("n_changed", F.sum(F.col("is_changed").cast("int")).over(Window.partitionBy("source_id")))
    rows = rows.withColumn("chosen", F.col("is_changed") & (F.col("nth_changed") <= max_articles)).withColumn("again", ~F.col("chosen") & (F.row_number().over(by) <= overlap))
    room = F.greatest(F.lit(max_articles) - F.col("n_changed"), F.lit(0))
    rows = rows.withColumn("nth_again", F.sum(F.col("again").cast("int")).over(by))
    rows = rows.withColumn("selected", F.col("chosen") | (F.col("again") & (F.col("nth_again") <= room))).withColumn("has_backlog", F.col("n_changed") > max_articles)
    return rows.drop("known", "nth_changed", "n_changed", "chosen", "again", "nth_again")


def next_state(planned: DataFrame, state: DataFrame, size: int = WINDOW) -> DataFrame:
    """The state after a plan: observed entries that are known or selected, in feed order, then older ones, cut to `size`."""
    now = planned.select("source_id", "entry_id", "position", F.when(F.col("selected"), F.col("fingerprint")).alias("new"))
    met = now.join(state.select("source_id", "entry_id", F.col("fingerprint").alias("old")), ["source_id", "entry_id"], "full")
    met = met.withColumn("fingerprint", F.coalesce("new", "old")).where("fingerprint IS NOT NULL")
    order = Window.partitionBy("source_id").orderBy(F.col("position").asc_nulls_last(), "entry_id")
    return met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size).select("source_id", "entry_id", "fingerprint", "place")


def watermarks(planned: DataFrame, state: DataFrame) -> DataFrame:
    """source_id, published_watermark, has_backlog: the latest date of what was selected, never earlier than before."""
    new = planned.groupBy("source_id").agg(F.max(F.when(F.col("selected"), F.col("published"))).alias("p"), F.max("has_backlog").alias("has_backlog"))
    met = new.join(state.select("source_id", F.col("published_watermark").alias("was")), "source_id", "full")
    return met.select("source_id", F.greatest("p", "was").alias("published_watermark"), F.coalesce("has_backlog", F.lit(False)).alias("has_backlog"))


def ingest(articles: DataFrame, raw: DataFrame) -> DataFrame:
    """Articles against the raw versions of their identity: each with identity_key, payload_sha256 and action.

    articles: source_id, external_id, url, title, published, body, excerpt, topics. An identity is the source's external
    id, else its normalized URL, else title and date. A payload seen before is skipped, another one of a known identity
    updates, an unknown identity is new. Of repeated payloads in one batch the first by url counts.
    """
    url = text.normalize_url("url")
    rows = articles.withColumn("canonical_url", F.when(F.col("url").isNotNull() & (F.col("url") != ""), url))
    rows = rows.withColumn("identity_key", text.identity_key("external_id", "canonical_url", "title", F.col("published").cast("string")))
    payload = F.to_json(F.struct("body", "canonical_url", "excerpt", "external_id", F.col("published").cast("string").alias("published"), "title", "topics"))
    rows = rows.withColumn("payload_sha256", F.sha2(payload, 256))
    keys = ["source_id", "identity_key"]
    first = Window.partitionBy(*keys, "payload_sha256").orderBy("url")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    seen = raw.select(*keys, "payload_sha256").distinct().withColumn("_seen", F.lit(True))
    known = raw.select(*keys).distinct().withColumn("_known", F.lit(True))
    met = rows.join(seen, [*keys, "payload_sha256"], "left").join(known, keys, "left")
    return met.withColumn("action", F.when(F.col("_seen"), "skipped").when(F.col("_known"), "updated").otherwise("new")).drop("_seen", "_known")


def append_versions(raw: DataFrame, ingested: DataFrame) -> DataFrame:
    """The raw log with the new versions at its end; nothing in it changes."""
    return raw.unionByName(ingested.where("action <> 'skipped'").select(raw.columns), allowMissingColumns=True)


def latest_versions(raw: DataFrame, order: str = "id") -> DataFrame:
    """The content projection: the last version of each identity."""
    newest = raw.groupBy("source_id", "identity_key").agg(F.max_by(F.struct(*[c for c in raw.columns if c not in ("source_id", "identity_key")]), order).alias("r"))
    return newest.select("source_id", "identity_key", "r.*")


def merge_enrichment(feed: DataFrame, web: DataFrame) -> DataFrame:
    """Feed articles with what their pages add: a longer body wins, missing fields are filled, topics and warnings united."""
    other = web.select("canonical_url", *[F.col(c).alias(f"w_{c}") for c in ("body", "author", "published_at", "excerpt", "topics", "warnings")])
    met = feed.join(other, "canonical_url", "left")
    longer = F.length(F.coalesce("w_body", F.lit(""))) > F.length(F.coalesce("body", F.lit("")))
    none = F.array().cast("array<string>")
    fill = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"w_{c}")) for c in ("author", "excerpt")}
    union = {c: F.array_union(F.coalesce(c, none), F.coalesce(f"w_{c}", none)) for c in ("topics", "warnings")}
    met = met.withColumns({"body": F.when(longer, F.col("w_body")).otherwise(F.col("body")), "published_at": F.coalesce("published_at", "w_published_at"), **fill, **union})
    return met.select(feed.columns)


def keep_verified(new: DataFrame, old: DataFrame) -> DataFrame:
    """A verified body is never replaced by a shorter or unverified one."""
    held = old.where("body_complete").select("identity_key", F.col("body").alias("o_body"))
    met = new.join(held, "identity_key", "left")
    stays = F.col("o_body").isNotNull() & (~F.coalesce(F.col("body_complete"), F.lit(False)) | (F.length("body") < F.length("o_body")))
    return met.withColumns({"body": F.when(stays, F.col("o_body")).otherwise(F.col("body")), "body_complete": F.col("body_complete") | stays}).select(new.columns)


def contract(articles: DataFrame, sponsored: tuple[str, ...] = ("sponsored", "partner content"), roundup: tuple[str, ...] = ("roundup", "weekly review")) -> DataFrame:
    """Extracted articles as normalized ones: language, word count, topics, hash, flags and quality."""
    said = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("title"), F.lower(w)))
    whole = F.coalesce(F.col("content_completeness"), F.lit("unknown"))
    body, topics = text.collapse("body"), text.normalize_topics("topics")
    note = F.when(whole == "unknown", "completeness_unknown").when(whole == "partial", "partial_content").when(whole == "metadata_only", "metadata_only")
    warnings = F.array_union(F.coalesce("warnings", F.array().cast("array<string>")), F.array_compact(F.array(note)))
    return articles.withColumns({
        "language": text.detect_language(F.concat_ws("\n", "title", "body"), "default_language"),
        "word_count": text.count_words(body), "topics": topics,
        "is_sponsored": said(sponsored), "is_roundup": said(roundup),
        "body_complete": F.when(whole == "full", True).when(whole.isin("partial", "metadata_only"), False),
        "metadata_only": whole == "metadata_only", "warnings": warnings,
        "content_hash": text.content_hash("title", "body", "excerpt", "topics"),
    })


def gate(articles: DataFrame, end: Column, days: int) -> DataFrame:
    """Articles with whether their local day lies in the publication window."""
    return articles.withColumn("admitted", in_window(end, days))


def retry_due(now: Column) -> Column:
    """May incomplete content be fetched again?"""
    thin = F.col("published_at").isNull() | (F.length(F.coalesce("body", F.lit(""))) < FULL_CHARS)
    return thin & (F.col("last_attempt_at").isNull() | (F.col("last_attempt_at") <= now - F.expr(f"INTERVAL {RETRY_HOURS} HOURS")))


def source_for_url(urls: DataFrame, sources: DataFrame) -> DataFrame:
    """url, source_id: the enabled source of the same host, by channel and then id."""
    rank = F.coalesce(*[F.when(F.col("channel_type") == c, k) for k, c in enumerate(CHANNEL_ORDER)], F.lit(len(CHANNEL_ORDER)))
    hosts = sources.where("is_enabled").select(text.host_key("start_url").alias("host"), F.struct(rank.alias("r"), F.col("id").alias("source_id")).alias("s"))
    best = hosts.where("host <> ''").groupBy("host").agg(F.min("s").alias("s"))
    return urls.withColumn("host", text.host_key("url")).join(best, "host", "left").select("url", F.col("s.source_id").alias("source_id"))


def existing_for_url(urls: DataFrame, items: DataFrame) -> DataFrame:
    """url, content_id: the latest item whose canonical or original URL it is; two equi-joins rather than an OR."""
    either = items.select(F.col("canonical_url").alias("url"), "id").unionByName(items.select(F.col("original_url").alias("url"), "id")).where("url IS NOT NULL")
    return urls.join(either.groupBy("url").agg(F.max("id").alias("content_id")), "url", "left")


def repair_timezone(raw: DataFrame, zone: str) -> DataFrame:
    """New raw versions for payloads whose naive time was read as UTC though it was local; the old ones stay."""
    return raw.where("naive_time AND provider_zone IS NULL").withColumns({"published_at": F.to_utc_timestamp("published_at", zone), "provider_zone": F.lit(zone), "naive_time": F.lit(False)})


def cached_requests(requests: DataFrame, cache: DataFrame, now: Column, miss_cost: int = 2) -> DataFrame:
    """Requests with a cached response where one hasn't expired, and what each costs."""
    digest = F.sha2(F.concat_ws("\n", "provider", "operation", "query"), 256)
    live = cache.where(F.col("expires_at") > now).select("request_hash", "response")
    met = requests.withColumn("request_hash", digest).join(live, "request_hash", "left")
    return met.withColumn("credits", F.when(F.col("response").isNull(), miss_cost).otherwise(0))


def coverage_dates(runs: DataFrame, zone_hours: int = 8) -> DataFrame:
    """run_id, coverage_date, is_valid: the day that a run covers, in local time.

    runs: run_id, mode, reference_time, requested_date. Sources of mode `date` cover the requested day, or the day
    before the run; a requested day that isn't before the run's is not valid. Other sources cover no day.
    """
    today = F.to_date(F.col("reference_time") + F.expr(f"INTERVAL {zone_hours} HOURS"))
    dated = F.col("mode") == "date"
    day = F.when(dated, F.coalesce("requested_date", F.date_sub(today, 1)))
    return runs.select("run_id", day.alias("coverage_date"), F.when(dated, day < today).otherwise(F.col("requested_date").isNull()).alias("is_valid"))


def exact_candidates(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """name, identity, how: the one identity whose name is the same, literally or else normalized; null where none or several are.

    names: name; candidates: name, identity. Normalized names have no case, spaces or signs.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")

    def unique(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key).agg(F.min("identity").alias(f"{key}_identity"), F.max("identity").alias("_last")).where(F.col(f"{key}_identity") == F.col("_last")).drop("_last")

    named = candidates.select(F.col("name"), plain("name").alias("plain"), "identity")
    rows = names.select("name").distinct().withColumn("plain", plain("name")).join(unique(named, "name"), "name", "left").join(unique(named, "plain"), "plain", "left")
    how = F.when(F.col("name_identity").isNotNull(), "literal").when(F.col("plain_identity").isNotNull(), "normalized")
    return rows.select("name", F.coalesce("name_identity", "plain_identity").alias("identity"), how.alias("how"))
