"""Scheduling and source health: latest runs per source, failure streaks, circuits, slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.content import ZONE

#: Runs looked back on, failures that open a circuit, its hours, the daily slots, hours until a run is stale.
RECENT, THRESHOLD, COOLDOWN_HOURS, STALE_HOURS = 5, 3, 6, 1
SLOTS = ("09:30:00", "18:00:00")
ACTIVE = ("pending", "running")


def _slots(now: Column, days: range) -> list[Column]:
    """The slots of the local days around `now`, as UTC."""
    day = F.to_date(F.from_utc_timestamp(now, ZONE))
    return [F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", F.date_add(day, d).cast("string"), F.lit(t))), ZONE) for d in days for t in SLOTS]


def current_slot(now: Column) -> Column:
    """The latest slot that has begun."""
    return F.greatest(*[F.when(s <= now, s) for s in _slots(now, range(-1, 1))])


def next_slot(now: Column) -> Column:
    return F.least(*[F.when(s > now, s) for s in _slots(now, range(0, 2))])


def recent_runs(runs: DataFrame, n: int = RECENT) -> DataFrame:
    """The latest n runs of each source with their place; the limit is applied before the shuffle as well."""
    order = Window.partitionBy("source_id").orderBy(F.desc("started_at"), F.desc("id"))
    return runs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def failure_streaks(runs: DataFrame, n: int = RECENT) -> DataFrame:
    """source_id, consecutive_failures: failed runs before the first other one among the latest n."""
    broken = F.min(F.when(F.col("status") != "failed", F.col("place")))
    counts = recent_runs(runs, n).groupBy("source_id").agg(broken.alias("broken"), F.count("*").alias("seen"))
    return counts.select("source_id", F.coalesce(F.col("broken") - 1, F.col("seen")).cast("bigint").alias("consecutive_failures"))


def source_health(runs: DataFrame, now: Column) -> DataFrame:
    """Per source: the latest run's facts, the failure streak and whether its circuit is open."""
    finished = F.coalesce(F.col("finished_at"), F.col("started_at")) if "finished_at" in runs.columns else F.col("started_at")
    rows = recent_runs(runs.withColumn("_finished", finished))
    broken = F.min(F.when(F.col("status") != "failed", F.col("place")))
    last = lambda c: F.min_by(c, "place")
    facts = rows.groupBy("source_id").agg(
        last("id").alias("last_run_id"), last("status").alias("last_run_status"), last("started_at").alias("last_started_at"), last("_finished").alias("last_finished_at"),
        F.coalesce(broken - 1, F.count("*")).cast("bigint").alias("consecutive_failures"),
    )
    is_open = (F.col("consecutive_failures") >= THRESHOLD) & (F.col("last_finished_at") + F.expr(f"INTERVAL {COOLDOWN_HOURS} HOURS") > now)
    return facts.withColumn("circuit_open", is_open)


def source_is_due(now: Column) -> Column:
    """Enabled, reachable, no topic's own source, and not begun since the current slot."""
    usable = F.col("is_enabled") & ~F.coalesce(F.col("crawl_strategy").isin("blocked", "unavailable"), F.lit(False)) & ~F.coalesce(F.col("discovery_method") == "user_topic", F.lit(False))
    return usable & (F.col("last_started_at").isNull() | (F.col("last_started_at") < current_slot(now)))


def due_sources(sources: DataFrame, runs: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """The first `limit` sources by id that are due, not running and whose circuit is closed."""
    rows = sources.join(source_health(runs, now), F.col("id") == F.col("source_id"), "left")
    idle = ~F.coalesce(F.col("last_run_status").isin(*ACTIVE), F.lit(False)) & ~F.coalesce("circuit_open", F.lit(False))
    return rows.where(idle & source_is_due(now)).select("id", "name", "channel_type", "last_started_at").orderBy("id").limit(limit)


def recover_stale(runs: DataFrame, now: Column) -> DataFrame:
    """Runs with those active for more than an hour marked as failed."""
    stale = F.col("status").isin(*ACTIVE) & (F.col("started_at") < now - F.expr(f"INTERVAL {STALE_HOURS} HOURS"))
    code = F.col("error_code") if "error_code" in runs.columns else F.lit(None).cast("string")
    return runs.withColumns({"error_code": F.when(stale, "stale_run_recovered").otherwise(code), "status": F.when(stale, "failed").otherwise(F.col("status"))})


def health_totals(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: enabled sources, and how many last succeeded, failed or never ran."""
    last = runs.groupBy("source_id").agg(F.max_by("status", F.struct("started_at", "id")).alias("status"))
    rows = sources.where("is_enabled").join(last, F.col("id") == F.col("source_id"), "left")
    ok = F.col("status").isin("succeeded", "unchanged")
    n = lambda when: F.count(F.when(when, 1))
    return rows.agg(F.count("*").alias("enabled"), n(ok).alias("succeeded"), n(~ok).alias("failed"), n(F.col("status").isNull()).alias("never"))


def website_sources(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("channel_type").isin("web", "rss", "api") & (F.coalesce("discovery_method", F.lit("")) != "user_topic"))


def catalog_report(catalog: DataFrame, runs: DataFrame) -> DataFrame:
    """Every catalogue entry with its latest run, if it has one."""
    last = runs.groupBy("source_id").agg(F.max(F.struct("started_at", "id", "status", "fetched_count")).alias("r"))
    rows = catalog.join(last, F.col("id") == F.col("source_id"), "left")
    return rows.select("id", "name", F.coalesce("r.status", F.lit("never")).alias("last_status"), F.col("r.id").alias("last_run_id"), F.coalesce("r.fetched_count", F.lit(0)).alias("fetched_count"))


def viable_paths(paths: DataFrame) -> DataFrame:
    """Configured and detected (source_id, kind, url, status) paths, one per source, kind and url; a configured one wins."""
    rank = F.when(F.col("status") == "configured", 0).when(F.col("status") == "verified", 1).otherwise(2)
    best = paths.groupBy("source_id", "kind", "url").agg(F.min(F.struct(rank.alias("r"), "status")).alias("b"))
    return best.select("source_id", "kind", "url", F.col("b.status").alias("status"))


def may_start(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Run requests of sources that have no active run."""
    return requests.join(runs.where(F.col("status").isin(*ACTIVE)).select("source_id"), "source_id", "left_anti")
