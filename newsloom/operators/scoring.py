"""Explainable value scores: six weighted components, penalties and gates, in one projection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import half_up


@dataclass(frozen=True)
class Config:
    """Fixed values of the deterministic scoring, version 1."""

    threshold: float = 50.0
    weights: dict[str, float] = field(default_factory=lambda: {"recency": 0.25, "source_quality": 0.20, "completeness": 0.20, "corroboration": 0.25, "confirmed_entities": 0.0, "domain_confidence": 0.10})
    full_hours: float = 24
    zero_hours: float = 168
    source_quality: dict[str, float] = field(default_factory=lambda: {"research_media": 0.95, "association": 0.90, "trade_media": 0.85, "business_media": 0.80, "data_platform": 0.80, "data_media": 0.80, "wechat_official_account": 0.72, "consumer_media": 0.65})
    other_source: float = 0.65
    status: dict[str, float] = field(default_factory=lambda: {"complete": 1.0, "partial": 0.35, "unknown": 0.60})
    full_chars: float = 1200
    access: dict[str, float] = field(default_factory=lambda: {"public": 1.0, "partial": 0.60, "subscriber": 0.45})
    other_access: float = 0.60
    completeness: tuple[float, float, float] = (0.50, 0.30, 0.20)
    two_sources: float = 0.70
    full_sources: int = 3
    full_entities: int = 3
    sponsored: float = 25.0

    def __post_init__(self) -> None:
        """Six weights that sum to one, and a threshold within the scale."""
        if len(self.weights) != 6 or abs(sum(self.weights.values()) - 1) > 1e-9 or not 0 <= self.threshold <= 100:
            raise ValueError("weights or threshold out of range")


def _chosen(column: str, values: dict[str, float], other: float) -> Column:
    out = F.when(F.lit(False), 0.0)
    for key, value in values.items():
        out = out.when(F.col(column) == key, value)
    return out.otherwise(other)


def recency(as_of: Column, config: Config = Config()) -> Column:
    """One until full_hours, falling to zero at zero_hours; undated content has none."""
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(as_of) - F.unix_timestamp("published_at")) / 3600)
    fall = (F.lit(config.zero_hours) - age) / (config.zero_hours - config.full_hours)
    return F.when(F.col("published_at").isNull(), 0.0).when(age <= config.full_hours, 1.0).when(age >= config.zero_hours, 0.0).otherwise(fall)


def completeness(config: Config = Config()) -> Column:
    status = F.when(F.col("body_complete"), config.status["complete"]).when(~F.col("body_complete"), config.status["partial"]).otherwise(config.status["unknown"])
    body = F.least(F.lit(1.0), F.length(F.regexp_replace(F.coalesce("body", F.lit("")), r"\A(?U)\s+|(?U)\s+\z", "")) / config.full_chars)
    a, b, c = config.completeness
    return status * a + body * b + _chosen("access_level", config.access, config.other_access) * c


def corroboration(config: Config = Config()) -> Column:
    n = F.coalesce(F.col("source_count"), F.lit(1))
    return F.when(n < 2, 0.0).when(n >= config.full_sources, 1.0).otherwise(config.two_sources)


def event_statistics(members: DataFrame, items: DataFrame) -> DataFrame:
    """content_item_id, member_count, source_count: over the active members of the event that the item is active in.

    Counts are made once per event and joined to its members, so a large event costs its size, not its square. An item
    is active in one event at most; if the data say otherwise, its largest event counts.
    """
    active = members.where("is_active").select("event_id", "content_item_id").distinct()
    known = active.join(items.select(F.col("id").alias("content_item_id"), "source_id"), "content_item_id")
    counts = known.groupBy("event_id").agg(F.count("*").alias("m"), F.countDistinct("source_id").alias("s"))
    best = active.join(counts, "event_id").groupBy("content_item_id").agg(F.max(F.struct("m", "s")).alias("best"))
    return best.select("content_item_id", F.col("best.m").alias("member_count"), F.col("best.s").alias("source_count"))


def value_scores(items: DataFrame, assignments: DataFrame, events: DataFrame, entities: DataFrame | None, duplicates: DataFrame, as_of: Column, config: Config = Config()) -> DataFrame:
    """Scores of the items that the domain currently includes: total, components, penalty, gates and decision.

    assignments: current or stale rows of one domain; the latest current `include` of an item counts. events: from
    event_statistics; entities: content_item_id and entity_count, or None; duplicates: id and duplicate_of_id.
    """
    item = items.withColumnRenamed("id", "content_item_id")
    held = assignments.where("decision = 'include'").select(F.col("id").alias("assignment_id"), "content_item_id", "confidence", "input_content_hash")
    rows = held.join(item, "content_item_id").where("input_content_hash = content_hash").where(F.col("published_at").isNull() | (F.col("published_at") <= as_of))
    latest = Window.partitionBy("content_item_id").orderBy(F.desc("assignment_id"))
    rows = rows.withColumn("_latest", F.row_number().over(latest)).where("_latest = 1").drop("_latest")
    rows = rows.join(events, "content_item_id", "left").join(duplicates.select(F.col("id").alias("content_item_id"), "duplicate_of_id"), "content_item_id", "left")
    rows = rows.join(entities, "content_item_id", "left") if entities is not None else rows.withColumn("entity_count", F.lit(0).cast("bigint"))
    parts = {
        "recency": recency(as_of, config),
        "source_quality": _chosen("source_type", config.source_quality, config.other_source),
        "completeness": completeness(config),
        "corroboration": corroboration(config),
        "confirmed_entities": F.least(F.lit(1.0), F.coalesce(F.col("entity_count"), F.lit(0)) / config.full_entities),
        "domain_confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))),
    }
    rows = rows.withColumns({f"{k}_points": half_up(v * config.weights[k] * 100, 4) for k, v in parts.items()})
    base = sum((F.col(f"{k}_points") for k in parts), F.lit(0.0))
    penalty = F.when(F.col("is_sponsored"), config.sponsored).otherwise(0.0)
    gates = F.concat_ws(",", F.when(F.col("published_at").isNull(), "missing_published_at"), F.when(F.col("duplicate_of_id").isNotNull(), "duplicate"))
    rows = rows.withColumn("penalty_points", penalty).withColumn("gates", gates)
    rows = rows.withColumn("total_score", half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), base - F.col("penalty_points"))), 2))
    decision = F.when((F.col("total_score") >= config.threshold) & (F.col("gates") == ""), "selected").otherwise("full_pool")
    rows = rows.withColumn("decision", decision)
    return rows.select("content_item_id", "input_content_hash", *[f"{k}_points" for k in parts], "penalty_points", "gates", "total_score", "decision")


def latest_decisions(scores: DataFrame, runs: DataFrame) -> DataFrame:
    """content_item_id, decision: of each domain's latest succeeded run; selected in any domain wins."""
    last = runs.where("status = 'succeeded'").groupBy("domain_id").agg(F.max("id").alias("run_id")).select("run_id")
    rows = scores.join(last, "run_id")
    return rows.groupBy("content_item_id").agg(F.max(F.when(F.col("decision") == "selected", 1).otherwise(0)).alias("s")).select("content_item_id", F.when(F.col("s") == 1, "selected").otherwise("full_pool").alias("decision"))


def curated(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items but those expressly left to the full pool; unscored ones stay."""
    dropped = decisions.where("decision = 'full_pool'").select(F.col("content_item_id").alias("id"))
    return items.join(dropped, "id", "left_anti")


def apply_runs(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """What applying score runs does: by input hash a new run is created, a succeeded one reused, any other a conflict.

    planned: input_hash; existing: input_hash, status. Of several runs of one hash a succeeded one holds.
    """
    old = existing.groupBy("input_hash").agg(F.max((F.col("status") == "succeeded").cast("int")).alias("done"))
    action = F.when(F.col("done").isNull(), "created").when(F.col("done") == 1, "reused").otherwise("conflict")
    return planned.select("input_hash").distinct().join(old, "input_hash", "left").select("input_hash", action.alias("action"))
