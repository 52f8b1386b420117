"""Proposed entities: batches checked against their inputs, and accepted proposals turned into mentions with offsets.

A batch answers a list of inputs. `inputs`: batch_id, position, content_ref, content_item_id, input_content_hash,
evidence (array of ref, field, start_char, text). `answers`: batch_id, position, content_ref, input_content_hash,
mentions (array of surface, canonical_name, entity_type, evidence_ref, confidence).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.entities import CONTEXT, alias_candidates

#: What may be wrong, in the order in which a batch is read.
RULES = ("ref_order", "hash_mismatch", "unknown_evidence", "surface_not_in_evidence", "duplicate_candidate")
#: What tells a piece of evidence.
EVIDENCE = ["batch_id", "content_ref", "evidence_ref"]
#: Inputs whose evidence a task joins, however many inputs there are.
INPUTS = 10_000


def _mentions(answers: DataFrame) -> DataFrame:
    return answers.select("batch_id", "content_ref", "position", F.posexplode("mentions").alias("mention", "m")).select("batch_id", "content_ref", "position", "mention", "m.*")


def _evidence(inputs: DataFrame) -> DataFrame:
    return inputs.select("batch_id", "content_ref", "content_item_id", F.explode("evidence").alias("e")).select("batch_id", "content_ref", "content_item_id", F.col("e.ref").alias("evidence_ref"), "e.field", "e.start_char", "e.text")


def _with_evidence(mentions: DataFrame, evidence: DataFrame, inputs: DataFrame, how: str) -> DataFrame:
    """Mentions with the evidence that they name; tasks are as many as the inputs ask for, so that what one sorts stays bounded."""
    parts = max(int(inputs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-inputs.count() // INPUTS))
    return mentions.repartition(parts, *EVIDENCE).join(evidence.repartition(parts, *EVIDENCE), EVIDENCE, how)


def violations(answers: DataFrame, inputs: DataFrame) -> DataFrame:
    """batch_id, content_ref, rule, offender: every breach of RULES; a batch without a row is sound.

    References must be those of the inputs at the same positions (a breach is told by position, with the input's
    reference); the other rules hold for answers whose reference is an input's. A mention names evidence of its input
    and is a part of it, letter by letter, and is proposed once (surface, type, evidence); offenders are told by
    their place in the answer and what is wrong. An empty surface is part of any text; nulls equal nothing.
    """
    asked, given = inputs.select("batch_id", "position", F.col("content_ref").alias("asked")), answers.select("batch_id", "position", "content_ref")
    met = asked.join(given, ["batch_id", "position"], "full").where(~F.col("asked").eqNullSafe(F.col("content_ref")))
    order = met.select("batch_id", F.coalesce("content_ref", "asked").alias("content_ref"), F.lit(RULES[0]).alias("rule"), F.concat_ws(":", F.col("position").cast("string"), F.coalesce("asked", F.lit(""))).alias("offender"))
    sources = inputs.select("batch_id", "content_ref", F.col("input_content_hash").alias("expected"))
    known = answers.join(sources, ["batch_id", "content_ref"])
    hashes = known.where(~F.col("input_content_hash").eqNullSafe(F.col("expected"))).select("batch_id", "content_ref", F.lit(RULES[1]).alias("rule"), F.col("input_content_hash").alias("offender"))
    told = F.concat_ws(":", F.col("mention").cast("string"), "evidence_ref", "surface")
    rows = _with_evidence(_mentions(known), _evidence(inputs).select(*EVIDENCE, F.lit(True).alias("there"), "text"), inputs, "left")
    rule = F.when(F.col("there").isNull(), RULES[2]).when(~F.coalesce(F.contains("text", "surface"), F.lit(False)), RULES[3])
    parts = rows.withColumn("rule", rule).where("rule IS NOT NULL").select("batch_id", "content_ref", "rule", told.alias("offender"))
    twice = _mentions(known).groupBy("batch_id", "content_ref", "surface", "entity_type", "evidence_ref").agg(F.count("*").alias("n"), F.min("mention").alias("mention")).where("n > 1")
    return order.unionByName(hashes).unionByName(parts).unionByName(twice.select("batch_id", "content_ref", F.lit(RULES[4]).alias("rule"), told.alias("offender")))


def occurrences(text: Column, surface: Column) -> Column:
    """Offsets of a surface in a text from left to right, without overlaps: lengths of what stands between are summed."""
    between = F.split(text, F.concat(F.lit("\\Q"), F.replace(surface, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda a, x: F.struct((a["at"] + F.length(x) + F.length(surface)).alias("at"), F.array_append(a["starts"], a["at"] + F.length(x)).alias("starts"))
    found = F.aggregate(F.slice(between, F.lit(1), F.size(between) - 1), start, step, lambda a: a["starts"])
    return F.when(F.length(surface) > 0, found).otherwise(F.array().cast("array<int>"))


def mentions(answers: DataFrame, inputs: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions and resolution candidates of the sound batches.

    Mentions: one row for every place of a proposed surface in its evidence, with offsets in the document's field, the
    text around it within the evidence, and the entity where one alone has the surface or canonical name as an alias of
    the same type; several make it ambiguous, none unresolved, both without confidence. Candidates: the entities of an
    ambiguous mention, with the proposal's confidence. aliases: entity_id, entity_type, normalized_alias of active
    entities. Batches with a violation give nothing.
    """
    bad = violations(answers, inputs).select("batch_id").distinct()
    rows = _mentions(answers.join(bad, "batch_id", "left_anti"))
    rows = _with_evidence(rows, _evidence(inputs), inputs, "inner")
    rows = rows.withColumn("mention_id", F.concat_ws(":", F.col("batch_id").cast("string"), "content_ref", F.col("mention").cast("string")))
    possible = alias_candidates(rows.select("mention_id", "entity_type", "surface", "canonical_name"), aliases)
    claims = possible.groupBy("mention_id").agg(F.count("*").alias("n"), F.min("entity_id").alias("entity_id"))
    rows = rows.join(claims, "mention_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    one = F.col("n") == 1
    rows = rows.withColumn("at", F.explode(occurrences(F.col("text"), F.col("surface"))))
    size, begin = F.length("surface"), F.greatest(F.lit(0), F.col("at") - CONTEXT)
    around = F.substring(F.col("text"), begin + 1, F.col("at") + size + CONTEXT - begin)
    found = rows.select(
        "mention_id", "content_item_id", "entity_type", "surface", "field", (F.col("start_char") + F.col("at")).alias("start_offset"), (F.col("start_char") + F.col("at") + size).alias("end_offset"),
        F.regexp_replace(around, r"^\s+|\s+$", "").alias("evidence_text"), F.when(one, F.col("entity_id")).alias("entity_id"), F.when(one, F.col("confidence")).otherwise(0.0).alias("confidence"),
        F.when(one, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved").alias("resolution_status"),
    )
    open_ = found.where("resolution_status = 'ambiguous'").select("mention_id", "start_offset").join(rows.select("mention_id", F.col("confidence").alias("score")).distinct(), "mention_id")
    candidates = open_.join(possible.withColumnRenamed("entity_id", "candidate_entity_id"), "mention_id").select("mention_id", "start_offset", "candidate_entity_id", "score")
    return found, candidates
