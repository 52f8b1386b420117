"""Generated editorials and editions checked against their sources: every breach is a row.

Batches: `answers` have batch_id, position, content_ref, input_content_hash, claim_refs (array, in order of the
summary), texts (array of text, refs: the title, the summary's units and the tags' labels with the evidence they cite) and
tags (array of tag_key, label); `inputs` have batch_id, position, content_ref, input_content_hash and evidence (array of
ref, text).

Editions: `placements` are rows of edition_id, section_place, section_key, story_place, story_ref, in_intro (as in
editions.py); `sections` of edition_id, section_place, section_key, title, intro; `leads` of edition_id, text and
story_refs (array); `stories` of edition_id, story_place, story_ref and text (all that is known of a story); `catalog`
of section_key, title and place in the policy's order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.cards import unsupported_numbers

BATCH_RULES = ("ref_order", "hash_mismatch", "unstable_claims", "tag_not_in_policy", "unknown_evidence", "unsupported_number")
EDITION_RULES = ("missing_story", "unexpected_story", "duplicate_story", "unknown_lead_story", "too_many_sections", "section_not_in_policy", "section_order", "intro_outside_section", "unsupported_number")


def _breach(rows: DataFrame, keys: list[str], rule: str, offender: Column | str) -> DataFrame:
    return rows.select(*keys, F.lit(rule).alias("rule"), (F.col(offender) if isinstance(offender, str) else offender).cast("string").alias("offender"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def batch_violations(answers: DataFrame, inputs: DataFrame, policy: DataFrame | None = None) -> DataFrame:
    """batch_id, content_ref, rule, offender: every breach of BATCH_RULES; a batch without a row is sound.

    References are those of the inputs, position by position; the other rules hold for answers whose reference is an
    input's. Claims are numbered content_ref#summary:1 and on. A text cites evidence of its input only; its numbers are
    borne out by what it cites or else by the input's evidence as a whole (also where a text cites nothing). policy
    (tag_key, label): tags must be in it with their label. Null arrays count as empty.
    """
    keys = ["batch_id", "content_ref"]
    asked, given = inputs.select("batch_id", "position", F.col("content_ref").alias("asked")), answers.select("batch_id", "position", "content_ref")
    met = asked.join(given, ["batch_id", "position"], "full").where(~F.col("asked").eqNullSafe(F.col("content_ref")))
    met = met.select("batch_id", F.coalesce("content_ref", "asked").alias("content_ref"), F.concat_ws(":", F.col("position").cast("string"), F.coalesce("asked", F.lit(""))).alias("o"))
    sources = inputs.select(*keys, F.col("input_content_hash").alias("expected"), F.coalesce("evidence", F.array()).alias("evidence"))
    known = answers.join(sources, keys)
    claims = F.coalesce("claim_refs", F.array())
    wanted = F.transform(claims, lambda _, k: F.concat(F.col("content_ref"), F.lit("#summary:"), (k + 1).cast("string")))
    texts = known.select(*keys, "evidence", F.posexplode(F.coalesce("texts", F.array())).alias("place", "t")).select(*keys, "evidence", "place", "t.text", F.coalesce("t.refs", F.array()).alias("refs"))
    strange = texts.select(*keys, F.explode(F.array_except("refs", F.transform("evidence", lambda e: e["ref"]))).alias("o"))
    cited = F.array_join(F.transform(F.filter("evidence", lambda e: F.array_contains(F.col("refs"), e["ref"])), lambda e: e["text"]), " ")
    whole = F.array_join(F.transform("evidence", lambda e: e["text"]), " ")
    # Only texts that hold a digit go through the check of numbers, and to the whole evidence only what the cited part leaves open.
    first = texts.where(F.col("text").rlike(r"\d")).withColumn("open", unsupported_numbers(F.col("text"), cited)).where(F.size("open") > 0)
    numbers = first.withColumn("left", unsupported_numbers(F.col("text"), whole)).select(*keys, F.explode(F.array_intersect("open", "left")).alias("o"))
    parts = [
        _breach(met, keys, BATCH_RULES[0], "o"), _breach(known.where(~F.col("input_content_hash").eqNullSafe(F.col("expected"))), keys, BATCH_RULES[1], "input_content_hash"),
        _breach(known.where(~claims.eqNullSafe(wanted)), keys, BATCH_RULES[2], F.array_join(claims, ",")), _breach(strange, keys, BATCH_RULES[4], "o"), _breach(numbers, keys, BATCH_RULES[5], "o"),
    ]
    if policy is not None:
        tags = known.select(*keys, F.explode("tags").alias("t")).select(*keys, "t.tag_key", "t.label")
        parts.append(_breach(tags.join(policy.select("tag_key", "label"), ["tag_key", "label"], "left_anti"), keys, BATCH_RULES[3], "tag_key"))
    return _all(parts).distinct()


def edition_violations(placements: DataFrame, sections: DataFrame, leads: DataFrame, stories: DataFrame, catalog: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """edition_id, rule, offender: every breach of EDITION_RULES; an edition without a row is sound.

    Every story stands in the sections exactly once. The lead names known stories. With a policy, sections are at most
    `most`, are in the catalog with their title, and follow its order: each section's place is no less than that of any
    before it. An introduction names stories of its section. The numbers of a lead or introduction are borne out by the
    stories that it names.
    """
    key, story = ["edition_id"], ["edition_id", "story_ref"]
    body = placements.where("section_place IS NOT NULL")
    own = body.where(~F.col("in_intro") | F.col("story_place").isNotNull())
    counts = own.groupBy(*story).agg(F.count("*").alias("n"))
    known = stories.select(*story).distinct()
    named = leads.select("edition_id", F.explode("story_refs").alias("story_ref"))
    outside = body.where("in_intro AND story_place IS NULL")
    texts = stories.groupBy(*story).agg(F.first("text").alias("story_text"))
    line = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("story_ref", "story_text"))), lambda x: x["story_text"]), " ")

    def unborne(rows: DataFrame, refs: DataFrame, where: Column) -> DataFrame:
        """Numbers of rows (edition_id, scope, text) that no story of refs (edition_id, scope, story_ref) bears out."""
        evidence = refs.join(texts, story).groupBy("edition_id", "scope").agg(line.alias("evidence"))
        asked = rows.where(F.col("text").rlike(r"\d")).join(evidence, ["edition_id", "scope"], "left")
        found = asked.select("edition_id", "scope", F.explode(unsupported_numbers(F.col("text"), F.coalesce("evidence", F.lit("")))).alias("number"))
        return _breach(found, key, EDITION_RULES[8], F.concat_ws(":", where, "number"))

    lead = unborne(leads.select("edition_id", F.lit(0).alias("scope"), "text"), named.withColumn("scope", F.lit(0)), F.lit("lead"))
    intro = unborne(sections.select("edition_id", F.col("section_place").alias("scope"), F.col("intro").alias("text")), body.where("in_intro").select("edition_id", F.col("section_place").alias("scope"), "story_ref"), F.col("scope").cast("string"))
    parts = [
        _breach(known.join(counts, story, "left_anti"), key, EDITION_RULES[0], "story_ref"), _breach(counts.join(known, story, "left_anti"), key, EDITION_RULES[1], "story_ref"),
        _breach(counts.where("n > 1"), key, EDITION_RULES[2], "story_ref"), _breach(named.join(known, story, "left_anti"), key, EDITION_RULES[3], "story_ref"),
        _breach(outside, key, EDITION_RULES[7], F.concat_ws(":", F.col("section_place").cast("string"), "story_ref")), lead, intro,
    ]
    if most is not None:
        many = sections.groupBy("edition_id").agg(F.count("*").alias("n")).where(F.col("n") > most)
        parts.append(_breach(many, key, EDITION_RULES[4], "n"))
    if catalog is not None:
        placed = sections.join(catalog.select("section_key", F.col("title").alias("expected"), "place"), "section_key", "left")
        parts.append(_breach(placed.where(~F.col("title").eqNullSafe(F.col("expected"))), key, EDITION_RULES[5], "section_key"))
        before = Window.partitionBy("edition_id").orderBy("section_place").rowsBetween(Window.unboundedPreceding, -1)
        parts.append(_breach(placed.withColumn("highest", F.max("place").over(before)).where("place < highest"), key, EDITION_RULES[6], "section_key"))
    return _all(parts).distinct()
