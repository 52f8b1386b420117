"""Daily editions as tables of placements: completion, reuse of an earlier edition, keys of cached answers.

Placements are rows of edition_id, section_place, section_key, story_place, story_ref and in_intro, so that an edition
is never held as one value. Stories are rows of edition_id, story_place, story_ref and, for completion, tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import written

KEY = ["edition_id", "story_ref"]
COLUMNS = ["edition_id", "section_place", "section_key", "story_ref", "story_place", "in_intro"]


def complete(placements: DataFrame, stories: DataFrame, catalog: DataFrame, fallback: str | None = None) -> DataFrame:
    """Every story in an edition once, without new text: placements with their origin.

    A story counts where it first stands; unknown ones go, and so do sections whose introduction names none of their
    stories. Stories that no section named are appended (after the others, in story_place) to the first section that
    shares a tag by `catalog` (section_key, tag_key), else to the section `fallback`, else to the last. An edition left
    without sections keeps its placements as they are. Stories of a section that goes stay out, as they were named.
    """
    # Known ones first: what is dealt out by edition and story needs no other exchange for the groups below.
    once = placements.join(stories.select(*KEY), KEY, "left_semi").groupBy("edition_id", "section_place", "section_key", "story_ref").agg(F.min("story_place").alias("story_place"), F.max("in_intro").alias("in_intro"))
    first = once.groupBy(*KEY).agg(F.min(F.struct("section_place", "story_place", "section_key", "in_intro")).alias("s"))
    first = written(first.select(*KEY, "s.section_place", "s.section_key", "s.story_place", "s.in_intro"), "editions-first")
    sections = written(first.groupBy("edition_id", "section_place", "section_key").agg(F.max("in_intro").alias("open")).where("open").drop("open"), "editions-sections")
    ends = sections.groupBy("edition_id").agg(F.max(F.struct("section_place", "section_key")).alias("last"), F.min(F.when(F.col("section_key") == F.lit(fallback), F.struct("section_place", "section_key"))).alias("general"))
    omitted = stories.join(first.select(*KEY), KEY, "left_anti")
    tagged = omitted.select(*KEY, F.explode("tags").alias("tag_key")).join(catalog.select("section_key", "tag_key").distinct(), "tag_key")
    fitting = tagged.join(sections, ["edition_id", "section_key"]).groupBy(*KEY).agg(F.min(F.struct("section_place", "section_key")).alias("fit"))
    added = omitted.select(*KEY, "story_place").join(ends, "edition_id").join(fitting, KEY, "left").withColumn("to", F.coalesce("fit", "general", "last"))
    added = added.select("edition_id", "to.section_place", "to.section_key", "story_ref", "story_place", F.lit(False).alias("in_intro"), F.lit("appended").alias("origin"))
    kept = first.join(sections, ["edition_id", "section_place", "section_key"], "left_semi").select(*COLUMNS, F.lit("editor").alias("origin"))
    untouched = placements.join(ends.select("edition_id"), "edition_id", "left_anti").select(*COLUMNS, F.lit("unchanged").alias("origin"))
    return kept.unionByName(added).unionByName(untouched)


def reuse(prior: DataFrame, current: DataFrame) -> DataFrame:
    """Placements of earlier editions whose stories have only become fewer; sections left without stories go.

    An edition with a story that its earlier version lacks, or without any story, is not reused. Introductions then
    name all stories of their section.
    """
    held = prior.select(*KEY).distinct().withColumn("held", F.lit(True))
    whole = current.select(*KEY).distinct().join(held, KEY, "left").groupBy("edition_id").agg(F.count_if(F.col("held").isNull()).alias("lacking"))
    wanted = current.select(*KEY).distinct().join(whole.where("lacking = 0").select("edition_id"), "edition_id", "left_semi")
    return prior.join(wanted, KEY, "left_semi").select("edition_id", "section_place", "section_key", "story_ref", "story_place")


def cache_key(task: str, version: str, validator: str, prompt: str, schema: str, client: str, source: Column) -> Column:
    """SHA-256 over all that an answer depends on; prompt, schema and source enter by their own hashes."""
    digest = lambda x: F.sha2(F.lit(x) if isinstance(x, str) else x, 256)
    parts = {"client": F.lit(client), "input": digest(source), "prompt": digest(prompt), "schema": digest(schema), "task": F.lit(task), "validator": F.lit(validator), "version": F.lit(version)}
    return F.sha2(F.to_json(F.struct(*[c.alias(name) for name, c in parts.items()])), 256)
