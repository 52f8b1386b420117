"""Completion and reuse of editions on small cases, and empty tables."""

from __future__ import annotations

from __spark_entry__ import queries
from newsloom.operators import editions
from tests.conftest import SMALL

PLACED = "edition_id int, section_place int, section_key string, story_place int, story_ref string, in_intro boolean"
STORIES = "edition_id int, story_place int, story_ref string, tags array<string>"
CATALOG = "section_key string, tag_key string"


def _rows(df):
    return sorted((r.edition_id, r.section_key, r.story_ref, r.origin) for r in df.collect())


def test_completion(spark):
    placed = spark.createDataFrame([
        (1, 0, "a", 0, "x", True), (1, 1, "b", 0, "x", True), (1, 1, "b", 1, "y", True), (1, 2, "c", 0, "z", False), (1, 0, "a", 1, "unknown", True),
        (2, 0, "a", 0, "q", False),
    ], PLACED)
    stories = spark.createDataFrame([(1, i, ref, tags) for i, (ref, tags) in enumerate([("x", []), ("y", []), ("z", []), ("u", ["t"]), ("v", ["none"]), ("w", None)])] + [(2, 0, "q", [])], STORIES)
    catalog = spark.createDataFrame([("a", "t"), ("b", "t")], CATALOG)
    # x stays where it stands first; c goes with z, whose introduction names nothing; u fits a before b; v and w go to the fallback.
    kept = [(1, "a", "x", "editor"), (1, "b", "y", "editor"), (1, "a", "u", "appended"), (2, "a", "q", "unchanged")]
    assert _rows(editions.complete(placed, stories, catalog, "a")) == sorted(kept + [(1, "a", "v", "appended"), (1, "a", "w", "appended")])
    last = kept + [(1, "b", "v", "appended"), (1, "b", "w", "appended")]
    assert _rows(editions.complete(placed, stories, catalog)) == sorted(last)
    assert _rows(editions.complete(placed, stories, catalog, "absent")) == sorted(last)


def test_reuse(spark):
    prior = spark.createDataFrame([(e, 0, "a", i, ref, True) for e in (1, 2, 3) for i, ref in enumerate("xy")], PLACED)
    current = spark.createDataFrame([(1, 0, "y", []), (2, 0, "x", []), (2, 1, "new", [])], STORIES)
    assert [(r.edition_id, r.story_ref) for r in editions.reuse(prior, current).collect()] == [(1, "y")]


def test_empty_tables(spark):
    placed, stories, catalog = (spark.createDataFrame([], s) for s in (PLACED, STORIES, CATALOG))
    assert editions.complete(placed, stories, catalog, "a").count() == 0
    assert editions.reuse(placed, stories).count() == 0


def test_completion_sums_up_the_lines_once(spark):
    """Lines are kept: no part of the result goes back to the line items."""
    plan = queries()["q40_completed_editions"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_repeated_stories_count_once(spark):
    placements = spark.createDataFrame([(1, 0, "a", 5, 2, True), (1, 0, "a", 5, 1, False), (1, 0, "b", 5, 1, True), (1, 1, "c", 9, 1, True)], "edition_id long, section_place int, section_key string, story_ref long, story_place int, in_intro boolean")
    stories = spark.createDataFrame([(1, 1, 5, ["x"]), (1, 1, 5, ["x"])], "edition_id long, story_place int, story_ref long, tags array<string>")
    catalog = spark.createDataFrame([("a", "x")], "section_key string, tag_key string")
    found = [tuple(r) for r in editions.complete(placements, stories, catalog).collect()]
    assert found == [(1, 0, "a", 5, 1, True, "editor")]
