"""A topic's daily report: its stories by local day, and what their cards say."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from __spark_entry__ import queries
from newsloom.operators import reader

CONTENT = "topic_id bigint, id bigint, title string, excerpt string, body string, source_id bigint, published_at timestamp, language string"
ROWS = [
    (1, 10, "Late", "", "A body. " * 50, 3, datetime(2024, 1, 1, 17), "en"), (1, 11, "Early", "said", None, 3, datetime(2024, 1, 1, 1), "en"), (1, 12, "Same", "said", "b", 4, datetime(2024, 1, 1, 1), "en"),
    (2, 10, "Late", "", "A body. " * 50, 3, datetime(2024, 1, 1, 17), "en"), (1, 13, "Undated", "", "b", 3, None, "en"),
]
from tests.conftest import SMALL


def test_stories_of_a_day(spark):
    stories = reader.topic_daily_stories(spark.createDataFrame(ROWS, CONTENT))
    found = sorted((r.topic_id, r.report_date.day, r.place, r.content_item_id, r.body_chars) for r in stories.collect())
    assert found == [(1, 1, 1, 12, 1), (1, 1, 2, 11, 0), (1, 2, 1, 10, 400), (2, 2, 1, 10, 400)]
    late = reader.topic_daily_stories(spark.createDataFrame(ROWS, CONTENT), F.lit(date(2024, 1, 2))).where("topic_id = 2").first()
    assert late.issue_date == date(2024, 1, 3) and len(late.summary) == 260 and late.summary.endswith("…")
    assert reader.topic_daily_stories(spark.createDataFrame(ROWS, CONTENT), F.lit(date(2024, 2, 1))).count() == 0


def test_editorials_from_cards(spark):
    stories = reader.topic_daily_stories(spark.createDataFrame(ROWS, CONTENT))
    cards = spark.createDataFrame([(10, "Card", ["One.", "Two."], "x", ["tag"]), (11, "Bare", [], "excerpt", []), (12, "None", [], None, [])], "content_item_id bigint, title string, paragraphs array<string>, excerpt string, tags array<string>")
    found = sorted((r.topic_id, r.story_key, r.title, r.summary, r.tags) for r in reader.topic_editorials(stories, cards).collect())
    assert found == [(1, "content:10", "Card", "One. Two.", ["tag"]), (1, "content:11", "Bare", "excerpt", []), (1, "content:12", "None", "", []), (2, "content:10", "Card", "One. Two.", ["tag"])]


def test_topic_editorials_match_their_texts_once(spark):
    """Stories are kept, so that only the cards' texts are still to be read."""
    plan = queries()["q33_topic_editorials"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
