"""Violations of editions and batches, rule by rule."""

from __future__ import annotations

from newsloom.operators import validation

PLACE = "edition_id int, section_place int, section_key string, story_place int, story_ref string, in_intro boolean"
SECTION = "edition_id int, section_place int, section_key string, title string, intro string"
LEAD = "edition_id int, text string, story_refs array<string>"
STORY = "edition_id int, story_place int, story_ref string, text string"
CATALOG = "section_key string, title string, place int"


def edition(spark, sections, lead=("今日品牌动态", ["content:1"]), stories=("content:1", "content:2"), texts=None, policy=None, most=None):
    """sections: (key, title, intro, intro refs, refs)."""
    places = [(1, k, key, j, ref, ref in intro_refs) for k, (key, _, _, intro_refs, refs) in enumerate(sections) for j, ref in enumerate(refs)]
    places += [(1, k, key, None, ref, True) for k, (key, _, _, intro_refs, refs) in enumerate(sections) for ref in intro_refs if ref not in refs]
    frame = spark.createDataFrame
    found = validation.edition_violations(
        frame(places, PLACE), frame([(1, k, key, title, intro) for k, (key, title, intro, _, _) in enumerate(sections)], SECTION), frame([(1, *lead)], LEAD),
        frame([(1, k, ref, (texts or {}).get(ref, "")) for k, ref in enumerate(stories)], STORY), policy and frame(policy, CATALOG), most,
    )
    return sorted((r.rule, r.offender) for r in found.collect())


BOTH = ["content:1", "content:2"]


def test_stories_stand_exactly_once(spark):
    assert edition(spark, [("one", "动态", "第一组资讯。", ["content:1"], ["content:1"]), ("two", "其他", "第二组资讯。", BOTH, BOTH)]) == [("duplicate_story", "content:1")]
    assert edition(spark, [("one", "t", "i", [], ["content:1", "content:3"])]) == [("missing_story", "content:2"), ("unexpected_story", "content:3")]
    assert edition(spark, [("one", "t", "i", ["content:1"], BOTH)]) == []
    assert edition(spark, [("one", "t", "i", ["content:1"], ["content:1", "content:1", "content:2"])]) == [("duplicate_story", "content:1")]


def test_policy_order_and_scope(spark):
    policy = [("a", "A", 0), ("b", "B", 1), ("c", "C", 2)]
    assert edition(spark, [("b", "B", "", [], ["content:1"]), ("a", "A", "", [], ["content:2"])], policy=policy) == [("section_order", "a")]
    assert edition(spark, [("a", "Else", "", [], ["content:1"]), ("d", "D", "", [], ["content:2"])], policy=policy, most=1) == [("section_not_in_policy", "a"), ("section_not_in_policy", "d"), ("too_many_sections", "2")]
    assert edition(spark, [("a", "A", "", ["content:2"], ["content:1"]), ("b", "B", "", [], ["content:2"])], policy=policy) == [("intro_outside_section", "0:content:2")]
    assert edition(spark, [("a", "A", "", [], BOTH)], lead=("x", ["content:9"])) == [("unknown_lead_story", "content:9")]


def test_numbers_are_borne_out_by_the_stories_named(spark):
    texts = {"content:1": "Sales rose 12.5% to $2 billion", "content:2": "opened 40 stores in March"}
    sections = [("a", "A", "增长12.5%，销售20亿", ["content:1"], ["content:1"]), ("b", "B", "40 stores, 3月, 12.5%", ["content:2"], ["content:2"])]
    assert edition(spark, sections, lead=("40 stores", ["content:1"]), texts=texts) == [("unsupported_number", "1:12.5%"), ("unsupported_number", "lead:40")]


INPUT = "batch_id int, position int, content_ref string, input_content_hash string, evidence array<struct<ref:string,text:string>>"
ANSWER = "batch_id int, position int, content_ref string, input_content_hash string, claim_refs array<string>, texts array<struct<text:string,refs:array<string>>>, tags array<struct<tag_key:string,label:string>>"


def batch(spark, *answers):
    evidence = [("e1", "opened 40 stores"), ("e2", "profit of 7 million")]
    inputs = spark.createDataFrame([(1, 0, "c:1", "h1", evidence), (1, 1, "c:2", "h2", [])], INPUT)
    policy = spark.createDataFrame([("new", "新品")], "tag_key string, label string")
    found = validation.batch_violations(spark.createDataFrame([(1, k, *a) for k, a in enumerate(answers)], ANSWER), inputs, policy)
    return sorted((r.content_ref, r.rule, r.offender) for r in found.collect())


def test_batches(spark):
    two = ("c:2", "h2", [], [], [])
    good = ("c:1", "h1", ["c:1#summary:1", "c:1#summary:2"], [("40 stores", ["e1"]), ("700万 and 40", ["e2"]), ("no figure", None)], [("new", "新品")])
    assert batch(spark, good, two) == []
    assert batch(spark, good, ("c:2", "h2", None, None, None)) == []
    assert batch(spark, two, good) == [("c:1", "ref_order", "1:c:2"), ("c:2", "ref_order", "0:c:1")]
    assert batch(spark, ("c:1", "h", ["c:1#summary:2"], [("41 stores", ["e1", "e7"])], [("new", "旧"), ("old", "新品")]), two) == [
        ("c:1", "hash_mismatch", "h"), ("c:1", "tag_not_in_policy", "new"), ("c:1", "tag_not_in_policy", "old"), ("c:1", "unknown_evidence", "e7"),
        ("c:1", "unstable_claims", "c:1#summary:2"), ("c:1", "unsupported_number", "41"),
    ]
