"""Dates of pages: the first signal that gives one, in order, and where it came from."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from newsloom.sources import pages

BODY = "<article><p>" + "A plain sentence of the story. " * 10 + "</p></article>"
CASES = {
    "json_ld": ('<script type="application/ld+json">{"@type":"NewsArticle","headline":"T","datePublished":"2024-01-05T10:00:00Z"}</script><meta property="article:published_time" content="2024-01-06">', "2024-01-05 10:00:00"),
    "open_graph": ('<meta property="article:published_time" content="2024-01-06 08:00">', "2024-01-06 08:00:00"),
    "meta": ('<meta name="pubdate" content="Fri, 05 Jan 2024 10:00:00 GMT"><time datetime="2024-02-01"></time>', "2024-01-05 10:00:00"),
    "time": ('<meta name="pubdate" content="soon"><time datetime="2024-02-01"></time>', "2024-02-01 00:00:00"),
    "visible_text": ('<span class="date">January 7, 2024</span>', "2024-01-07 00:00:00"),
    "url": ("", "2024-03-02 00:00:00"),
    "none": ("", None),
}


@pytest.mark.parametrize("origin", CASES)
def test_date_origin(spark, origin):
    head, expected = CASES[origin]
    url = "https://n.example/2024/03/02/story" if origin == "url" else "https://n.example/story"
    rows = spark.createDataFrame([(1, url, f"<html><head><title>Title of it</title></head><body>{head}{BODY}</body></html>")], "page_id long, url string, html string")
    found = pages.extract_articles(rows.withColumn("facts", pages.page_facts(F.col("html")))).first()
    assert found["title"] in ("T", "Title of it")
    assert (None if found["published_at"] is None else str(found["published_at"])) == expected
    assert found["date_origin"] == (None if origin == "none" else origin)


TOPIC_CASES = {
    '<script type="application/ld+json">[{"@type":"Thing"},{"@graph":[{"@type":"Article","keywords":"a, b","articleSection":["News"],"about":[{"@id":"x"},{"name":"","term":"Term"}]}]}]</script>': ["a", "b", "News", "x", "Term"],
    '<script type="application/ld+json">not json</script><meta property="article:tag" content="One"><meta property="article:tag" content="one"><meta name="news_keywords" content="Two">': ["One", "Two"],
    '<a rel="nofollow tag" href="/x"> Three  four </a><a rel="tags" href="/y">no</a><a href="/z">no</a>': ["Three four"],
    '<script type="application/ld+json">{"@type":"BlogPosting","keywords":7}</script><script type="application/ld+json">{"@type":"Article","keywords":"later"}</script>': ["7"],
    "": [],
}


def test_topics_of_pages(spark):
    rows = spark.createDataFrame([(k, html) for k, html in enumerate(TOPIC_CASES)] + [(99, None)], "k int, html string")
    found = {r.k: r.topics for r in rows.select("k", pages.page_topics(pages.page_facts(F.col("html"))).alias("topics")).collect()}
    assert found == {k: v for k, v in enumerate(TOPIC_CASES.values())} | {99: []}


def test_paths_of_lists():
    rows = [{}] * 2
    assert pages.list_paths(rows) == ["$"] and pages.list_paths([]) == pages.list_paths([1]) == pages.list_paths("x") == []
    assert pages.list_paths({"b": {"c": {"d": rows, "e": {"f": rows}}}, "a": rows, "m": [{}, 1]}) == ["b.c.d", "a"]
    assert pages.list_paths({f"k{n}": rows for n in range(12)}) == [f"k{n}" for n in range(10)]
    assert pages.list_paths({"a": [{}] * 10 + [1]}) == ["a"]


def test_json_that_is_none(spark):
    rows = spark.createDataFrame([(1, '{"a":[{}]}'), (2, "{"), (3, None), (4, "[{}]")], "k int, j string")
    assert {r.k: r.p for r in rows.select("k", pages.json_list_paths(F.col("j")).alias("p")).collect()} == {1: ["a"], 2: None, 3: None, 4: ["$"]}
