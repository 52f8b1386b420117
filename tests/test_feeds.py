"""Why a provider's items are left out."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.sources.feeds import exclusion_reason

CASES = {
    '{"topFlag":"Y","isAd":1}': "explicit_pinned_flag",
    '{"isAd":"1","tags":["置顶"]}': "explicit_advertising_flag",
    '{"itemType":" AD "}': "explicit_advertising_type",
    '{"tags":"news|Top"}': "explicit_pinned_label",
    '{"tags":[null,{"value":"赞助"}],"labels":{"name":"x"}}': "explicit_advertising_label",
    '{"labels":{"tagName":"商业推广"}}': "explicit_advertising_label",
    '{"isTop":2,"isAd":false,"tags":["stop","ads"],"contentType":"article"}': None,
    "not json": None,
    "{}": None,
}


def test_reasons(spark):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(CASES)] + [(99, None)], "k int, item string")
    found = {r.k: r.reason for r in rows.select("k", exclusion_reason(F.col("item")).alias("reason")).collect()}
    assert found == {k: v for k, v in enumerate(CASES.values())} | {99: None}
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(CASES)], "k int, item string")
    only = [r.reason for r in rows.orderBy("k").select(exclusion_reason(F.col("item"), pinned=False).alias("reason")).collect()]
    assert only[0] == "explicit_advertising_flag" and only[3] is None
