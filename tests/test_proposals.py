"""Joins of proposed mentions with their evidence grow in tasks, not in what a task holds."""

from __future__ import annotations

from __spark_entry__ import queries
from newsloom.operators import proposals
from tests.conftest import SMALL


def test_more_inputs_are_joined_by_more_tasks(spark, monkeypatch):
    def told():
        df = queries()["x6_batch_violations"](spark, SMALL)
        return df._jdf.queryExecution().optimizedPlan().toString(), sorted(map(tuple, df.collect()))

    few, rows = told()
    monkeypatch.setattr(proposals, "INPUTS", 10)  # 200 documents
    many, same = told()
    assert "RepartitionByExpression" in few and many.count(", 20\n") == 2 and rows and same == rows


def test_mentions_join_their_evidence_alike(spark, monkeypatch):
    monkeypatch.setattr(proposals, "INPUTS", 10)
    plan = queries()["x8_proposed_mentions"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [batch_id") >= 4
