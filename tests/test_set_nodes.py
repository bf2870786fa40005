"""Signatures are made once a document."""

from loamworks.plans import dedup


def test_signatures_are_made_once(spark, monkeypatch):
    plans, staged = {}, dedup.staged

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return staged(df, name)

    monkeypatch.setattr(dedup, "staged", seen)
    dedup.dd_jaccard_verify(spark, "/root/testdata/sf0.001").collect()
    # One evaluation for the documents and one for their revisions.
    assert plans["signatures"].count("ArrowEvalPython") == 2
