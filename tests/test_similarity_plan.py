"""Pairs of the top-k engine are moved once, by query."""

import re

import pytest

from marquee.operators.similarity import topk_shared


@pytest.mark.parametrize("mode", ["overlap", "cosine"])
def test_pairs_are_moved_once(spark, mode):
    feats = spark.createDataFrame([("a", "x", 1), ("b", "x", 1), ("b", "y", 2)], "id string, feat string, w bigint")
    items = spark.createDataFrame([("a", 1.0, "A"), ("b", 2.0, None)], "id string, score double, title string")
    found = topk_shared(feats, items, 2, mode, hot_min_df=5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(q#\d+, (c|id)#", plan)
    assert {(r["q"], r["c"], r["dot"]) for r in found.collect()} == {("a", "b", 1), ("b", "a", 1)}
