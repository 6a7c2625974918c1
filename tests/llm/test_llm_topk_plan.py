"""Top-k: nothing goes through the driver; queries in groups, dimensions apart."""

import numpy as np
import pytest

from marquee.llm import queries as q
from marquee.llm import topk


def test_no_table_is_joined_or_broadcast(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = q.op9_topk(spark, str(tmp_path))
    assert found.count() == 40
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()  # the final one: sizes are known
    assert "Broadcast" not in plan and "Join" not in plan


@pytest.mark.parametrize("group, shards", [(7, 3), (40, 1), (1_000, 5)])
def test_groups_of_queries_are_exact(spark, monkeypatch, group, shards):
    """Two dimensions, repeated ids and vectors, ties, zeros, nulls."""
    monkeypatch.setattr(topk, "GROUP", group)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.integers(-3, 4, 3 + int(i) % 2).tolist()) for i in rng.integers(0, 150, 300)]
    table = spark.createDataFrame(rows + [(None, [1, 2, 3]), (5, None), (6, [])], "vec_id long, v array<bigint>").repartition(5)
    asked = {i: v for i, v in rows if i % 5 == 0} | {900: [0, 0, 0], 901: [1, 1, 1, 1], 902: [1, 1]}
    found = topk.top_k(table, spark.createDataFrame(list(asked.items()), "vec_id long, v array<bigint>"), 6, shards=shards)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect())
    want = []
    for own, v in asked.items():
        best = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != own and len(w) == len(v))[:6]
        want += [(own, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
