"""Exact vector top-k: one pass over the candidates per group of queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import vectors as vx

ROW = "id string, embedding array<double>, score double, title string"


def brute(rows, k):
    """The definition in plain Python: rows of one id share one list."""
    lists = {}
    for q, qv, _, _ in rows:
        for c, cv, s, t in rows:
            a, b = np.array(qv, float), np.array(cv, float)
            if q != c and a.any() and b.any():
                d = 1.0 - (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))
                lists.setdefault(q, []).append((d, s is None, -(s or 0.0), t is None, t or "", c))
    return {(q, i + 1, x[5], round(x[0], 9)) for q, found in lists.items() for i, x in enumerate(sorted(found)[:k])}


@pytest.mark.parametrize("chunk", [7, 32_768])
def test_copies_repeated_and_null_ids(spark, monkeypatch, chunk):
    rng = np.random.default_rng(4)
    rows = [(str(i), rng.normal(size=6).tolist(), float(i % 3), f"t{i % 5}") for i in range(60)]
    rows += [(f"c{i}", rows[3][1], None if i % 4 == 0 else float(i % 2), None if i % 5 == 0 else f"t{i % 2}") for i in range(40)]
    rows += rows[:5] + [("zero", [0.0] * 6, 1.0, "z"), (None, rows[8][1], 1.0, "n"), (None, rows[3][1], 1.0, "n")]
    df = spark.createDataFrame(rows, ROW).unionByName(spark.createDataFrame([("x", None, 1.0, "x"), ("y", [1.0, None, 0.0, 0.0, 0.0, 0.0], 1.0, "x")], ROW))
    work = vx._scan

    def small(k):
        def task(batches):
            vx.CHUNK_ROWS, vx._STRIP = chunk, 5
            yield from work(k)(b for batch in batches for b in [batch.slice(i, 5) for i in range(0, batch.num_rows, 5)])

        return task

    monkeypatch.setattr(vx, "_scan", small)
    found = vx.vector_topk(df, k=6, blocks=3)
    assert {(r["q"], r["rank"], r["c"], round(r["distance"], 9)) for r in found.collect()} == brute(rows, 6)


def test_vectors_cross_the_network_once_per_group(spark, monkeypatch):
    """Not once per few hundred rows: 20,000 rows go to 2 groups per core."""
    assert vx.query_groups(spark, 20_000, 256) == 2 * spark.sparkContext.defaultParallelism
    assert vx.query_groups(spark, 500, 256) == 2
    assert vx.query_groups(spark, 10_000_000, 256) == 306
    seen = []
    monkeypatch.setattr(vx.F, "sequence", lambda a, b: seen.append(b) or F.expr("array(0)"))
    v = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("embedding"))
    vx.vector_topk(v, k=3, block_rows=100)
    assert str(seen[0]._jc) == str(2 * spark.sparkContext.defaultParallelism - 1)
