"""Approximate vector top-k: recall against the exact route, whole results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import ivf
from marquee.operators.vectors import vector_topk


def rows(df):
    out = {}
    for r in df.orderBy("q", "rank").collect():
        out.setdefault(r["q"], []).append((r["c"], round(r["distance"], 9)))
        assert r["rank"] == len(out[r["q"]])
    return out


def recall(found, exact):
    assert {a: len(b) for a, b in found.items()} == {a: len(b) for a, b in exact.items()}
    return sum(len(set(found[a]) & set(b)) for a, b in exact.items()) / sum(len(b) for b in exact.values())


def clustered(spark, n=3000, dim=16, centres=25, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    points = middle[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * 0.25
    table = [(str(i), p.tolist(), float(i % 7), f"t{i % 11}") for i, p in enumerate(points)]
    return spark.createDataFrame(table, "id string, embedding array<double>, score double, title string")


def test_recall_on_given_vectors(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    exact = rows(vector_topk(e, k=10, block_rows=512))
    assert recall(rows(ivf.vector_topk_lists(e, k=10)), exact) >= 0.9


def test_clusters_need_few_lists(spark):
    v = clustered(spark)
    fitted = ivf.fit_lists(v, k=10)
    assert len(fitted.centres) == 55 and fitted.probes <= 8  # a seventh of the lists is read
    assert recall(rows(ivf.vector_topk_lists(v, fitted, k=10)), rows(vector_topk(v, k=10))) >= 0.93
    again = ivf.fit_lists(v, k=10)
    assert (again.centres == fitted.centres).all() and again.probes == fitted.probes


def test_all_lists_give_the_exact_result(spark):
    """Split lists, query chunks, a query subset, ties by score, title and id."""
    v = clustered(spark, n=400)
    v = v.unionByName(v.where("try_cast(id as int) < 40").withColumn("id", F.concat(F.lit("copy"), "id")).withColumn("score", F.lit(None).cast("double")))
    asked = v.where("try_cast(id as int) % 5 = 0 or id like 'copy%'").select("id")
    exact = vector_topk(v, k=7, queries=asked)
    found = ivf.vector_topk_lists(v, k=7, queries=asked, lists=6, probes=6, list_rows=30, query_rows=20)
    assert rows(found) == rows(exact)
    assert sorted(map(tuple, found.select("q", "c", "rank", "score", "title").collect()), key=repr) == sorted(
        map(tuple, exact.select("q", "c", "rank", "score", "title").collect()), key=repr
    )


def test_short_lists_fall_back_to_the_exact_route(spark):
    rng = np.random.default_rng(1)
    far = np.eye(8)
    points = [(f"a{i}", (far[0] + rng.normal(size=8) * 0.01).tolist()) for i in range(50)] + [(f"b{i}", (far[1] * 3 + rng.normal(size=8) * 0.01).tolist()) for i in range(3)]
    v = spark.createDataFrame(points, "id string, embedding array<double>")
    found = rows(ivf.vector_topk_lists(v, k=10, lists=2, probes=1))
    exact = rows(vector_topk(v, k=10))
    assert {q: len(c) for q, c in found.items()} == {q: 10 for q, _ in points}
    assert all(found[f"b{i}"] == exact[f"b{i}"] for i in range(3))


@pytest.mark.parametrize("points", [[], [("a", [1.0, 0.0])], [("a", None), ("b", [0.0, 0.0]), (None, [1.0, 0.0]), ("c", [float("nan"), 1.0]), ("d", [1.0, None])]])
def test_nothing_to_find(spark, points):
    v = spark.createDataFrame(points, "id string, embedding array<double>")
    assert ivf.vector_topk_lists(v, k=3).collect() == []


def test_a_third_of_the_rows_are_copies(spark):
    v = clustered(spark, n=600)
    hot = v.where("id = '5'").select("embedding").crossJoin(spark.range(300)).select(F.concat(F.lit("h"), "id").alias("id"), "embedding", F.lit(1.0).alias("score"), F.lit("x").alias("title"))
    v = v.unionByName(hot)
    found, exact = rows(ivf.vector_topk_lists(v, k=10, list_rows=64)), rows(vector_topk(v, k=10))
    assert recall(found, exact) >= 0.9 and all(found[f"h{i}"] == exact[f"h{i}"] for i in range(0, 300, 37))


def test_k_rows_per_query_leave_the_scan(spark, monkeypatch):
    """Not k for every list that a query looks into."""
    v, left = clustered(spark, n=600), []
    add = type(v).withColumn
    monkeypatch.setattr(type(v), "withColumn", lambda df, name, col: (name == "rank" and left.append(df.count()), add(df, name, col))[1])
    ivf.vector_topk_lists(v, k=5, lists=20, probes=15)
    assert left == [600 * 5]


def test_a_query_finds_the_best_of_its_lists(spark):
    """Many small groups, rows that come twice; against the definition."""
    v = clustered(spark, n=500)
    v = v.unionByName(v.where("try_cast(id as int) < 9"))
    fitted = ivf.fit_lists(v, lists=12, probes=5)
    table = [(r["id"], np.array(r["embedding"]), r["score"], r["title"]) for r in v.collect()]
    unit = ivf._unit([x[1] for x in table])
    nearest = ivf._nearest([x[1] for x in table], fitted.centres, 5)
    best = {}
    for i, (q, *_) in enumerate(table):
        for j in np.flatnonzero(np.isin(nearest[:, 0], nearest[i])):
            if table[j][0] != q:
                best.setdefault(q, []).append((round(1.0 - float(unit[i] @ unit[j]), 9), -table[j][2], table[j][3], table[j][0]))
    found = {}
    for r in ivf.vector_topk_lists(v, fitted, k=6, query_rows=20, group_rows=25).orderBy("q", "rank").collect():
        found.setdefault(r["q"], []).append((round(r["distance"], 9), -r["score"], r["title"], r["c"]))
    assert found == {q: sorted(c)[:6] for q, c in best.items()}
