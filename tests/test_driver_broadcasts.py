"""Sides that grow with the titles don't go through the driver."""

import random

import pytest
from pyspark.sql import functions as F

from marquee.operators import curate as cu
from marquee.operators import postings
from marquee.operators import recommend as rc
from marquee.operators.similarity import topk_shared
from marquee.sources import bindings as b


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, df, path):
    """Files have a known, small size."""
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


@pytest.mark.parametrize("mode", ["overlap", "cosine"])
def test_posting_lists_are_not_joined(spark, monkeypatch, mode):
    """Many shards (some without candidates) and blocks, ids of queries among them."""
    monkeypatch.setattr(postings, "QUERY_BLOCK", 9)
    rnd = random.Random(4)
    of = {f"i{i:02d}": {f"f{f}": rnd.randint(1, 3) for f in rnd.sample(range(12), rnd.randint(1, 6))} for i in range(60)}
    rows = [(i, sum(w * w for w in v.values()), [(f, w) for f, w in sorted(v.items())], rnd.choice([None, 1.0, 2.0]), rnd.choice([None, "a"])) for i, v in of.items()]
    items = spark.createDataFrame(rows, "c string, n2 bigint, hv array<struct<feat:string,w:bigint>>, score double, title string")
    cand = items if mode == "overlap" else items.drop("score", "title")
    asked = items.select(F.col("c").alias("q"), "n2", "hv").where("c > 'i20'")
    k = 60
    found = postings.best_by_postings(asked, cand, k, mode, F.lit(39), F.lit(400), shard_items=5)
    got = sorted((r["q"], r["c"]) for r in found.collect())
    assert got == sorted((q, c) for q in of if q > "i20" for c in of if c != q and of[q].keys() & of[c].keys())
    assert "Join" not in plan_of(found) and "Broadcast" not in plan_of(found)  # the plan that ran


def test_titles_of_the_catalogue_are_not_broadcast(spark, tmp_path):
    for name, rows, kind in (
        ("part", [(1, "a", "B1", "STD", 7), (2, "b", "B2", "PROMO", 3)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        ("lineitem", [(1, 1, 5, 1, 10.0, "A"), (2, 1, 6, 1, 20.0, "N"), (2, 2, 6, 2, 5.0, "R")], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"),
    ):
        stored(spark, spark.createDataFrame(rows, kind), tmp_path / f"{name}.parquet")
    d = str(tmp_path)
    movies = cu.joined_movies(b.titles(spark, d), b.ratings(spark, d), b.crew(spark, d))
    assert "Broadcast" not in plan_of(movies)
    assert [(r["tconst"], r["numVotes"], r["directors"]) for r in movies.collect()] == [("tt0000001", 2, "nm5,nm6")]


def test_items_of_the_ranking_are_not_broadcast(spark, tmp_path):
    feats = stored(spark, spark.createDataFrame([(f"i{i}", f"f{i % 7}", 1) for i in range(50)] + [(f"i{i}", "g", 1) for i in range(50)], "id string, feat string, w bigint"), tmp_path / "f")
    items = stored(spark, spark.createDataFrame([(f"i{i}", float(i % 5), f"t{i}") for i in range(50)], "id string, score double, title string"), tmp_path / "i")
    # heavy items too; only the short table of hot features may be broadcast
    found = topk_shared(feats, items, 3, hot_min_df=3, max_hot=1, queries=items.select("id"))
    joins = [line for line in plan_of(found).splitlines() if "BroadcastHashJoin" in line]
    assert joins and all("[feat#" in line and "BuildRight" in line and "q#" not in line for line in joins), joins
    titles = items.select(F.col("id").alias("tconst"), "title", "score")
    assert "Broadcast" not in plan_of(rc._resolve(titles.select("title"), titles))
