"""Threshold search: exact, stopped by its bound, threshold kept over blocks."""

import numpy as np
from pyspark.sql import functions as F

from marquee.llm import queries as q
from marquee.llm import topk


def by_hand(vectors, ids, query, own, k):
    return sorted((-int(s), int(i)) for s, i in zip(vectors @ query, ids) if i != own)[:k]


def search(blocks, ids, query, own, k):
    best = topk.Best(k)
    at = 0
    for m in blocks:
        topk.threshold_search(query, own, ids[at : at + len(m)], m, np.argsort(m, axis=0, kind="stable").T, best)
        at += len(m)
    return best


def test_any_small_block_is_exact():
    """Ties, repeated ids and rows, zeros, signs, several blocks."""
    rng = np.random.default_rng(1)
    for _ in range(600):
        n, d, k = int(rng.integers(1, 300)), int(rng.integers(1, 9)), int(rng.integers(1, 12))
        members, ids = rng.integers(-4, 5, (n, d)), rng.integers(0, 80, n)
        query, own = rng.integers(-3, 4, d), int(rng.integers(0, 80))
        best = search([b for b in np.array_split(members, int(rng.integers(1, 5))) if len(b)], ids, query, own, k)
        assert list(zip((-best.scores).tolist(), best.ids.tolist())) == by_hand(members, ids, query, own, k)


def skewed(n=6000, d=24, seed=5):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * np.exp(-np.arange(d) / 3) * 1024).astype(np.int64)


def test_the_bound_ends_the_search():
    """Where a few dimensions decide, most entries are never read and most
    members never scored; there is no other way to the result."""
    members, ids = skewed(), np.arange(6000)
    read = scored = 0
    for own in range(0, 400, 20):
        best = search([members], ids, members[own], own, 10)
        assert list(zip((-best.scores).tolist(), best.ids.tolist())) == by_hand(members, ids, members[own], own, 10)
        read, scored = read + best.read, scored + best.scored
    assert read < 0.05 * 20 * members.size and scored < 0.5 * 20 * len(members)


def test_the_threshold_of_earlier_blocks_stops_later_ones():
    members, ids = skewed(), np.arange(6000)
    query = members[17]
    best_first = members[np.argsort(-(members @ query))]
    blocks = np.array_split(best_first, 6)
    together = search(blocks, ids, query, -1, 10)
    alone = [search([b], ids, query, -1, 10) for b in blocks]
    assert together.scored < 0.6 * sum(b.scored for b in alone) and together.read < 0.6 * sum(b.read for b in alone)


def test_accesses_of_all_shards_are_told(spark):
    members = skewed(2000, 8)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(members.tolist())], "vec_id long, v array<bigint>").repartition(6)
    asked = table.where("vec_id % 500 = 0")
    rows = topk.top_k(table, asked, 5, shards=3, accesses=True).collect()
    plain = topk.top_k(table, asked, 5, shards=3).collect()
    key = lambda r: (r["query_id"], r["rank"], r["vec_id"], r["score"])
    assert sorted(map(key, rows)) == sorted(map(key, plain)) and len(rows) == 20
    for own in range(0, 2000, 500):
        mine = [r for r in rows if r["query_id"] == own]
        assert [(-r["score"], r["vec_id"]) for r in sorted(mine, key=lambda r: r["rank"])] == by_hand(members, np.arange(2000), members[own], own, 5)
        assert len({(r["entries_read"], r["members_scored"]) for r in mine}) == 1
        assert 5 <= mine[0]["members_scored"] <= 1999 and mine[0]["entries_read"] <= 8 * 2000


def test_given_vectors_go_through_the_lists(spark):
    path = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{path}/embeddings.parquet")
    v = rows.select("vec_id", topk.quantized(F.col("embedding"), 1024).alias("v"))
    found = topk.top_k(v, v.where("vec_id % 100 = 0"), 10, accesses=True).collect()
    assert all(r["entries_read"] > 0 for r in found)
    want = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in q.op9_topk(spark, path).collect()}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found} == want
