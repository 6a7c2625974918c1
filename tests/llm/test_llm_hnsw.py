"""Graph search against brute force: recall, exact scores, whole results."""

import numpy as np
import pytest

from llm_tables import VECTORS, edge_dir  # noqa: F401 - a fixture
from marquee.llm import hnsw
from marquee.llm import queries as q


def by_hand(vectors, query_ids, k):
    """Rows in order for every query id, by sums component by component."""
    good = [(i, v) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good = [(i, [float(np.float32(x)) for x in v]) for i, v in good]
    out = {}
    for qid in query_ids:
        mine = [v for i, v in good if i == qid]
        if not mine:
            continue
        mine = min(mine)
        scored = []
        for i, v in good:
            if i != qid and len(v) == len(mine):
                s = 0.0
                for a, b in zip(v, mine):
                    s += a * b
                scored.append((-s, i))
        out[qid] = [(i, -s) for s, i in sorted(scored)[:k]]
    return {a: b for a, b in out.items() if b}


def found_rows(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(found, want):
    assert {a: len(b) for a, b in found.items()} == {a: len(b) for a, b in want.items()}
    hit = sum(len({x for x, _ in found[a]} & {x for x, _ in b}) for a, b in want.items())
    return hit / sum(len(b) for b in want.values())


def test_awkward_vectors(spark, edge_dir):
    found = found_rows(q.op11_ann(spark, edge_dir))
    want = by_hand(VECTORS, [i for i, _ in VECTORS if i is not None and i % 20 == 0], 20)
    assert recall(found, want) >= 0.97
    for qid, rows in found.items():
        exact = dict(by_hand(VECTORS, [qid], len(VECTORS))[qid])
        assert all(exact[i] == s for i, s in rows), qid


@pytest.mark.parametrize("sf", ["0.001", "0.1"])
def test_recall_on_given_vectors(spark, sf):
    path = f"/root/testdata/sf{sf}"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    ids, matrix = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float32).astype(float)
    found = found_rows(q.op11_ann(spark, path))
    asked = np.flatnonzero(ids % 20 == 0)
    assert set(found) == set(ids[asked].tolist())
    hit = 0
    for a in asked:
        sims = matrix @ matrix[a]
        sims[ids == ids[a]] = -np.inf
        best = set(ids[np.lexsort((ids, -sims))[:20]].tolist())
        hit += len(best & {i for i, _ in found[ids[a]]})
        assert len(found[ids[a]]) == 20
    assert hit / (20 * len(asked)) >= 0.95


def test_recall_of_lengths_that_differ():
    """Inner products, not distances: long vectors come first."""
    rng = np.random.default_rng(4)
    matrix = rng.normal(size=(4000, 24)) * rng.gamma(2.0, 1.0, size=(4000, 1))
    draws = np.sort(rng.random(4000))
    graph = hnsw.build(hnsw.lifted(matrix), hnsw.layer_sizes(4000, draws))
    asked = rng.normal(size=(200, 24))
    unit = np.concatenate([asked / np.linalg.norm(asked, axis=1)[:, None], np.zeros((200, 1))], 1).astype(np.float32)
    found = graph.nearest(unit, 160)
    true = np.argsort(-(asked @ matrix.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(true, found)]) >= 0.95


@pytest.mark.parametrize("kind", ["clusters", "line", "few"])
def test_every_point_can_be_reached(kind):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16)) * 50
    n = 3000
    points = {"clusters": centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 16)) * 0.01, "line": np.outer(np.arange(1, n + 1), np.ones(16)), "few": rng.normal(size=(3, 16))}[kind]
    draws = np.sort(rng.random(len(points)))
    sizes = hnsw.layer_sizes(len(points), draws)
    graph = hnsw.build(hnsw.lifted(points), sizes)
    assert [len(x) for x in graph.layers] == sizes and sizes == sorted(sizes, reverse=True)
    reached, wave = {0}, [0]
    while wave:
        wave = list({int(x) for w in wave for x in graph.layers[0][w] if x >= 0} - reached)
        reached |= set(wave)
    assert len(reached) == len(points)
    for t, layer in enumerate(graph.layers):
        assert layer.max() < len(layer) and not (layer == np.arange(len(layer))[:, None]).any()
        if t:
            assert (layer[:, hnsw.LINKS + hnsw.ROOM :] < 0).all()


def test_shards_copies_and_merging(spark):
    """Several shards, a vector that a third of the rows share, repeated ids."""
    rng = np.random.default_rng(9)
    vectors = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(1200)]
    hot = rng.normal(size=8).astype(np.float32).tolist()
    vectors += [(5000 + i, hot) for i in range(600)] + [(7000, hot)] * 40 + [(20, vectors[20][1])] * 3
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").select("vec_id", hnsw.finite_vector(hnsw.F.col("embedding")).alias("v")).repartition(7)
    ids = [20, 40, 5000, 5300, 7000, 900]
    asked = table.where(hnsw.F.col("vec_id").isin(ids)).groupBy("vec_id").agg(hnsw.F.min("v").alias("v"))
    found = found_rows(hnsw.nearest_neighbours(table, asked, 20, beam=100, shard_nodes=300))
    want = by_hand(vectors, ids, 20)
    assert recall(found, want) >= 0.95
    assert found[5300] == want[5300] and found[7000] == want[7000] and found[5000] == want[5000]  # copies, smallest ids first
    again = found_rows(hnsw.nearest_neighbours(table, asked, 20, beam=100, shard_nodes=300))
    assert again == found


def test_fewer_candidates_than_asked(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, [1.0]), (5, None)]
    table = spark.createDataFrame(rows, "vec_id long, v array<double>")
    found = found_rows(hnsw.nearest_neighbours(table, table, 20))
    assert found == {1: [(2, 1.0), (3, 0.5)], 2: [(1, 1.0), (3, 0.5)], 3: [(1, 0.5), (2, 0.5)]}
    assert hnsw.nearest_neighbours(table.limit(0), table.limit(0), 20).collect() == []
