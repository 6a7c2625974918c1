"""Posting-list search: exact, and bounded for items with many hot features."""

import random

import numpy as np
import pytest

from marquee.operators.postings import Shard
from marquee.operators.similarity import topk_shared


def shard_of(vectors, lengths):
    rows = [(i, f, w) for i, v in enumerate(vectors) for f, w in v.items()]
    return Shard.of(np.array([r[0] for r in rows], int), np.array([r[1] for r in rows], dtype=str), np.array([r[2] for r in rows], np.int64), np.array(lengths, float))


def test_best_equals_brute_force():
    rnd = random.Random(2)
    for _ in range(400):
        n, k = rnd.randint(1, 60), rnd.randint(1, 12)
        vectors = [{f"f{rnd.randrange(15)}": rnd.randint(1, 3) for _ in range(rnd.randint(0, 10))} for _ in range(n)]
        lengths = [rnd.choice([1.0, 1.0, 2.0, 3.5]) for _ in range(n)]
        query = {f"f{rnd.randrange(18)}": rnd.randint(1, 3) for _ in range(rnd.randint(0, 12))}
        own = rnd.choice([None, rnd.randrange(n)])
        best, dots, _ = shard_of(vectors, lengths).best(list(query), list(query.values()), k, own, 1.0)
        want = []
        for i, v in enumerate(vectors):
            dot = sum(w * v.get(f, 0) for f, w in query.items())
            if dot and i != own:
                want.append((-(dot / lengths[i]), i, dot))
        assert list(zip(best.tolist(), dots.tolist())) == [(i, d) for _, i, d in sorted(want)[:k]]


def test_long_lists_are_not_read_once_the_result_is_sure():
    """A query of 40 features, most held by a third of all items: its like are
    found in its shorter lists, the others cost look-ups only."""
    rnd = random.Random(6)
    n = 30_000
    vectors = [{f"hot{f}": 1 for f in rnd.sample(range(40), 13)} for _ in range(n)]
    query = {f"hot{f}": 1 for f in range(40)}
    twins = rnd.sample(range(n), 25)
    for t in twins:
        vectors[t] = dict(query)
    shard = shard_of(vectors, [1.0] * n)
    total = sum(len(items) for items, _ in shard.lists.values())
    best, dots, read = shard.best(list(query), [1] * 40, 10, twins[0], 1.0)
    assert best.tolist() == sorted(twins[1:])[:10] and set(dots.tolist()) == {40}
    assert read < 0.85 * total  # half of the lists, then look-ups that get fewer
    alike = {f"hot{f}": 1 for f in range(40)} | {f"own{i}": 1 for i in range(40)}
    for t in twins:
        vectors[t] = dict(alike)
    best, dots, read = shard_of(vectors, [1.0] * n).best(list(alike), [1] * 80, 10, twins[0], 1.0)
    assert set(dots.tolist()) == {80} and read < 0.03 * total  # forty short lists settle it


@pytest.mark.parametrize("mode", ["overlap", "cosine"])
def test_heavy_items_in_the_whole_ranking(spark, mode):
    """Items of 12 to 40 hot features among light ones, rare features too."""
    rnd = random.Random(11)
    feats, items = [], []
    for i in range(260):
        n = rnd.randint(12, 40) if i % 4 == 0 else rnd.randint(0, 6)
        own = {f"h{f}" for f in rnd.sample(range(45), n)} | {f"r{rnd.randrange(200)}" for _ in range(2)}
        feats += [(f"i{i:03d}", f, rnd.randint(1, 3) if mode == "cosine" else 1) for f in sorted(own)]
        items.append((f"i{i:03d}", rnd.choice([None, 1.0, 2.0]), rnd.choice([None, "a", "b"])))
    f = spark.createDataFrame(feats, "id string, feat string, w bigint")
    it = spark.createDataFrame(items, "id string, score double, title string")
    k = 6
    got = {(r["q"], r["c"], r["rank"]) for r in topk_shared(f, it, k, mode, hot_min_df=12, max_hot=8).select("q", "c", "rank").collect()}
    of, info = {}, {i: (s, t) for i, s, t in items}
    for i, feat, w in feats:
        of.setdefault(i, {})[feat] = w
    want = set()
    for q, vq in of.items():
        ranked = []
        for c, vc in of.items():
            dot = sum(w * vc.get(x, 0) for x, w in vq.items())
            if c != q and dot:
                if mode == "overlap":
                    s, t = info[c]
                    ranked.append(((-dot, s is None, -(s or 0.0), t is None, t or "", c), c))
                else:
                    sim = dot / (np.sqrt(float(sum(w * w for w in vq.values()))) * np.sqrt(float(sum(w * w for w in vc.values()))))
                    ranked.append(((-sim, c), c))
        want |= {(q, c, n + 1) for n, (_, c) in enumerate(sorted(ranked)[:k])}
    assert got == want
