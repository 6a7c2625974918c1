"""Exact top-k over sparse weighted features by bounded posting lists.

For items with too many frequent features to enumerate (see ``similarity``),
where a join on the features would make ``query features x document
frequency`` pairs. Here no pair leaves a task unless it is among the best k of
its shard:

* candidates are dealt to shards of bounded size by a hash; a shard holds, for
  each of its features, the posting list (candidates in order of their ties,
  weights) and its largest weight: what the feature can add at most;
* queries come in blocks to every shard, by an exchange: a task builds a shard
  once and streams the blocks past it. They are not joined, because copies for
  every shard look as small to Spark as one, and would be broadcast through the
  driver. A query reads its lists from the
  shortest on and adds up. Once the k-th best sum so far is more than all
  unread lists together can add, a candidate met in none of the lists read
  cannot be among the best k: the long lists that are left are no longer read,
  only looked up (binary search) for candidates that can still reach the k-th
  sum, which get fewer with every list;
* of a query, a shard yields its exact best k.

The work of a query in a shard is the length of its shorter lists plus a few
look-ups in the others; what crosses the network is every shard once, the
queries once per shard, and k rows per query and shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_ITEMS = 8_192
QUERY_BLOCK = 1_024
TIE = 1e-9  # on sums of normalised weights; their order is decided on exact values


@dataclass
class Shard:
    """Posting lists of a shard. Items are numbered in order of their ties;
    ``length`` is the divisor of an item's sums (1 for plain overlap)."""

    lists: dict[str, tuple[np.ndarray, np.ndarray]]
    length: np.ndarray

    @classmethod
    def of(cls, item: np.ndarray, feat: np.ndarray, weight: np.ndarray, length: np.ndarray) -> Shard:
        order = np.lexsort((item, feat))
        item, feat, weight = item[order], feat[order], weight[order]
        edge = np.flatnonzero(np.r_[True, feat[1:] != feat[:-1]]) if len(feat) else np.empty(0, int)
        ends = np.r_[edge[1:], len(feat)]
        return cls({str(feat[a]): (item[a:b], weight[a:b]) for a, b in zip(edge, ends)}, length)

    def best(self, feats: list[str], weights: list[int], k: int, own: int | None, scale: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(items, exact sums of products, entries read): the k items of
        largest ``sum / (scale * length)``, ties in item order, ``own`` left
        out; items without a common feature take no part."""
        used = [(len(self.lists[f][0]), f, w) for f, w in zip(feats, weights) if f in self.lists]
        used.sort()
        n = len(self.length)
        dots = np.zeros(n, np.int64)
        met = np.zeros(n, bool)
        most = [w * float((self.lists[f][1] / self.length[self.lists[f][0]]).max()) for _, f, w in used]
        left = np.r_[np.cumsum(most[::-1])[::-1], 0.0]  # what lists i and later can add
        read, done = 0, 0
        for i, (size, f, w) in enumerate(used):
            items, ws = self.lists[f]
            dots[items] += w * ws
            met[items] = True
            read, done = read + size, i + 1
            if own is not None:
                met[own] = False
            some = np.flatnonzero(met)
            if len(some) >= k:
                kth = np.partition(dots[some] / self.length[some], len(some) - k)[len(some) - k]
                if kth > left[done] + TIE:
                    break
        some = np.flatnonzero(met)
        for i in range(done, len(used)):
            sums = dots[some] / self.length[some]
            if len(some) > k:  # who cannot reach the k-th sum is dropped
                kth = np.partition(sums, len(some) - k)[len(some) - k]
                some = some[sums + left[i] >= kth - TIE]
            items, ws = self.lists[used[i][1]]
            at = np.minimum(np.searchsorted(items, some), len(items) - 1)
            here = items[at] == some
            dots[some[here]] += used[i][2] * ws[at[here]]
            read += len(some)
        final = dots[some] / (scale * self.length[some])
        order = np.lexsort((some, -final))[:k]
        return some[order], dots[some[order]], read


def _tie_order(rows: list[dict], mode: str) -> list[int]:
    if mode == "cosine":
        return sorted(range(len(rows)), key=lambda i: rows[i]["c"])
    score = lambda r: (r["score"] is None, -(r["score"] or 0.0))
    title = lambda r: (r["title"] is None, r["title"] or "")
    return sorted(range(len(rows)), key=lambda i: (score(rows[i]), title(rows[i]), rows[i]["c"]))


def best_by_postings(queries: DataFrame, candidates: DataFrame, k: int, mode: str, n_queries: Column, n_candidates: Column, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``q, c``: for every query the best k candidates of every shard by the
    products of their feature vectors (``cosine``: divided by both lengths),
    ties by score, title and id (``cosine``: id). Candidates without a common
    feature and a query's own id are left out.

    ``queries``: (q, n2, hv); ``candidates``: (c, n2, hv) and for ``overlap``
    score and title; ``hv`` is array<struct<feat, w>>, ``n2`` the squared
    length over all features of the item. ``n_queries`` and ``n_candidates``:
    about how many there are (columns, such as scalar subqueries).
    """
    parts = lambda n, size: F.greatest(F.ceil(n / size), F.lit(1)).cast("int")
    shards, blocks = parts(n_candidates, shard_items), parts(n_queries, QUERY_BLOCK)
    extra = ["score", "title"] if mode == "overlap" else []
    packed = candidates.withColumn("shard", F.pmod(F.xxhash64("c"), shards).cast("int"))
    packed = packed.groupBy("shard").agg(F.collect_list(F.struct("c", "n2", "hv", *extra)).alias("items"))  # about shard_items rows
    asked = queries.select(F.struct("q", "n2", "hv").alias("query"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query.q"), blocks).cast("int"))
    asked = asked.groupBy("block").agg(F.collect_list("query").alias("asked"))  # about QUERY_BLOCK rows
    asked = asked.select(F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"), "asked")
    met = packed.unionByName(asked, allowMissingColumns=True).select("shard", "items", "asked")
    met = met.repartition("shard").sortWithinPartitions("shard", F.col("items").isNull())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: int | None = None
        for batch in batches:
            for r in range(batch.num_rows):
                at, rows, asks = (batch.column(c)[r].as_py() for c in range(3))
                if rows is not None:  # the shard comes before the queries
                    held, rows = at, [rows[i] for i in _tie_order(rows, mode)]
                    item = np.repeat(np.arange(len(rows)), [len(x["hv"]) for x in rows])
                    feat = np.array([f["feat"] for x in rows for f in x["hv"]], dtype=object)
                    weight = np.array([f["w"] for x in rows for f in x["hv"]], np.int64)
                    length = np.sqrt(np.array([x["n2"] if mode == "cosine" else 1 for x in rows], float))
                    shard, names = Shard.of(item, feat.astype(str), weight, length), [x["c"] for x in rows]
                    place = {c: i for i, c in enumerate(names)}
                    continue
                if held != at:  # a shard without candidates
                    continue
                out_q, out_c = [], []
                for ask in asks:
                    scale = float(np.sqrt(ask["n2"])) if mode == "cosine" else 1.0
                    best, _, _ = shard.best([f["feat"] for f in ask["hv"]], [f["w"] for f in ask["hv"]], k, place.get(ask["q"]), scale)
                    out_q += [ask["q"]] * len(best)
                    out_c += [names[i] for i in best.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.string()), pa.array(out_c, pa.string())], names=["q", "c"])

    return met.mapInArrow(work, "q string, c string")


__all__ = ["Shard", "best_by_postings"]
