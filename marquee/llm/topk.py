"""Exact inner-product search by the threshold algorithm of Fagin.

Vectors are packed into blocks; each block carries its members sorted along
every dimension. For a query the lists are read from their best end (the top
for a positive component, the bottom for a negative one). The value at a
list's place times the query's component bounds what any unseen member can
gain in that dimension, so the sum over the dimensions bounds its score. In
each round the lists are read whose next entries lower that bound most; newly
met members are scored in full; reading stops when the bound cannot beat the
k-th best result (with equal scores the smaller id wins, so it must be below).

Every block of queries meets every block of members once (a stated query set
against all rows): blocks are dealt to shards by a hash, queries go to all
shards. A task keeps the queries of its shard and streams the shard's blocks
past them one after the other; nothing is joined or broadcast. What the earlier
blocks yielded is the threshold of the next: a block whose members all score
less is left as soon as its lists show it. Beyond ``GROUP`` queries they are
dealt to groups, and each group meets all members. Only the best k of a query
leave a shard, and are ranked per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import pick

MEMBERS, QUERIES = 8_192, 512  # rows of a block
GROUP = 32_768  # queries that a task keeps, about
STEP, GROWTH = 32, 4  # entries of a list read at once: so many, or this part of those read
LISTS = 4  # the part of the lists that is read in a round


def quantized(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of every component as a double; null for a vector
    that is null or holds a null or non-finite component."""
    xs = F.transform(embedding, lambda x: x.cast("double"))
    finite = F.forall(xs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(xs, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def _matrix(column: pa.ListArray, rows: list[int], dim: int) -> np.ndarray:
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(len(rows), dim)


def packed(vectors: DataFrame, rows: int, lists: bool) -> DataFrame:
    """Blocks of at most ``rows`` vectors of one dimension as single rows:
    (dim, ids, matrix, lists), little-endian binary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, m = (np.concatenate(x) for x in zip(*held.pop(dim)))
            order = np.argsort(m, axis=0, kind="stable").T.astype("<i4").tobytes() if lists else b""
            return pa.RecordBatch.from_pylist([{"dim": dim, "ids": ids.astype("<i8").tobytes(), "matrix": m.astype("<i8").tobytes(), "lists": order}])

        for batch in batches:
            ids, vs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1)
            dims = np.array([len(v) for v in vs.to_pylist()], np.int64) if len(ids) else ids
            for dim in np.unique(dims).tolist():
                of_dim = np.flatnonzero(dims == dim)
                while len(of_dim):
                    room = rows - sum(len(x) for x, _ in held.get(dim, []))
                    now, of_dim = of_dim[:room], of_dim[room:]
                    held.setdefault(dim, []).append((ids[now], _matrix(vs, now.tolist(), dim)))
                    if len(now) == room:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return vectors.mapInArrow(work, "dim bigint, ids binary, matrix binary, lists binary")


@dataclass
class Best:
    """The k best (score, id) of a query so far, and what finding them took."""

    k: int
    scores: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    read: int = 0  # list entries
    scored: int = 0  # members

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.ids) >= self.k:
            near = scores >= self.scores[-1]
            scores, ids = scores[near], ids[near]
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]

    def out_of_reach(self, bound: int) -> bool:
        return len(self.ids) >= self.k and bound < int(self.scores[-1])


def threshold_search(query: np.ndarray, own: int, ids: np.ndarray, matrix: np.ndarray, lists: np.ndarray, best: Best) -> None:
    """Put what one block adds to the k best of a query into ``best``; members
    with the query's own id take no part.

    ``matrix``: members by dimension; ``lists``: positions by ascending value,
    one row per dimension. Integer arithmetic throughout.
    """
    n = len(ids)
    used = np.flatnonzero(query)
    if not len(used):  # every score is 0: the smallest ids are best
        few = np.sort(ids[ids != own])[: best.k]
        best.add(np.zeros(len(few), np.int64), few)
        best.scored += len(few)
        return
    weight = query[used]
    down = weight < 0
    seen = ids == own
    depth = np.zeros(len(used), np.int64)  # entries read of each list

    def gains(at: np.ndarray) -> np.ndarray:
        """Most that the entry at place ``at`` of each list, or any after it, gains."""
        at = np.minimum(at, n - 1)
        return weight * matrix[lists[used, np.where(down, at, n - 1 - at)], used]

    step = np.full(len(used), STEP)
    now, ahead = gains(depth), gains(depth + step)
    some = max(1, len(used) // LISTS)
    while not best.out_of_reach(int(now.sum())):
        fall = (now - ahead) / step  # of the bound, for each entry
        chosen = np.argpartition(-fall, some - 1)[:some]
        if not (now[chosen] > ahead[chosen]).any():  # the values beside are alike: the list read least
            chosen = depth.argmin(keepdims=True)
        fresh = np.zeros(n, bool)
        for t in chosen.tolist():
            a, b = int(depth[t]), min(int(depth[t] + step[t]), n)
            entries = lists[used[t], a:b] if down[t] else lists[used[t], n - b : n - a]
            fresh[entries] = True
            best.read += b - a
            depth[t] = b
        met = np.flatnonzero(fresh & ~seen)
        if len(met):
            seen[met] = True
            best.scored += len(met)
            best.add(matrix[met] @ query, ids[met])
        if depth[chosen].max() == n:  # a list is read to its end: all members are met
            return
        step = np.maximum(STEP, depth // GROWTH)
        now[chosen], ahead[chosen] = gains(depth)[chosen], gains(depth + step)[chosen]


def top_k(vectors: DataFrame, queries: DataFrame, k: int, shards: int | None = None, accesses: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k members of highest inner product
    for every query, ties to the smaller vec_id; fewer if there are fewer.

    Both tables: (vec_id, v) with v array<bigint>. Rows with a null id or
    vector take no part; a query meets members of its own dimension, except
    those with its own id. Repeated members count each; queries must have
    distinct ids. Inner products must fit 64 bits.

    With ``accesses`` two more columns tell what the lists of all shards took
    for the query: ``entries_read`` and ``members_scored``.
    """
    spark = vectors.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    usable = lambda df: pick(df, "vec_id", "v").where("vec_id is not null and v is not null and size(v) > 0")
    members = packed(usable(vectors).select(F.col("vec_id").cast("long"), "v"), MEMBERS, True)
    members = members.withColumn("shard", F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int"))
    asks = usable(queries).select(F.col("vec_id").cast("long"), "v")
    # how many groups, as a scalar subquery: one small count beside the plan
    groups = asks.agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(GROUP)), F.lit(1)).cast("int").alias("n")).scalar()
    asked = packed(asks, QUERIES, False).withColumn("grp", F.pmod(F.xxhash64("ids"), groups).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = asked.withColumns({"shard": every(F.lit(shards)), "member": F.lit(False)})
    members = members.withColumns({"grp": every(groups), "member": F.lit(True)})
    met = members.unionByName(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "dim", "grp", "member")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "vec_id", "score", "shard", "read", "scored"]
        held: tuple | None = None
        found: list[tuple[int, np.ndarray, Best]] = []

        def results() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(found), QUERIES):
                some = found[at : at + QUERIES]
                n = [len(b.ids) for _, _, b in some]
                per_query = ([q for q, _, _ in some], [held[0]] * len(some), [b.read for _, _, b in some], [b.scored for _, _, b in some])
                q, shard, read, scored = (np.repeat(np.array(x, np.int64), n) for x in per_query)
                ids, scores = (np.concatenate(x) for x in ([b.ids for _, _, b in some], [b.scores for _, _, b in some]))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q, ids, scores, shard, read, scored)], names=names)

        for batch in batches:
            for row in range(batch.num_rows):
                shard, dim, grp, member = (batch.column(c)[row].as_py() for c in range(4))
                if held != (shard, dim, grp):
                    yield from results()
                    held, found = (shard, dim, grp), []
                if member and not found:
                    continue
                ids, matrix, lists = (batch.column(c)[row].as_buffer() for c in range(4, 7))
                ids, matrix = np.frombuffer(ids, "<i8"), np.frombuffer(matrix, "<i8").reshape(-1, dim)
                if not member:  # they come first, and outlive the batch
                    found += [(q, v, Best(k)) for q, v in zip(ids.tolist(), matrix.copy())]
                    continue
                lists = np.frombuffer(lists, "<i4").reshape(dim, -1)
                for q, v, best in found:
                    threshold_search(v, q, ids, matrix, lists, best)
        yield from results()

    columns = ["shard", "dim", "grp", "member", "ids", "matrix", "lists"]
    best = met.select(*columns).mapInArrow(work, "query_id bigint, vec_id bigint, score bigint, shard bigint, read bigint, scored bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    if not accesses:
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select("query_id", "rank", "vec_id", "score")
    # a shard's figures stand in each of its rows: count them once
    per = Window.partitionBy("query_id")
    first = F.row_number().over(Window.partitionBy("query_id", "shard").orderBy("vec_id")) == 1
    once = best.withColumn("first", first)
    once = once.withColumns({n: F.sum(F.when(F.col("first"), F.col(c)).otherwise(0)).over(per) for n, c in (("entries_read", "read"), ("members_scored", "scored"))})
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", "entries_read", "members_scored")
