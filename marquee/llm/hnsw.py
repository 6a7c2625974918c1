"""Approximate nearest neighbours by inner product: one hierarchical
navigable small-world graph per shard.

*Index.* Equal vectors are one node with the smallest ids of its rows, as many
as a result can hold, so copies neither crowd the graph nor get lost. Nodes
are dealt to shards by a hash, and each shard's graph is built in one task of
bounded size and stored as one row of flat arrays: vectors, ids, and for every
layer a table of neighbour numbers (-1: none). The index is written to the
shared folder before it is searched.

*Graph.* Inner products order vectors as distances do once every vector has an
extra component that lifts it to the length of the longest (a query has 0
there). A node's top layer is geometric in a hash of its vector; nodes enter
from high layers to low, in batches: each searches the graph so far with a
beam of ``BUILD_BEAM``, the batch mates are compared directly, and neighbours
are chosen nearest first, leaving out those nearer to a chosen one than to the
node. Links go both ways; full lists are chosen anew. Nodes that no path from
the entry reaches are linked from a neighbour at the end, so every row can be
found.

*Search.* Query blocks meet every shard once. A block descends the layers and
ends with a beam of ``beam`` nodes in the lowest; their scores are computed
anew on the original vectors in double precision, component by component. The
best k of each shard are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import pick
from marquee.session import materialize

SHARD_NODES = 16_384
QUERY_BLOCK = 8_192
LINKS, LINKS_0 = 12, 24  # neighbours chosen in upper layers and in the lowest
ROOM = 8  # links beyond these before a list is chosen anew
BATCH = 256
BUILD_BEAM, BEAM = 80, 200
AT_ONCE = 4  # nodes of a beam that are opened in one step


def finite_vector(embedding: Column) -> Column:
    """The vector in doubles; null if it is null, empty, zero or holds a null
    or non-finite component."""
    xs = F.transform(embedding, lambda x: x.cast("double"))
    fine = F.forall(xs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine & F.exists(xs, lambda x: x != 0), xs)


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors of equal length, in single precision, in the order of inner
    products; scaled so that the longest has length 1."""
    squares = np.einsum("ij,ij->i", vectors, vectors)
    longest = squares.max(initial=0.0)
    scale = 1 / np.sqrt(longest) if longest > 0 else 1.0
    rest = np.sqrt(np.maximum(longest - squares, 0))
    return (np.concatenate([vectors, rest[:, None]], 1) * scale).astype(np.float32)


class Graph:
    """Layers of a graph over the rows of ``points``; ``layers[t]`` holds the
    neighbours of the first len(layers[t]) points."""

    def __init__(self, points: np.ndarray, layers: list[np.ndarray]):
        self.points, self.layers = points, layers

    def beam(self, queries: np.ndarray, start: np.ndarray, layer: int, size: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nearest points (numbers, products), best first, that a beam search
        in one layer finds from the points ``start`` (one row for a query; -1:
        none). Only the first ``limit`` points exist."""
        links = self.layers[layer]
        n = len(links) if limit is None else min(limit, len(links))
        total = len(queries)
        out_ids = np.full((total, size), -1, np.int64)
        out_sims = np.full((total, size), -np.inf, np.float32)
        seen = np.zeros((total, n), bool)
        turn = np.zeros((total, n), np.int32)
        rows = np.arange(total)  # queries that still have nodes to open
        ids, sims = np.full((total, size), -1, np.int64), np.full((total, size), -np.inf, np.float32)
        opened = np.ones((total, size), bool)
        row, new = np.nonzero(start >= 0)
        new = start[row, new]
        while True:
            # the points met: drop those known, and repeats
            fresh = ~seen[rows[row], new]
            row, new = row[fresh], new[fresh]
            turn[rows[row], new] = np.arange(len(new))
            once = turn[rows[row], new] == np.arange(len(new))
            row, new = row[once], new[once]
            seen[rows[row], new] = True
            count = np.bincount(row, minlength=len(rows))
            column = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            width = int(count.max(initial=0))
            more = np.full((len(rows), width), -1, np.int64)
            near = np.full((len(rows), width), -np.inf, np.float32)
            more[row, column] = new
            near[row, column] = np.einsum("ij,ij->i", self.points[new], queries[rows[row]])
            sims = np.concatenate([sims, near], 1)
            ids = np.concatenate([ids, more], 1)
            opened = np.concatenate([opened, more < 0], 1)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :size]
            sims, ids, opened = (np.take_along_axis(x, best, 1) for x in (sims, ids, opened))
            waiting = ~opened
            done = ~waiting.any(1)
            if done.any():
                out_ids[rows[done]], out_sims[rows[done]] = ids[done], sims[done]
                rows, ids, sims, opened, waiting = (x[~done] for x in (rows, ids, sims, opened, waiting))
            if not len(rows):
                return out_ids, out_sims
            chosen = waiting & (np.cumsum(waiting, 1) <= AT_ONCE)
            opened |= chosen
            row, at = np.nonzero(chosen)
            met = links[ids[row, at]]
            row, met = np.repeat(row, met.shape[1]), met.reshape(-1)
            real = (met >= 0) & (met < n)
            row, new = row[real], met[real]

    def descend(self, queries: np.ndarray, to: int, limit: int | None = None) -> np.ndarray:
        """Start points of a search in layer ``to`` (one row for a query)."""
        start = np.zeros((len(queries), 1), np.int64)
        for layer in range(len(self.layers) - 1, to, -1):
            start, _ = self.beam(queries, start, layer, 4, limit)
        return start

    def nearest(self, queries: np.ndarray, size: int) -> np.ndarray:
        if len(self.points) <= size:
            return np.broadcast_to(np.arange(len(self.points)), (len(queries), len(self.points)))
        return self.beam(queries, self.descend(queries, 0), 0, size)[0]


def chosen_links(points: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Up to ``keep`` of each row's candidates ``ids`` (best first, -1: none):
    those not nearer to a chosen one than to the row's point, then the nearest
    of the others."""
    rows, width = ids.shape
    vectors = points[np.maximum(ids, 0)]
    between = vectors @ vectors.transpose(0, 2, 1)
    taken = np.zeros((rows, width), bool)
    count = np.zeros(rows, np.int64)
    for c in range(width):
        blocked = (taken & (between[:, c, :] > sims[:, c, None])).any(1)
        now = ~blocked & (ids[:, c] >= 0) & (count < keep)
        taken[:, c] = now
        count += now
    order = np.argsort(~taken + 2 * (ids < 0), axis=1, kind="stable")[:, :keep]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, max(0, keep - width))), constant_values=-1)


def _link(graph: Graph, layer: int, mine: np.ndarray, links: np.ndarray) -> None:
    """Set the links of the new nodes ``mine`` in a layer and link back."""
    table, points = graph.layers[layer], graph.points
    keep = links.shape[1]
    table[mine, :keep] = links
    row, column = np.nonzero(links >= 0)
    target, source = links[row, column], mine[row]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    edge = np.flatnonzero(np.diff(target, prepend=-1))
    node, count = target[edge], np.diff(np.append(edge, len(target)))
    column = np.arange(len(target)) - np.repeat(edge, count)
    extra = np.full((len(node), int(count.max(initial=0))), -1, np.int64)
    extra[np.repeat(np.arange(len(node)), count), column] = source
    both = np.concatenate([table[node], extra], 1)
    # batch mates may have chosen each other: a link counts once
    both.sort(axis=1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    full = (both >= 0).sum(1) > table.shape[1]
    fits = np.argsort(both < 0, axis=1, kind="stable")[:, : table.shape[1]]
    table[node] = np.where(full[:, None], table[node], np.take_along_axis(both, fits, 1))
    over = np.flatnonzero(full)
    for at in range(0, len(over), 2 * BATCH):
        rows = over[at : at + 2 * BATCH]
        ids = both[rows]
        sims = np.einsum("ijk,ik->ij", points[np.maximum(ids, 0)], points[node[rows]])
        sims[ids < 0] = -np.inf
        best = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * table.shape[1]]
        picked = chosen_links(points, np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1), keep)
        table[node[rows]] = -1
        table[node[rows], :keep] = picked


def layer_sizes(n: int, draws: np.ndarray) -> list[int]:
    """Number of points of layers 0, 1, ...; ``draws`` are even in 0 to 1."""
    top = np.floor(-np.log(np.maximum(draws, 1e-300)) / np.log(LINKS)).astype(int)
    sizes = [n]
    while sizes[-1] > 1 and (above := int((top >= len(sizes)).sum())):
        sizes.append(above)
    return sizes


def build(points: np.ndarray, sizes: list[int]) -> Graph:
    """The graph of lifted ``points``, which come with the members of higher
    layers first."""
    room = lambda t: (LINKS_0 if t == 0 else LINKS) + ROOM
    graph = Graph(points, [np.full((size, room(t)), -1, np.int64) for t, size in enumerate(sizes)])
    done = 1
    while done < len(points):
        upto = min(done + min(BATCH, done), len(points))
        # a batch ends with a layer, so that its members share their layers
        upto = min([upto, *(s for s in sizes if s > done)])
        mine = np.arange(done, upto)
        own = points[mine]
        highest = max(t for t, size in enumerate(sizes) if done < size)
        start = graph.descend(own, highest, done)
        mates = own @ own.T
        np.fill_diagonal(mates, -np.inf)
        some = min(len(mine), LINKS_0)
        close = np.argsort(-mates, axis=1, kind="stable")[:, :some]
        found = []
        for layer in range(highest, -1, -1):
            ids, sims = graph.beam(own, start, layer, BUILD_BEAM, done)
            start = ids
            ids = np.concatenate([ids, mine[close]], 1)
            sims = np.concatenate([sims, np.take_along_axis(mates, close, 1)], 1)
            ids[~np.isfinite(sims)] = -1
            best = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * LINKS_0]
            found.append((layer, np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)))
        for layer, ids, sims in found:
            _link(graph, layer, mine, chosen_links(points, ids, sims, LINKS_0 if layer == 0 else LINKS))
        done = upto
    _reach_all(graph)
    return graph


def _reach_all(graph: Graph) -> None:
    """Link every point of the lowest layer that no path from point 0 reaches
    from one of its neighbours that a path does reach."""
    n = len(graph.points)
    reached = np.zeros(n, bool)
    wave = np.array([0])
    while True:
        while len(wave):
            reached[wave] = True
            met = graph.layers[0][wave].reshape(-1)
            wave = np.unique(met[met >= 0])
            wave = wave[~reached[wave]]
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return
        links = graph.layers[0][lost]
        known = (links >= 0) & reached[np.maximum(links, 0)]
        by = np.flatnonzero(known.any(1))
        if len(by):
            lost, via = lost[by[0]], links[by[0], known[by[0]].argmax()]
        else:
            lost, via = lost[0], 0
        table = graph.layers[0]
        free = np.flatnonzero(table[via] < 0)
        if not len(free):
            table = graph.layers[0] = np.pad(table, ((0, 0), (0, ROOM)), constant_values=-1)
            free = np.flatnonzero(table[via] < 0)
        table[via, free[0]] = lost
        wave = np.array([lost])


def nodes_of(vectors: DataFrame, keep: int) -> DataFrame:
    """(v, members): distinct vectors with their ``keep`` smallest ids and how
    often each occurs, up to ``keep`` times."""
    counted = vectors.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(keep)).alias("times"))
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = counted.withColumn("nth", nth).where(F.col("nth") <= keep)
    return few.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "times"))).alias("members"))


INDEX = "dim int, shard int, vectors binary, first binary, ids binary, layers array<struct<width:int,links:binary>>"


def build_index(vectors: DataFrame, keep: int, shard_nodes: int = SHARD_NODES) -> tuple[DataFrame, int]:
    """One row per shard (see ``INDEX``) over all rows of (vec_id, v), written
    to the shared folder, and the number of shards. Results of up to ``keep``
    - 1 rows can be read off."""
    nodes = materialize(nodes_of(vectors, keep), "ann-nodes")
    shards = max(1, -(-nodes.count() // shard_nodes))
    dealt = nodes.withColumns({"dim": F.size("v"), "hash": F.xxhash64("v")}).withColumn("shard", F.pmod("hash", F.lit(shards)).cast("int"))

    def work(table: pa.Table) -> pa.Table:
        dim, shard = table["dim"][0].as_py(), table["shard"][0].as_py()
        matrix = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        draws = (table["draw"].to_numpy().astype(np.float64) + 0.5) / 2**31
        order = np.lexsort((table["hash"].to_numpy(), draws))  # small draws have the high layers
        matrix = np.ascontiguousarray(matrix[order])
        graph = build(lifted(matrix), layer_sizes(len(matrix), draws))
        members = table["members"].combine_chunks().take(pa.array(order))
        flat = members.flatten()
        times = flat.field("times").to_numpy()
        ids = np.repeat(flat.field("vec_id").to_numpy(), times)
        bounds = members.offsets.to_numpy() - members.offsets[0].as_py()
        first = np.concatenate([[0], np.cumsum(times)])[bounds]
        row = {
            "dim": dim, "shard": shard, "vectors": matrix.astype("<f8").tobytes(), "first": first.astype("<i8").tobytes(), "ids": ids.astype("<i8").tobytes(),
            "layers": [{"width": x.shape[1], "links": x.astype("<i4").tobytes()} for x in graph.layers],
        }
        return pa.Table.from_pylist([row], schema=table_schema)

    table_schema = pa.schema([
        ("dim", pa.int32()), ("shard", pa.int32()), ("vectors", pa.binary()), ("first", pa.binary()), ("ids", pa.binary()),
        ("layers", pa.list_(pa.struct([("width", pa.int32()), ("links", pa.binary())]))),
    ])
    draw = F.shiftrightunsigned(F.xxhash64(F.col("hash"), F.lit(11)), 33)
    one = dealt.withColumn("draw", draw).groupBy("dim", "shard").applyInArrow(work, INDEX)
    return materialize(one, "ann-index"), shards


def scores(matrix: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed component by component."""
    out = np.zeros(ids.shape)
    for c in range(matrix.shape[1]):
        out += matrix[ids, c] * queries[:, c, None]
    return out


def search_block(index: dict, asked: np.ndarray, queries: np.ndarray, k: int, beam: int) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, score) of the best k in one shard for each query."""
    dim = index["dim"]
    matrix = np.frombuffer(index["vectors"], "<f8").reshape(-1, dim)
    first, ids = np.frombuffer(index["first"], "<i8"), np.frombuffer(index["ids"], "<i8")
    layers = [np.frombuffer(x["links"], "<i4").reshape(-1, x["width"]) for x in index["layers"]]
    graph = Graph(lifted(matrix), layers)
    out = []
    for at in range(0, len(asked), BATCH):
        q = queries[at : at + BATCH]
        plain = np.concatenate([q / np.sqrt(np.einsum("ij,ij->i", q, q))[:, None], np.zeros((len(q), 1))], 1).astype(np.float32)
        found = graph.nearest(plain, max(beam, k + 1))
        score = scores(matrix, np.maximum(found, 0), q)
        score[found < 0] = -np.inf
        for r in range(len(q)):
            s = score[r]
            edge = np.partition(s, -(k + 1))[-(k + 1)] if len(s) > k else -np.inf
            near = np.flatnonzero((s >= edge) & (found[r] >= 0))
            lo, hi = first[found[r][near]], first[found[r][near] + 1]
            vec = np.concatenate([ids[a:b] for a, b in zip(lo, hi)]) if len(near) else np.empty(0, np.int64)
            of = np.repeat(s[near], hi - lo)
            other = vec != asked[at + r]
            vec, of = vec[other], of[other]
            best = np.lexsort((vec, -of))[:k]
            out += [(int(asked[at + r]), int(v), float(x)) for v, x in zip(vec[best], of[best])]
    return out


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int, beam: int = BEAM, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(query_id, rank, vec_id, score): about the k members of largest inner
    product for every query (approximate: recall grows with ``beam``), nearest
    first, ties to the smaller vec_id; all candidates if there are fewer.

    Both tables: (vec_id, v) with v array<double> without nulls. Rows with a
    null id or vector take no part. A query meets members of its own dimension
    except those with its own id; repeated rows count each; queries must have
    distinct ids. Scores are exact products of the original vectors.
    """
    usable = lambda df: pick(df, "vec_id", "v").where("vec_id is not null and v is not null and size(v) > 0").select(F.col("vec_id").cast("long"), "v")
    index, shards = build_index(usable(vectors), k + 1, shard_nodes)
    asked = materialize(usable(queries).withColumn("dim", F.size("v")), "ann-queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                of_dim = batch.take(pa.array(np.flatnonzero(dims == dim)))
                ids = of_dim.column(0).to_numpy().astype("<i8").tobytes()
                values = of_dim.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes()
                yield pa.RecordBatch.from_pylist([{"dim": dim, "q_ids": ids, "q": values}], schema=pa.schema([("dim", pa.int32()), ("q_ids", pa.binary()), ("q", pa.binary())]))

    packed = asked.repartition(blocks).mapInArrow(pack, "dim int, q_ids binary, q binary")
    dealt = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    met = index.join(dealt, ["dim", "shard"]).select(*index.columns, "q_ids", "q")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                ids, values = np.frombuffer(one["q_ids"], "<i8"), np.frombuffer(one["q"], "<f8").reshape(-1, one["dim"])
                best = search_block(one, ids, values, k, beam)
                yield pa.RecordBatch.from_arrays([pa.array([b[c] for b in best], t) for c, t in enumerate(schema.types)], schema=schema)

    best = met.mapInArrow(work, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


__all__ = ["build_index", "finite_vector", "nearest_neighbours"]
