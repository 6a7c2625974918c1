"""Approximate vector top-k over an inverted file of coarse lists.

``vector_topk`` (the exact route) compares every query with every vector.
Here vectors are dealt to lists of similar direction, a query looks into a few
lists only, and what it finds there is ranked exactly:

1. *Fit.* Spherical k-means, seeded, on the ``sample_rows`` rows that come
   first in a hash of their ids: a bounded sample (a documented parameter), so
   it is fitted in one place; every row is routed.
2. *Probes.* Unless given, the number of lists that a query looks into is
   calibrated on the same sample: the fewest with which the sample's own
   neighbours are found at ``target_recall``. Clustered vectors need few,
   evenly spread ones many.
3. *Route.* Members go to their nearest list, queries to their ``probes``
   nearest lists; the list centres are the only data sent to all tasks
   (``max_lists`` rows).
4. *Scan.* Queries are dealt to groups by their nearest list, long lists cut
   by a random number that is written with the row. A group goes to one task,
   which keeps its queries and streams past them, once, the members of every
   list that any of them looks into (``_scan_lists``); a list's members are
   multiplied with just the queries that look into it. k rows per query leave
   the task.
5. *Rest.* Queries whose lists hold fewer than k others are answered by the
   exact route, so a result is never shorter than the exact one.

What crosses the network is every query once (with one bit per list), every
member once per group that looks into its list, and k rows per query. Groups
are two per core and more only beyond ``group_rows`` queries each, so up to
that point a member's copies don't grow with the rows; where queries look into
few lists they stay below ``probes`` and the cuts of long lists beyond it. The
products grow as the rows times the members of the lists that a query looks
into: a fixed share of all where vectors are evenly spread. Lists grow in
number with the rows, up to ``max_lists``; beyond ``max_lists * list_rows``
rows they get longer; raise ``max_lists`` there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.operators.vectors import (
    _OUT_SCHEMA,
    _STRIP,
    DEFAULT_K,
    GROUP_ROWS,
    _Best,
    _chunks,
    _length,
    _parts,
    _unit32,
    _without_spare_copies,
    query_groups,
    vector_topk,
)
from marquee.session import materialize

SAMPLE_ROWS = 16_384
LIST_ROWS = 1_024
QUERY_ROWS = 1_024  # queries of a group at least, while there are not two groups per core
MAX_LISTS = 16_384
TARGET_RECALL = 0.95
ROUNDS = 12


@dataclass(frozen=True)
class CoarseLists:
    """Centres of the lists (unit vectors) and how many of them to look into."""

    centres: np.ndarray
    probes: int


def _prepared(vectors: DataFrame) -> DataFrame:
    """id, embedding (floats stay floats, else doubles), score, title of rows
    that have a direction."""
    cols = vectors.columns
    single = dict(vectors.dtypes)["embedding"] == "array<float>"  # exact in half the bytes
    v = vectors.select(
        F.col("id").cast("string").alias("id"),
        F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"),
        (F.col("score").cast("double") if "score" in cols else F.lit(None).cast("double")).alias("score"),
        (F.col("title").cast("string") if "title" in cols else F.lit(None).cast("string")).alias("title"),
    )
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("id").isNotNull() & whole & F.exists("embedding", lambda x: x != 0))


def _unit(rows) -> np.ndarray:
    m = np.vstack([np.asarray(r, dtype=np.float64) for r in rows])
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _centres(sample: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Spherical k-means: start at random rows, move each centre to the mean
    direction of its rows; a centre left without rows takes the row that is
    worst served."""
    rng = np.random.default_rng(seed)
    centres = sample[np.sort(rng.permutation(len(sample))[:lists])]
    for _ in range(ROUNDS):
        served = sample @ centres.T
        nearest = served.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        empty = np.flatnonzero(np.bincount(nearest, minlength=len(centres)) == 0)
        worst = np.argsort(served.max(axis=1), kind="stable")[: len(empty)]
        sums[empty] = sample[worst]
        length = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-300)[:, None], centres)
    return centres


def _probes(sample: np.ndarray, centres: np.ndarray, k: int, target: float, seed: int) -> int:
    """Fewest lists in which a sample of queries finds ``target`` of its k
    nearest rows of the sample."""
    rng = np.random.default_rng(seed + 1)
    asked = rng.permutation(len(sample))[:256]
    similar = sample[asked] @ sample.T
    similar[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1
    best = np.argpartition(-similar, k - 1, axis=1)[:, :k]
    home = (sample @ centres.T).argmax(axis=1)
    order = np.argsort(-(sample[asked] @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    needed = np.sort(np.take_along_axis(place, home[best], axis=1).reshape(-1)) + 1
    return int(needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)])


def fit_lists(
    vectors: DataFrame,
    lists: int | None = None,
    probes: int | None = None,
    k: int = DEFAULT_K,
    target_recall: float = TARGET_RECALL,
    sample_rows: int = SAMPLE_ROWS,
    list_rows: int = LIST_ROWS,
    max_lists: int = MAX_LISTS,
    seed: int = 7,
) -> CoarseLists | None:
    """Lists for ``id, embedding``; None if there is no vector with a direction."""
    v = _prepared(vectors)
    n = v.count()
    if not n:
        return None
    first = v.select("embedding", F.xxhash64("id", F.lit(seed)).alias("h"), "id").orderBy("h", "id").limit(sample_rows)
    sample = _unit(first.select("embedding").toPandas()["embedding"])
    wanted = lists or max(math.ceil(n / list_rows), round(math.sqrt(n)))
    centres = _centres(sample, max(1, min(wanted, max_lists, len(sample))), seed)
    return CoarseLists(centres, min(len(centres), probes or _probes(sample, centres, k, target_recall, seed)))


def _nearest(rows, centres: np.ndarray, n: int) -> np.ndarray:
    """Numbers of each row's ``n`` nearest lists, nearest first."""
    near = -(_unit(rows) @ centres.T)
    if n < near.shape[1]:
        some = np.argpartition(near, n - 1, axis=1)[:, :n]
        order = np.argsort(np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
        return np.take_along_axis(some, order, axis=1).astype(np.int32)
    return np.argsort(near, axis=1, kind="stable").astype(np.int32)


def nearest_lists(embedding: F.Column, fitted: CoarseLists, n: int) -> F.Column:
    """Numbers of the ``n`` nearest lists, nearest first."""
    centres = fitted.centres

    @F.pandas_udf("array<int>")
    def route(column: pd.Series) -> pd.Series:
        return pd.Series([] if column.empty else list(_nearest(column, centres, n)), dtype=object)

    return route(embedding)


def _looks_into(embedding: F.Column, fitted: CoarseLists) -> F.Column:
    """Struct ``home`` (the nearest list), ``seen`` (one bit per list, set for
    the ``probes`` nearest)."""
    centres, probes = fitted.centres, fitted.probes

    @F.pandas_udf("home int, seen binary")
    def route(column: pd.Series) -> pd.DataFrame:
        if column.empty:
            return pd.DataFrame({"home": pd.Series([], dtype="int32"), "seen": pd.Series([], dtype=object)})
        lists = _nearest(column, centres, probes)
        bits = np.zeros((len(lists), len(centres)), bool)
        np.put_along_axis(bits, lists, True, axis=1)
        return pd.DataFrame({"home": lists[:, 0], "seen": [b.tobytes() for b in np.packbits(bits, axis=1)]})

    return route(embedding)


def _bits(seen: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(seen), np.uint8).reshape(len(seen), -1)


def _lists_of_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """The lists that any query of a group looks into."""
    lists = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(_bits(pdf["seen"].tolist()), axis=0)))
    return pd.DataFrame({"grp": np.full(len(lists), pdf["grp"].iloc[0], np.int32), "list": lists.astype(np.int32)})


class _Looking(_Best):
    """The best ``k`` so far of a group of queries that look into some lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, seen: np.ndarray):
        super().__init__(ids, vectors, k)
        self.seen = np.ascontiguousarray(seen.T)
        self.held, self.pairs = [], 0
        self.most = max(1 << 16, k * len(ids))  # pairs that are held before the best are kept

    def look(self, lists: np.ndarray, cids: np.ndarray, vectors: np.ndarray, score: np.ndarray, title: np.ndarray) -> None:
        """Take in members, sorted by their lists."""
        if vectors.shape[1] != self.v.shape[1]:
            raise ValueError("vectors differ in length")
        length = _length(vectors)
        unit = _unit32(vectors, length)
        # squares and products of such lengths neither overflow nor vanish
        tame = all(((x > 1e-140) & (x < 1e140)).all() for x in (length, self.length))
        own_q, own_c = self._own(cids)
        edges = np.flatnonzero(np.diff(lists)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(lists)]):
            asked = np.flatnonzero(self.seen[lists[a] >> 3] & (128 >> (int(lists[a]) & 7)))
            if not len(asked):
                continue
            at = a + _without_spare_copies(cids[a:b], vectors[a:b], score[a:b], title[a:b], self.k)
            lo, hi = np.searchsorted(own_c, [a, b])
            oq, oc = np.searchsorted(asked, own_q[lo:hi]), np.searchsorted(at, own_c[lo:hi])
            met = (oq < len(asked)) & (oc < len(at))
            met[met] = (asked[oq[met]] == own_q[lo:hi][met]) & (at[oc[met]] == own_c[lo:hi][met])
            self._multiply(asked, at, oq[met], oc[met], unit[at].T.copy(), tame, cids, vectors, length, score, title)

    def _multiply(self, asked, at, oq, oc, unit, tame, cids, vectors, length, score, title) -> None:
        """``asked`` queries with the members in places ``at``; ``oq, oc``: the
        pairs of these that are of one id."""
        by_q = np.argsort(oq, kind="stable")
        oq, oc = oq[by_q], oc[by_q]
        for a in range(0, len(asked), _STRIP):
            strip = asked[a : a + _STRIP]
            near = self.unit[strip] @ unit
            lo, hi = np.searchsorted(oq, [a, a + len(strip)])
            near[oq[lo:hi] - a, oc[lo:hi]] = -np.inf
            least = self.least[strip]
            fresh = np.flatnonzero(~np.isfinite(least)) if tame and len(at) > self.k else []
            if len(fresh):
                kth = np.partition(near[fresh], len(at) - self.k, axis=1)[:, len(at) - self.k]
                least[fresh] = kth - np.float32(2 * self.margin)
                self.least[strip] = least
            flat = np.flatnonzero(near >= least[:, None])
            rows, cols = flat // len(at), flat % len(at)
            if lo < hi or not tame:
                real = np.isfinite(near[rows, cols])
                rows, cols = rows[real], cols[real]
            if not len(rows):
                continue
            for i in range(0, len(rows), 1 << 16):
                r, c = strip[rows[i : i + (1 << 16)]], at[cols[i : i + (1 << 16)]]
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    d = 1.0 - (self.v[r] * vectors[c]).sum(axis=1) / (self.length[r] * length[c])
                ok = np.isfinite(d)
                r, c, d = r[ok], c[ok], d[ok]
                self.held.append((r, cids[c], d, score[c], title[c]))
                self.pairs += len(r)
                if self.pairs >= self.most:
                    self._settle()

    def _settle(self) -> None:
        if self.held:
            q, c, d, score, title = (np.concatenate(x) for x in zip(*self.held))
            self.held, self.pairs = [], 0
            self._merge(q, pd.DataFrame({"c": c, "distance": d, "score": score, "title": title}))

    def rows(self) -> pd.DataFrame:
        self._settle()
        return super().rows()


def _scan_lists(k: int):
    """Task of ``vector_topk_lists``: rows ``grp, cand, list, seen, id,
    embedding, score, title`` by group, its queries (``cand`` false) before the
    members, these by list."""
    schema = pa.schema([("q", pa.string()), ("c", pa.string()), ("distance", pa.float64()), ("c_score", pa.float64()), ("c_title", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, group = None, None
        for grp, cand, table in _chunks(batches):
            batch = table.to_batches()[0]
            ids, vectors, score, title = _parts(batch)
            if not cand:
                if best is not None:
                    yield pa.RecordBatch.from_pandas(best.rows(), schema, preserve_index=False)
                best, group = _Looking(ids, vectors, k, _bits(batch.column("seen").to_pylist())), grp
            elif best is not None and group == grp:
                best.look(batch.column("list").to_numpy(), ids, vectors, score, title)
        if best is not None:
            yield pa.RecordBatch.from_pandas(best.rows(), schema, preserve_index=False)

    return work


def vector_topk_lists(
    vectors: DataFrame,
    fitted: CoarseLists | None = None,
    k: int = DEFAULT_K,
    queries: DataFrame | None = None,
    list_rows: int = LIST_ROWS,
    query_rows: int = QUERY_ROWS,
    group_rows: int = GROUP_ROWS,
    **fit,
) -> DataFrame:
    """``(q, c, distance, rank, score, title)`` with ``rank <= k``, as
    ``vector_topk`` gives it, approximately: distances are exact, some near
    candidates may be missed (see ``target_recall``).

    Rows without an id or a direction (null, zero or non-finite vectors) take
    no part. ``fitted``: lists of an earlier ``fit_lists`` over such vectors;
    else they are fitted here with the options ``fit``. ``query_rows``: queries
    of a group at least, while there are not two groups per core;
    ``group_rows``: queries of a group at most, about.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    spark = vectors.sparkSession
    v = _prepared(vectors)
    fitted = fitted or fit_lists(vectors, k=k, list_rows=list_rows, **fit)
    if fitted is None:
        return vector_topk(v, k=k, blocks=1)
    asked = v if queries is None else v.join(queries.select(F.col("id").cast("string").alias("id")), "id", "left_semi")
    members = materialize(v.withColumn("list", nearest_lists(F.col("embedding"), fitted, 1)[0]), "ivf-members")
    routed = materialize(asked.withColumn("to", _looks_into(F.col("embedding"), fitted)).select("*", "to.*", F.rand(7).alias("cut")).drop("to"), "ivf-queries")

    # queries stand by nearest list, inside a list by a random number; groups are equal runs
    total = routed.count()
    groups = query_groups(spark, total, query_rows, group_rows)
    before = Window.orderBy("home").rowsBetween(Window.unboundedPreceding, -1)  # over max_lists rows at most
    homes = routed.groupBy("home").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    place = (F.col("start") + F.col("cut") * F.col("n")) * groups / F.lit(max(total, 1))
    fields = [F.col(c).alias(c) for c in ("id", "embedding", "score", "title")]
    dealt = routed.join(F.broadcast(materialize(homes, "ivf-homes")), "home").withColumn("grp", F.least(place.cast("int"), F.lit(groups - 1)))
    qside = dealt.select("grp", F.lit(False).alias("cand"), F.lit(-1).alias("list"), "seen", *fields)
    # lists and the groups that look into them: max_lists rows at most
    seen = dealt.select("grp", "seen").groupBy("grp").applyInPandas(_lists_of_group, "grp int, list int")
    wanted = F.broadcast(materialize(seen.groupBy("list").agg(F.collect_list("grp").alias("groups")), "ivf-wanted"))
    cside = members.join(wanted, "list").select(F.explode("groups").alias("grp"), F.lit(True).alias("cand"), "list", F.lit(None).cast("binary").alias("seen"), *fields)
    met = qside.unionByName(cside).repartitionById(groups, "grp").sortWithinPartitions("grp", "cand", "list").mapInArrow(_scan_lists(k), _OUT_SCHEMA)
    order = Window.partitionBy("q").orderBy(F.col("distance"), F.col("c_score").desc_nulls_last(), F.col("c_title").asc_nulls_last(), "c")
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = materialize(best.select("q", "c", "distance", F.col("rank").cast("int"), F.col("c_score").alias("score"), F.col("c_title").alias("title")), "ivf-found")

    full = found.where(F.col("rank") == F.lit(min(k, max(members.count() - 1, 0)))).select(F.col("q").alias("id"))
    short = materialize(routed.select("id").distinct().join(full, "id", "left_anti"), "ivf-short")
    if not short.count():
        return found
    rest = vector_topk(v, k=k, queries=short)
    return found.join(short.select(F.col("id").alias("q")), "q", "left_anti").unionByName(rest)


__all__ = ["CoarseLists", "fit_lists", "nearest_lists", "vector_topk_lists"]
