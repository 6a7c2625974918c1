"""Vector candidate retrieval over stored embeddings (second tier).

``vector_topk`` is exact cosine-distance top-k for a set of query vectors
against all candidate vectors, planned as a blocked matrix product:

* queries are dealt to ``G`` groups by a hash; every group goes to one task,
  which keeps its queries and streams all candidates past them (``scan``);
* a chunk of candidates is multiplied with the queries in single precision; a
  pair goes on only if its product can reach the query's k-th best so far
  within the rounding of single precision. What goes on is measured in double
  precision, and the query's best ``k`` by the full order below are kept;
* a final ``row_number() <= k`` per query joins rows of one id.

Work is ``O(Q*N*d)`` flops for ``Q`` queries, quadratic by nature. What crosses
the network is ``Q + N*G`` vectors and ``Q*k`` result rows: ``G`` is two per
core, and grows only when a group would hold more than ``GROUP_ROWS`` queries.
A task holds one group and one chunk, whatever ``N``. Ties: distance asc, score
desc (nulls last), title asc, id asc. Zero vectors have no defined cosine and
are never returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_K = 10
DEFAULT_BLOCK_ROWS = 4096
GROUP_ROWS = 32_768
CHUNK_ROWS = 32_768
_STRIP = 256  # queries that are multiplied at once
_HELD = 1 << 20  # pairs that are held before the best are kept

_OUT_SCHEMA = "q string, c string, distance double, c_score double, c_title string"


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow list column, one per row (nulls are NaN)."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length")
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(len(sizes), -1)


def _length(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))


def _unit32(m: np.ndarray, length: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        u = m / length[:, None]
    return np.where(np.isfinite(u), u, 0.0).astype(np.float32)


def _names(ids: np.ndarray) -> np.ndarray:
    """Ids as sortable texts; null equals null only."""
    return np.array(["" if i is None else "=" + i for i in ids], dtype=str)


class _Best:
    """The best ``k`` candidates so far of each query of a group."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, vectors, k
        self.length = _length(vectors)
        self.unit = _unit32(vectors, self.length)
        # sums of products of unit vectors in single precision are off by less
        self.margin = 2.0 * (vectors.shape[1] + 8) * 2.0**-23
        self.least = np.full(len(ids), -np.inf, np.float32)  # a product below it is no use
        self.q = np.empty(0, np.int64)
        self.found = pd.DataFrame({"c": [], "distance": [], "score": [], "title": []}, dtype=object).astype({"distance": float, "score": float})
        names = _names(ids)
        self._order = np.argsort(names, kind="stable")
        self._sorted = names[self._order]

    def _own(self, cids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (query, candidate) places of equal ids."""
        names = _names(cids)
        lo, hi = np.searchsorted(self._sorted, names), np.searchsorted(self._sorted, names, side="right")
        cand = np.repeat(np.arange(len(cids)), hi - lo)
        at = np.arange(len(cand)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        return self._order[np.repeat(lo, hi - lo) + at], cand

    def offer(self, cids: np.ndarray, vectors: np.ndarray, score: np.ndarray, title: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Take in a chunk of candidates; ``asked``: queries that look at it."""
        if not len(cids) or not len(self.ids):
            return
        if vectors.shape[1] != self.v.shape[1]:
            raise ValueError("vectors differ in length")
        keep = _without_spare_copies(cids, vectors, score, title, self.k)
        cids, vectors, score, title = cids[keep], vectors[keep], score[keep], title[keep]
        length = _length(vectors)
        unit = _unit32(vectors, length).T.copy()
        own_q, own_c = self._own(cids)
        by_q = np.argsort(own_q, kind="stable")
        own_q, own_c = own_q[by_q], own_c[by_q]
        queries = np.arange(len(self.ids)) if asked is None else asked
        at_q, at_c, at_d, held = [], [], [], 0

        def take_in() -> None:
            c = np.concatenate(at_c)
            self._merge(np.concatenate(at_q), pd.DataFrame({"c": cids[c], "distance": np.concatenate(at_d), "score": score[c], "title": title[c]}))

        for a in range(0, len(queries), _STRIP):
            strip = queries[a : a + _STRIP]
            near = self.unit[strip] @ unit
            lo, hi = np.searchsorted(own_q, strip), np.searchsorted(own_q, strip, side="right")
            for i in np.flatnonzero(hi > lo):
                near[i, own_c[lo[i] : hi[i]]] = -np.inf
            least = self.least[strip]
            if near.shape[1] > self.k:
                fresh = np.flatnonzero(~np.isfinite(least))
                if len(fresh):
                    kth = np.partition(near[fresh], near.shape[1] - self.k, axis=1)[:, near.shape[1] - self.k]
                    least = least.copy()
                    least[fresh] = kth - np.float32(2 * self.margin)
            flat = np.flatnonzero(near >= least[:, None])
            rows, cols = flat // near.shape[1], flat % near.shape[1]
            rows, cols = rows[np.isfinite(near[rows, cols])], cols[np.isfinite(near[rows, cols])]
            for b in range(0, len(rows), 1 << 16):
                r, c = strip[rows[b : b + (1 << 16)]], cols[b : b + (1 << 16)]
                with np.errstate(divide="ignore", invalid="ignore"):
                    d = 1.0 - (self.v[r] * vectors[c]).sum(axis=1) / (self.length[r] * length[c])
                ok = np.isfinite(d)
                at_q.append(r[ok]), at_c.append(c[ok]), at_d.append(d[ok])
                held += len(r)
                if held > _HELD:
                    take_in()
                    at_q, at_c, at_d, held = [], [], [], 0
        if at_q:
            take_in()

    def _merge(self, q: np.ndarray, rows: pd.DataFrame) -> None:
        if not len(q):
            return
        q = np.concatenate([self.q, q])
        rows = pd.concat([self.found, rows], ignore_index=True) if len(self.found) else rows
        order = _ranked(q, rows)
        q = q[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.q, self.found = q[best], rows.iloc[order[best]].reset_index(drop=True)
        last = np.flatnonzero(np.bincount(self.q, minlength=len(self.ids)) == self.k)
        kth = self.found["distance"].to_numpy()[np.searchsorted(self.q, last, side="right") - 1]
        self.least[last] = (1.0 - kth - self.margin).astype(np.float32)

    def rows(self) -> pd.DataFrame:
        f = self.found
        return pd.DataFrame({"q": self.ids[self.q], "c": f["c"], "distance": f["distance"], "c_score": f["score"], "c_title": f["title"]})


def _ranked(q: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
    """Order by query, distance, score desc (nulls last), title (nulls last),
    id; the texts are compared only where the numbers tie."""
    d, s = rows["distance"].to_numpy(), -rows["score"].to_numpy(float)
    order = np.lexsort((s, d, q))
    same = (q[order][1:] == q[order][:-1]) & (d[order][1:] == d[order][:-1])
    so = s[order]
    same &= (so[1:] == so[:-1]) | (np.isnan(so[1:]) & np.isnan(so[:-1]))
    if same.any():
        tied = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
        run = np.cumsum(np.r_[True, ~same])[tied]
        part = rows.iloc[order[tied]]
        texts = pd.DataFrame({"run": run, "none": part["title"].isna().to_numpy(), "title": part["title"].fillna("").to_numpy(), "c": part["c"].to_numpy(), "at": order[tied]})
        order[tied] = texts.sort_values(["run", "none", "title", "c"], kind="stable", na_position="first")["at"].to_numpy()
    return order


def _without_spare_copies(cids: np.ndarray, vectors: np.ndarray, score: np.ndarray, title: np.ndarray, k: int) -> np.ndarray:
    """Places of the candidates that can be among the k best of any query: of
    equal vectors (equally far from everything) the first by the order of ties;
    k of them and as many more as one id has rows, which may be a query's own."""
    key = pd.Series([v.tobytes() for v in vectors + 0.0])  # -0.0 is 0.0
    copies = key.duplicated(keep=False).to_numpy()
    if not copies.any():
        return np.arange(len(cids))
    group = np.unique(key[copies], return_inverse=True)[1]
    at = np.flatnonzero(copies)
    rows = pd.DataFrame({"c": cids[at], "distance": np.zeros(len(at)), "score": score[at], "title": title[at]})
    order = _ranked(group, rows)
    nth = np.arange(len(at)) - np.searchsorted(group[order], group[order])
    own = int(rows["c"].value_counts(dropna=False).max())
    return np.sort(np.r_[np.flatnonzero(~copies), at[order[nth < k + own]]])


def _parts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    col = lambda name: batch.column(batch.schema.get_field_index(name))
    texts = lambda name: np.array(col(name).to_pylist(), dtype=object)
    score = col("score").to_numpy(zero_copy_only=False).astype(float)
    return texts("id"), _matrix(col("embedding")), score, texts("title")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.Table]]:
    """Runs of rows of one group and side, candidates ``CHUNK_ROWS`` at most."""
    held, key, n = [], None, 0
    for batch in batches:
        grp, side = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((grp[1:] != grp[:-1]) | (side[1:] != side[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            if a == b:
                continue
            now = (int(grp[a]), bool(side[a]))
            if held and (now != key or (now[1] and n + b - a > CHUNK_ROWS)):
                yield *key, pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
            held.append(batch.slice(a, b - a))
            key, n = now, n + b - a
    if held:
        yield *key, pa.Table.from_batches(held).combine_chunks()


def _scan(k: int):
    """Task of ``vector_topk``: rows ``grp, cand, id, embedding, score, title``
    by group, its queries (``cand`` false) before the candidates."""
    schema = pa.schema([("q", pa.string()), ("c", pa.string()), ("distance", pa.float64()), ("c_score", pa.float64()), ("c_title", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, group = None, None
        for grp, cand, table in _chunks(batches):
            batch = table.to_batches()[0]
            ids, vectors, score, title = _parts(batch)
            if not cand:
                if best is not None:
                    yield pa.RecordBatch.from_pandas(best.rows(), schema, preserve_index=False)
                best, group = _Best(ids, vectors, k), grp
            elif best is not None and group == grp:  # else a group without queries
                best.offer(ids, vectors, score, title)
        if best is not None:
            yield pa.RecordBatch.from_pandas(best.rows(), schema, preserve_index=False)

    return work


def _block_topk(k: int):
    """The same for one block of queries and one of candidates as frames."""

    def fn(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or cpdf.empty:
            return pd.DataFrame({"q": [], "c": [], "distance": [], "c_score": [], "c_title": []})
        stack = lambda f: np.vstack(f["embedding"].map(lambda v: np.asarray(v, dtype=np.float64)).to_numpy())
        best = _Best(qpdf["id"].to_numpy(object), stack(qpdf), k)
        best.offer(cpdf["id"].to_numpy(object), stack(cpdf), cpdf["score"].to_numpy(float), cpdf["title"].to_numpy(object))
        return best.rows()

    return fn


def measurable(embedding: Column) -> Column:
    """Vectors that have a distance to others: finite throughout, not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & finite & F.exists(embedding, lambda x: x != 0)


def query_groups(spark, n: int, least_rows: int = DEFAULT_BLOCK_ROWS, most_rows: int = GROUP_ROWS) -> int:
    """Two per core, of ``least_rows`` at least; more where one would pass
    ``most_rows``."""
    return max(1, min(2 * spark.sparkContext.defaultParallelism, math.ceil(n / max(1, least_rows))), math.ceil(n / most_rows))


def vector_topk(
    vectors: DataFrame,
    k: int = DEFAULT_K,
    queries: DataFrame | None = None,
    blocks: int | None = None,
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """``vectors``: ``id, embedding`` (+ optional ``score``, ``title``);
    ``queries``: optional ``id`` frame restricting the query side; ``blocks``:
    number of query groups; ``block_rows``: queries of a group at least, while
    there are not two groups per core.

    Returns ``(q, c, distance, rank, score, title)`` with ``rank <= k``.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    cols, spark = vectors.columns, vectors.sparkSession
    single = dict(vectors.dtypes)["embedding"] == "array<float>"  # exact in half the bytes
    v = vectors.select(
        F.col("id").cast("string").alias("id"),
        F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"),
        (F.col("score").cast("double") if "score" in cols else F.lit(None).cast("double")).alias("score"),
        (F.col("title").cast("string") if "title" in cols else F.lit(None).cast("string")).alias("title"),
    ).where(measurable(F.col("embedding")))
    if queries is None:
        qv = v
    else:
        qids = queries.select(F.concat(F.col("id").cast("string"), F.lit("")).alias("_qid"))
        qv = v.join(qids, v["id"] == qids["_qid"], "left_semi")
    groups = int(blocks) if blocks is not None else query_groups(spark, qv.count(), block_rows)
    fields = [F.col(c).alias(c) for c in ("id", "embedding", "score", "title")]
    asked = qv.select(F.pmod(F.xxhash64("id", "embedding"), F.lit(groups)).cast("int").alias("grp"), F.lit(False).alias("cand"), *fields)
    offered = v.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(True).alias("cand"), *fields)
    dealt = asked.unionByName(offered).repartitionById(groups, "grp").sortWithinPartitions("grp", "cand")
    part = dealt.mapInArrow(_scan(k), _OUT_SCHEMA)
    w = Window.partitionBy("q").orderBy(
        F.col("distance").asc(), F.col("c_score").desc_nulls_last(), F.col("c_title").asc_nulls_last(), F.col("c").asc()
    )
    ranked = part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("q", "c", "distance", F.col("rank").cast("int"), F.col("c_score").alias("score"), F.col("c_title").alias("title"))


def embedding_integrity(embeddings: DataFrame, dimension: int, text_features: DataFrame | None = None) -> DataFrame:
    """Rows breaking the embedding contract: ``(id, problem)``.

    ``dimension``: declared size differs from the vector length, or the
    vector is missing / holds null or NaN; ``orphan``: no matching text
    feature row (when ``text_features`` is given, matched on ``id``).
    """
    e = embeddings.select(F.col("id").cast("string").alias("id"), "embedding")
    bad_dim = e.where(
        F.col("embedding").isNull()
        | (F.size("embedding") != F.lit(int(dimension)))
        | F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    ).select("id", F.lit("dimension").alias("problem"))
    if text_features is None:
        return bad_dim
    orphan = e.join(text_features.select(F.col("id").cast("string").alias("id")), "id", "left_anti").select(
        "id", F.lit("orphan").alias("problem")
    )
    return bad_dim.unionByName(orphan)


def active_slice(embeddings: DataFrame, config: DataFrame) -> DataFrame:
    """Embeddings of the configured model/version/dimension slice.

    ``config`` is a one-row frame ``(model_name, model_version,
    vector_dimension)`` evaluated once as a scalar subquery (no join); two
    rows fail the job, and the model is never chosen as "latest row".
    """
    keys = ["model_name", "model_version", "vector_dimension"]
    cfg = config.select(F.struct(*keys).alias("cfg")).scalar()
    e = embeddings.where(F.col("active")) if "active" in embeddings.columns else embeddings
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == cfg.getField(k))
    return e.where(cond & (F.size("embedding") == F.col("vector_dimension")))


def rerank_by_metadata(cands: DataFrame, meta_match: F.Column, k: int) -> DataFrame:
    """Re-rank bounded candidates: ``meta_match`` desc, distance asc, id."""
    w = Window.partitionBy("q").orderBy(meta_match.desc(), F.col("distance").asc(), F.col("c").asc())
    return cands.withColumn("rerank", F.row_number().over(w)).where(F.col("rerank") <= k)
