"""Batch term-overlap recommendation with a score fallback.

Semantics per requested title ``q`` (``n = max(0, top_n)``,
``lim = max(0, candidate_limit)``):

1. unknown title → one error row ``This movie is not in the dataset.``
   (also when ``n = 0``);
2. stage 1: candidates sharing at least one term with ``q`` (self excluded by
   id), ranked by shared-term count desc, score desc, title asc, id asc; the
   first ``min(lim, n)`` are kept. (Re-ranking the ``lim`` best candidates
   and keeping ``n`` gives the same list because titles are unique.)
3. stage 2: the remaining ``n - e`` slots are filled by score desc, title
   asc, skipping ``q`` and the stage-1 titles.

Plan: stage 1 is :func:`marquee.operators.similarity.topk_shared` (exact,
no pairs inside hot term groups). Stage 2 never joins titles per request: the
global best ``n + 1`` titles (a bounded TakeOrderedAndProject) are packed into
one array evaluated as a scalar subquery, and each request filters that
array. Candidate attributes travel inside the stage-1 rows and the pool
array, so the output needs no join on the (possibly hot) candidate id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.scalars import NOT_FOUND_ERROR, clamp0
from marquee.operators.similarity import DEFAULT_HOT_MIN_DF, DEFAULT_MAX_HOT, topk_shared

# Fixed values of the recommender.
DEFAULT_CANDIDATE_LIMIT = 500
DEFAULT_TOP_N = 10

OUTPUT_COLUMNS = [
    "request_id",
    "query",
    "query_tconst",
    "rank",
    "tconst",
    "title",
    "score",
    "overlap",
    "source",
    "error",
]

_ENTRY = "struct<tconst:string,title:string,score:double,overlap:bigint,source:string>"


def score_pool(titles: DataFrame, size: int) -> F.Column:
    """Scalar-subquery column: the best ``size`` titles by score, title.

    Array of ``struct(neg_score, title, tconst, score)`` sorted ascending,
    i.e. score desc then title asc.
    """
    best = titles.orderBy(F.col("score").desc(), F.col("title").asc()).limit(size)
    packed = best.agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("score")).alias("neg"), "title", "tconst", "score"))
        ).alias("pool")
    )
    return packed.scalar()


def _resolve(requests: DataFrame, titles: DataFrame) -> DataFrame:
    """Requests → ``(request_id, query, q, req_top_n)``; q null if unknown."""
    cols = requests.columns
    req = requests.select(
        (F.col("request_id").cast("string") if "request_id" in cols else F.col("title").cast("string")).alias("request_id"),
        F.col("title").cast("string").alias("query"),
        (F.col("top_n").cast("int") if "top_n" in cols else F.lit(None).cast("int")).alias("req_top_n"),
    )
    lookup = titles.select(F.col("title").alias("query"), F.col("tconst").alias("q"))
    return req.join(lookup.hint("merge"), "query", "left")


def recommend(
    titles: DataFrame,
    terms: DataFrame,
    requests: DataFrame | None = None,
    top_n: int = DEFAULT_TOP_N,
    candidate_limit: int = DEFAULT_CANDIDATE_LIMIT,
    hot_min_df: int | str = DEFAULT_HOT_MIN_DF,
    max_hot: int = DEFAULT_MAX_HOT,
) -> DataFrame:
    """Recommendations for ``requests`` (column ``title``; optional
    ``request_id`` and a per-request ``top_n`` <= ``top_n``).

    ``requests=None`` recommends for every title (``recommend_all``).
    Returns :data:`OUTPUT_COLUMNS`, one row per recommendation, plus one row
    with ``error`` set per unknown request.
    """
    n = clamp0(top_n)
    lim = clamp0(candidate_limit)
    k = min(lim, n)
    if requests is None:
        requests = titles.select("title")
    res = _resolve(requests, titles)
    found = res.where(F.col("q").isNotNull())
    missing = res.where(F.col("q").isNull()).select(
        "request_id",
        "query",
        F.lit(None).cast("string").alias("query_tconst"),
        F.lit(None).cast("int").alias("rank"),
        F.lit(None).cast("string").alias("tconst"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("bigint").alias("overlap"),
        F.lit(None).cast("string").alias("source"),
        F.lit(NOT_FOUND_ERROR).alias("error"),
    )
    if n == 0:
        return missing

    qids = found.select(F.col("q").alias("id")).distinct()
    if k > 0:
        st1 = topk_shared(
            terms.select(F.col("tconst").alias("id"), F.col("term").alias("feat"), F.lit(1).alias("w")),
            titles.select(F.col("tconst").alias("id"), "score", "title"),
            k,
            mode="overlap",
            queries=qids,
            hot_min_df=hot_min_df,
            max_hot=max_hot,
        )
        lists = st1.groupBy("q").agg(
            F.array_sort(
                F.collect_list(F.struct("rank", F.col("c").alias("tconst"), "title", "score", F.col("dot").alias("overlap")))
            ).alias("st1")
        )
    else:
        lists = None

    per_q = qids.withColumnRenamed("id", "q")
    if lists is not None:
        per_q = per_q.join(lists, "q", "left")
    else:
        per_q = per_q.withColumn(
            "st1", F.lit(None).cast("array<struct<rank:int,tconst:string,title:string,score:double,overlap:bigint>>")
        )
    st1_arr = F.coalesce(
        F.transform(
            F.col("st1"),
            lambda s: F.struct(
                s["tconst"].alias("tconst"),
                s["title"].alias("title"),
                s["score"].alias("score"),
                s["overlap"].alias("overlap"),
                F.lit("terms").alias("source"),
            ),
        ),
        F.array().cast(f"array<{_ENTRY}>"),
    )
    # the pool is projected as a column first: subqueries cannot sit in lambdas
    per_q = per_q.withColumn("pool", score_pool(titles, n + 1))
    pool = F.col("pool")
    taken = F.transform(st1_arr, lambda s: s["tconst"])
    fill = F.filter(pool, lambda p: (p["tconst"] != F.col("q")) & ~F.array_contains(taken, p["tconst"]))
    fill = F.slice(fill, 1, F.greatest(F.lit(0), F.lit(n) - F.size(st1_arr)))
    fill_arr = F.transform(
        fill,
        lambda p: F.struct(
            p["tconst"].alias("tconst"),
            p["title"].alias("title"),
            p["score"].alias("score"),
            F.lit(None).cast("bigint").alias("overlap"),
            F.lit("fallback").alias("source"),
        ),
    )
    recs = per_q.select("q", F.concat(st1_arr, fill_arr).alias("recs"))
    out = found.join(recs, "q").select(
        "request_id", "query", "q", "req_top_n", F.posexplode("recs").alias("pos", "r")
    )
    out = out.where(F.col("pos") < F.coalesce(F.least(F.col("req_top_n"), F.lit(n)), F.lit(n))).select(
        "request_id",
        "query",
        F.col("q").alias("query_tconst"),
        (F.col("pos") + 1).cast("int").alias("rank"),
        F.col("r.tconst").alias("tconst"),
        F.col("r.title").alias("title"),
        F.col("r.score").alias("score"),
        F.col("r.overlap").alias("overlap"),
        F.col("r.source").alias("source"),
        F.lit(None).cast("string").alias("error"),
    )
    return out.unionByName(missing)


def recommend_all(titles: DataFrame, terms: DataFrame, **kwargs) -> DataFrame:
    """Recommendations for every title of the catalogue."""
    return recommend(titles, terms, None, **kwargs)


def candidates(
    titles: DataFrame,
    terms: DataFrame,
    candidate_limit: int = DEFAULT_CANDIDATE_LIMIT,
    hot_min_df: int | str = DEFAULT_HOT_MIN_DF,
    max_hot: int = DEFAULT_MAX_HOT,
    queries: DataFrame | None = None,
) -> DataFrame:
    """The bounded candidate set per title: ``(query_tconst, rank, tconst, overlap)``."""
    lim = clamp0(candidate_limit)
    if lim == 0:
        return titles.sparkSession.createDataFrame([], "query_tconst string, rank int, tconst string, overlap bigint")
    st = topk_shared(
        terms.select(F.col("tconst").alias("id"), F.col("term").alias("feat"), F.lit(1).alias("w")),
        titles.select(F.col("tconst").alias("id"), "score", "title"),
        lim,
        mode="overlap",
        queries=queries,
        hot_min_df=hot_min_df,
        max_hot=max_hot,
    )
    return st.select(
        F.col("q").alias("query_tconst"), F.col("rank").cast("int").alias("rank"), F.col("c").alias("tconst"), F.col("dot").alias("overlap")
    )


def recommend_titles(
    titles: DataFrame,
    terms: DataFrame,
    queries: list[str],
    top_n: int = DEFAULT_TOP_N,
    candidate_limit: int = DEFAULT_CANDIDATE_LIMIT,
    **kwargs,
) -> DataFrame:
    """Convenience for a handful of titles typed by a user: builds the
    request frame and runs the batch :func:`recommend`."""
    spark = titles.sparkSession
    req = spark.createDataFrame([(str(i), q) for i, q in enumerate(queries)], "request_id string, title string")
    return recommend(titles, terms, req, top_n=top_n, candidate_limit=candidate_limit, **kwargs)
