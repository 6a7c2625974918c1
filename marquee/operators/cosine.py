"""Cosine recommender over bag-of-words "soups" of people and genres.

Per title the token counts come from: every cast name and the director
(counted twice, as a weight) with spaces removed and lower-cased, plus the
genres; tokens are word runs of length >= 2 minus stop words. Similarity is
the cosine of the count vectors; ties go to the smaller id. Titles with no
positive similarity fill the remaining slots in id order (the similarity
row of the reference ranks every title).

The similarity matrix is never dense: the exact top-k engine in
:mod:`marquee.operators.similarity` pairs titles only through rare tokens
and reaches hot tokens (e.g. a token in every title) through per-sub-vector
short lists ordered by norm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.scalars import NOT_FOUND_ERROR, clamp0, clean_name, empty_if_null
from marquee.functions.text import default_stop_words, without_stop_words, word_tokens
from marquee.operators.index import _with_titles, prepare_catalog
from marquee.operators.similarity import DEFAULT_HOT_MIN_DF, DEFAULT_MAX_HOT, topk_shared

DEFAULT_TOP_N = 10


def token_counts(items: DataFrame, stop_words: tuple[str, ...] | None = None) -> DataFrame:
    """``(id, feat, w)`` token counts from ``actors``, ``director``, ``genres``.

    ``director`` is a string (counted twice); the others are string arrays.
    Null names contribute no token.
    """
    sw = default_stop_words() if stop_words is None else tuple(stop_words)
    director = F.when(F.col("director").isNotNull(), F.array(F.col("director"), F.col("director"))).otherwise(
        F.array().cast("array<string>")
    )
    values = F.concat(empty_if_null(F.col("actors")), director, empty_if_null(F.col("genres")))
    toks = F.flatten(
        F.transform(
            F.filter(values, lambda v: v.isNotNull()),
            lambda v: without_stop_words(word_tokens(clean_name(v)), sw),
        )
    )
    return items.select("id", F.explode(toks).alias("feat")).groupBy("id", "feat").agg(F.count(F.lit(1)).alias("w"))


def prepared_titles(catalog: DataFrame) -> DataFrame:
    """Catalogue rows with ids and disambiguated titles: ``(id, title,
    director, actors, genres)``; rows whose duplicate title cannot be
    disambiguated (no id) are left out (see ``index.violations``)."""
    t = _with_titles(prepare_catalog(catalog))
    t = t.where(F.col("raw_title").isNotNull() & ~((F.col("title_count") > 1) & (F.col("tconst_raw").isNull() | (F.col("tconst_raw") == ""))))
    return t.select(F.col("tconst").alias("id"), "title", "director", "actors", "genres")


def cosine_recommend(
    catalog: DataFrame,
    requests: DataFrame | None = None,
    top_n: int = DEFAULT_TOP_N,
    stop_words: tuple[str, ...] | None = None,
    hot_min_df: int | str = DEFAULT_HOT_MIN_DF,
    max_hot: int = DEFAULT_MAX_HOT,
    prepared: DataFrame | None = None,
) -> DataFrame:
    """``(request_id, query, query_tconst, rank, tconst, title, similarity,
    source, error)``; ``requests`` has a ``title`` column (all titles when
    None)."""
    n = clamp0(top_n)
    items = prepared if prepared is not None else prepared_titles(catalog)
    if requests is None:
        requests = items.select("title")
    cols = requests.columns
    req = requests.select(
        (F.col("request_id").cast("string") if "request_id" in cols else F.col("title").cast("string")).alias("request_id"),
        F.col("title").cast("string").alias("query"),
    )
    res = req.join(items.select(F.col("title").alias("query"), F.col("id").alias("q")), "query", "left")
    found = res.where(F.col("q").isNotNull())
    missing = res.where(F.col("q").isNull()).select(
        "request_id",
        "query",
        F.lit(None).cast("string").alias("query_tconst"),
        F.lit(None).cast("int").alias("rank"),
        F.lit(None).cast("string").alias("tconst"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("double").alias("similarity"),
        F.lit(None).cast("string").alias("source"),
        F.lit(NOT_FOUND_ERROR).alias("error"),
    )
    if n == 0:
        return missing
    qids = found.select(F.col("q").alias("id")).distinct()
    feats = token_counts(items, stop_words)
    st1 = topk_shared(
        feats, items.select("id", "title"), n, mode="cosine", queries=qids, hot_min_df=hot_min_df, max_hot=max_hot, carry=("title",)
    )
    lists = st1.groupBy("q").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("c").alias("tconst"), "title", F.col("sim").alias("similarity")))).alias("st1")
    )
    best = items.select(F.col("id").alias("tconst"), "title").orderBy("tconst").limit(n + 1)
    pool = best.agg(F.array_sort(F.collect_list(F.struct("tconst", "title"))).alias("pool")).scalar()
    per_q = qids.withColumnRenamed("id", "q").join(lists, "q", "left").withColumn("pool", pool)
    entry = "struct<tconst:string,title:string,similarity:double,source:string>"
    st1_arr = F.coalesce(
        F.transform(
            "st1",
            lambda s: F.struct(
                s["tconst"].alias("tconst"), s["title"].alias("title"), s["similarity"].alias("similarity"), F.lit("similar").alias("source")
            ),
        ),
        F.array().cast(f"array<{entry}>"),
    )
    taken = F.transform(st1_arr, lambda s: s["tconst"])
    fill = F.slice(
        F.filter("pool", lambda p: (p["tconst"] != F.col("q")) & ~F.array_contains(taken, p["tconst"])),
        1,
        F.greatest(F.lit(0), F.lit(n) - F.size(st1_arr)),
    )
    fill_arr = F.transform(
        fill,
        lambda p: F.struct(p["tconst"].alias("tconst"), p["title"].alias("title"), F.lit(0.0).alias("similarity"), F.lit("zero").alias("source")),
    )
    recs = per_q.select("q", F.concat(st1_arr, fill_arr).alias("recs"))
    out = found.join(recs, "q").select("request_id", "query", "q", F.posexplode("recs").alias("pos", "r"))
    out = out.select(
        "request_id",
        "query",
        F.col("q").alias("query_tconst"),
        (F.col("pos") + 1).cast("int").alias("rank"),
        F.col("r.tconst").alias("tconst"),
        F.col("r.title").alias("title"),
        F.col("r.similarity").alias("similarity"),
        F.col("r.source").alias("source"),
        F.lit(None).cast("string").alias("error"),
    )
    return out.unionByName(missing)
