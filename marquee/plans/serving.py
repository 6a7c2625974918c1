"""Serving compositions: vector retrieval with non-vector fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators.recommend import recommend
from marquee.operators.vectors import active_slice, vector_topk


def recommend_with_fallback(
    titles: DataFrame,
    terms: DataFrame,
    embeddings: DataFrame,
    config: DataFrame,
    requests: DataFrame | None = None,
    top_n: int = 10,
    candidate_limit: int = 500,
    block_rows: int = 4096,
) -> DataFrame:
    """Vector neighbours for requested titles that have an active embedding
    of the configured slice; term-overlap recommendation for the rest.

    ``embeddings``: ``tconst, embedding, model_name, model_version,
    vector_dimension`` (+ ``active``). Candidates are restricted to titles
    that have an embedding in the same slice. Output: ``query_tconst, rank,
    tconst, title, source ('vector'|'terms'|'fallback'), distance``.
    """
    emb = active_slice(embeddings, config).select("tconst", "embedding")
    movies = titles.select("tconst", "title", "score")
    vec_items = emb.join(movies, "tconst").select(F.col("tconst").alias("id"), "embedding", "score", "title")
    req = movies if requests is None else movies.join(requests.select("title"), "title", "left_semi")
    with_vec = req.join(emb.select("tconst"), "tconst", "left_semi")
    without = req.join(emb.select("tconst"), "tconst", "left_anti")
    vec = vector_topk(vec_items, k=top_n, queries=with_vec.select(F.col("tconst").alias("id")), block_rows=block_rows)
    vec_out = vec.select(
        F.col("q").alias("query_tconst"), "rank", F.col("c").alias("tconst"), "title", F.lit("vector").alias("source"), "distance"
    )
    ov = recommend(titles, terms, without.select("title"), top_n=top_n, candidate_limit=candidate_limit)
    ov_out = ov.where(F.col("rank").isNotNull()).select(
        "query_tconst", "rank", "tconst", "title", "source", F.lit(None).cast("double").alias("distance")
    )
    return vec_out.unionByName(ov_out)
