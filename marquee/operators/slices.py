"""Serving rules of stored embeddings: declared constraints, the configured
slice, and re-ranking by shared metadata.

The contract's tables (column names are fixed values):

* text features: ``text_feature_id, tconst, feature_name, feature_version,
  source_text_sha256, active``
* embeddings: the same keys but ``active`` of their own, plus ``model_name,
  model_version, vector_dimension, embedding`` and optionally
  ``movie_embedding_id`` and ``embedding_sha256``
* movies: ``tconst, active``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys that an embedding copies from its text feature, with the problem that
#: a difference is, and those that name a model (fixed values of the contract).
COPIED_KEYS = {
    "tconst": "other_movie",
    "feature_name": "other_feature_name",
    "feature_version": "other_feature_version",
    "source_text_sha256": "outdated_text",
}
FEATURE_KEYS = ["feature_name", "feature_version"]
MODEL_KEYS = ["model_name", "model_version", "vector_dimension"]
#: Terms of an item that are kept in one row where overlaps are counted.
LIST_TERMS = 1_024
ONE_PER = ["text_feature_id", *MODEL_KEYS]


def embedding_digest(embedding: Column) -> Column:
    """SHA-256 of the components as text, joined by commas."""
    return F.sha2(F.array_join(embedding.cast("array<string>"), ",", "null"), 256)


def embedding_problems(embeddings: DataFrame, features: DataFrame, movies: DataFrame) -> DataFrame:
    """The embeddings that break a declared constraint, each with all of its
    broken constraints in ``problems`` (sorted array). One row per embedding
    row, whatever it breaks:

    * ``bad_vector``: null, empty, or with null or non-finite components
    * ``dimension``: the vector's length is not ``vector_dimension``
    * ``no_text_feature``, or what differs from the referenced one:
      ``other_movie``, ``other_feature_name``, ``other_feature_version``,
      ``outdated_text`` (the composite foreign key; null keys differ)
    * ``inactive_text_feature``: an active embedding of a superseded text
    * ``no_movie``, ``inactive_movie``: as the embedding's movie
    * ``repeated_key``: more than one row per text feature and model
    * ``vector_digest``: ``embedding_sha256`` is given and is another vector's

    Feature ids and movie ids are unique in their tables (the first row by
    their other columns counts if they are not). No side is broadcast: a
    million features pass the size check in their packed files, and would be
    unpacked in the driver.
    """
    e = embeddings
    if "embedding_sha256" not in e.columns:
        e = e.withColumn("embedding_sha256", F.lit(None).cast("string"))
    one = lambda df, key: df.groupBy(key).agg(F.min(F.struct(*[c for c in df.columns if c != key])).alias("r"))
    f = one(features.select("text_feature_id", *COPIED_KEYS, "active"), "text_feature_id")
    f = f.select("text_feature_id", F.col("r").alias("f"))
    m = one(movies.select("tconst", "active"), "tconst").select("tconst", F.col("r").alias("m"))
    # repeated keys from a count joined back: a hot key has one row in the counts
    twice = e.groupBy(*ONE_PER).count().where("count > 1").select(*[F.col(c).alias("k_" + c) for c in ONE_PER], F.lit(True).alias("k_twice"))
    same_key = [F.col(c).eqNullSafe(F.col("k_" + c)) for c in ONE_PER]
    j = e.join(f.hint("merge"), "text_feature_id", "left").join(m.hint("merge"), "tconst", "left").join(twice.hint("merge"), same_key, "left")

    is_null = F.coalesce(F.size("embedding"), F.lit(-1)) <= 0
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    no_feature, no_movie = F.col("f").isNull(), F.col("m").isNull()
    tests = {
        "bad_vector": is_null | broken,
        "dimension": F.col("vector_dimension").isNull() | (F.size("embedding") != F.col("vector_dimension")),
        "no_text_feature": no_feature,
        **{problem: ~no_feature & ~F.coalesce(F.col(key) == F.col(f"f.{key}"), F.lit(False)) for key, problem in COPIED_KEYS.items()},
        "inactive_text_feature": ~no_feature & F.col("active") & ~F.col("f.active"),
        "no_movie": no_movie,
        "inactive_movie": ~no_movie & ~F.col("m.active"),
        "repeated_key": F.col("k_twice"),
        "vector_digest": F.col("embedding_sha256") != embedding_digest(F.col("embedding")),
    }
    named = [F.when(F.coalesce(test, F.lit(False)), F.lit(problem)) for problem, test in tests.items()]
    out = j.withColumn("problems", F.array_sort(F.array_compact(F.array(*named)))).where(F.size("problems") > 0)
    return out.select(*embeddings.columns, "problems")


def configured(config: DataFrame, keys: list[str]) -> dict[str, Column]:
    """The values of a one-row configuration, as scalar subqueries."""
    row = config.select(F.struct(*keys).alias("cfg")).scalar()
    return {k: row.getField(k) for k in keys}


def serving_slice(embeddings: DataFrame, features: DataFrame, movies: DataFrame, config: DataFrame) -> DataFrame:
    """``tconst, text_feature_id, embedding``: what may answer requests.

    Feature name and version and model name, version and dimension come from
    ``config`` (one row; two rows fail the job), never from the newest row.
    An embedding serves if it is active, of the configured dimension, and its
    whole foreign key matches an *active* text feature of an active movie: an
    embedding of a text that was superseded, or whose text hash differs, drops
    out in the moment that the feature's active row changes.
    """
    cfg = configured(config, FEATURE_KEYS + MODEL_KEYS)
    chosen = F.lit(True)
    for key in FEATURE_KEYS + MODEL_KEYS:
        chosen = chosen & (F.col(key) == cfg[key])
    e = embeddings.where(F.col("active") & chosen & (F.size("embedding") == F.col("vector_dimension")))
    valid = features.where(F.col("active")).select("text_feature_id", *COPIED_KEYS).distinct()
    return (
        e.join(valid.hint("merge"), ["text_feature_id", *COPIED_KEYS], "left_semi")
        .join(movies.where(F.col("active")).select("tconst").hint("merge"), "tconst", "left_semi")
        .select("tconst", "text_feature_id", "embedding")
    )


def overlap_counts(pairs: DataFrame, terms: DataFrame, salts: int = 8, list_terms: int = LIST_TERMS) -> DataFrame:
    """``q, c, overlap``: how many distinct terms both items have, for the
    given pairs only (pairs without one are left out).

    ``terms``: (id, term); only those of items in pairs are moved. An item of
    at most ``list_terms`` terms is one row with all of them, and a pair of two
    such items meets both rows. Of other pairs the item with fewer terms is
    walked term by term, and each is looked up in the other item's: the work is
    the sum over the pairs of the shorter list, not of the terms' document
    frequencies. An item in very many pairs is spread over ``salts`` tasks.
    """
    p = pairs.select("q", "c").distinct()
    paired = p.select(F.col("q").alias("id")).union(p.select("c")).distinct()
    has = terms.select(F.col("id"), "term").where("id is not null and term is not null")
    has = has.join(paired.hint("merge"), "id", "left_semi").distinct()
    n = has.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    is_short = F.col("n") <= list_terms
    lists = has.join(n.where(is_short).hint("merge"), "id").groupBy("id", "n").agg(F.collect_list("term").alias("terms"))
    items = lists.unionByName(n.where(~is_short).withColumn("terms", F.lit(None).cast("array<string>")))
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    salted = lambda c: F.pmod(F.xxhash64("q", "c", F.lit(c)), F.lit(salts)).cast("int")
    for side in ("q", "c"):
        own = items.select(F.col("id").alias(side), F.col("n").alias("n_" + side), F.col("terms").alias("t_" + side), spread)
        p = p.withColumn("salt", salted(side)).join(own.hint("merge"), [side, "salt"]).drop("salt")
    both_short = F.col("t_q").isNotNull() & F.col("t_c").isNotNull()
    by_list = p.where(both_short).select("q", "c", F.size(F.array_intersect("t_q", "t_c")).cast("long").alias("overlap")).where("overlap > 0")

    fewer = F.col("n_q") <= F.col("n_c")
    long = p.where(~both_short).select("q", "c", F.when(fewer, F.col("q")).otherwise(F.col("c")).alias("walked"), F.when(fewer, F.col("c")).otherwise(F.col("q")).alias("asked"))
    of = lambda side: has.join(long.select(F.col(side).alias("id")).distinct().hint("merge"), "id", "left_semi").select(F.col("id").alias(side), "term", spread)
    walked = long.withColumn("salt", salted("w")).join(of("walked").hint("merge"), ["walked", "salt"]).drop("salt")
    met = walked.withColumn("salt", salted("a")).join(of("asked").hint("merge"), ["asked", "term", "salt"])
    return by_list.unionByName(met.groupBy("q", "c").agg(F.count(F.lit(1)).alias("overlap")))


def rerank_by_overlap(candidates: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """Bounded candidates (q, c, distance, score, title) in the order: most
    shared terms, least distance, highest score (nulls last), title, id; the
    first ``k`` of every query with ``overlap`` and ``rerank``."""
    counted = overlap_counts(candidates, terms)
    j = candidates.join(counted, ["q", "c"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0).cast("bigint")))
    order = Window.partitionBy("q").orderBy(
        F.col("overlap").desc(), F.col("distance").asc(), F.col("score").desc_nulls_last(), F.col("title").asc_nulls_last(), F.col("c").asc()
    )
    return j.withColumn("rerank", F.row_number().over(order)).where(F.col("rerank") <= k)


__all__ = ["embedding_problems", "embedding_digest", "overlap_counts", "rerank_by_overlap", "serving_slice"]
