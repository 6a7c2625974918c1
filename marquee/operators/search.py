"""Fuzzy title search by trigram similarity (batch of requests).

Similarity of two strings is the Jaccard index of their trigram sets
(:func:`marquee.functions.text.trigrams`: lower-cased alphanumeric words,
padded with two leading and one trailing space). A title matches a request
when the larger of the similarities of its display and primary titles is at
least ``threshold``; matches are ordered by similarity desc, score desc
(nulls last), display title, id, and the first ``limit`` are kept.

Exact without comparing all pairs (prefix filtering): order all trigrams by
document frequency (rarest first). A set ``A`` of size ``a`` keeps its first
``a - ceil(t*a) + 1`` trigrams as its *prefix*; two sets with Jaccard
``>= t`` always share a trigram inside both prefixes. Candidates come from
joining prefixes only, of sets whose sizes allow the threshold at all
(``t*a <= b <= a/t``) and which can still share enough trigrams from the place
of the common one on, and every candidate is then verified exactly. At low
thresholds prefixes are long and do hold frequent trigrams; the order puts
them last, where the place rule drops most of their pairs, distinct sets bound
what a frequent one can meet, and its sets are dealt over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.text import trigrams
from marquee.session import materialize

HOT_TRIGRAM = 20_000  # sets of one trigram that one task meets
DEFAULT_THRESHOLD = 0.3
DEFAULT_LIMIT = 10


def _prefixes(sets: DataFrame, df: DataFrame, threshold: float) -> DataFrame:
    """``(id, n, g, place, df)`` rows of each set's prefix under the global
    order; ``place`` counts from 1. ``sets``: (id, grams)."""
    rows = sets.select("id", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    rows = rows.join(df, "g", "left").withColumn("df", F.coalesce(F.col("df"), F.lit(0)))
    w = Window.partitionBy("id").orderBy(F.col("df"), F.col("g"))
    plen = F.col("n") - F.ceil(F.col("n") * F.lit(float(threshold)) - F.lit(1e-9)) + 1
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= plen)


def candidate_pairs(requests: DataFrame, titles: DataFrame, threshold: float, positional: bool = True) -> DataFrame:
    """``(r, t)``: ids of the set pairs that may reach the threshold, once each.

    Both: distinct sets (id, grams). Pairs meet in a trigram of both prefixes
    if their sizes allow the threshold and, by place, enough trigrams are left:
    sets of a and b trigrams need ``t / (1 + t) * (a + b)`` in common, and from
    their first common one, at places i and j, there can be no more than
    ``1 + min(a - i, b - j)``. (A pair that reaches the threshold passes at its
    first common trigram.) Only ids travel; a trigram of many sets is dealt
    over several tasks.
    """
    df = titles.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    salts = F.greatest(F.ceil(F.col("df") / F.lit(HOT_TRIGRAM)), F.lit(1)).cast("int")
    rp = _prefixes(requests, df, threshold).select("g", F.col("id").alias("r"), F.col("n").alias("a"), F.col("place").alias("i"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    tp = _prefixes(titles, df, threshold).select("g", F.col("id").alias("t"), F.col("n").alias("b"), F.col("place").alias("j"), F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"))
    least = F.lit(float(threshold) - 1e-9)
    able = (F.col("b") >= least * F.col("a")) & (F.col("a") >= least * F.col("b"))
    if positional:
        needed = (F.col("a") + F.col("b")) * F.lit(threshold / (1 + threshold)) - 1e-9
        able = able & (1 + F.least(F.col("a") - F.col("i"), F.col("b") - F.col("j")) >= needed)
    return rp.join(tp, ["g", "salt"]).where(able).select("r", "t").distinct()


def jaccard(a: F.Column, b: F.Column) -> F.Column:
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def _numbered(sets: DataFrame, name: str) -> DataFrame:
    """Distinct sets with an id each, written once: ids must not change."""
    return materialize(sets.withColumn("id", F.monotonically_increasing_id()), name)


def fuzzy_title_search(
    movies: DataFrame,
    requests: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """``movies``: ``tconst, display_title, primary_title, weighted_score``
    (optional ``active``); ``requests``: ``request_id, query``.

    Returns ``request_id, query, rank, tconst, display_title,
    primary_title, weighted_score, title_similarity``.

    Identical strings are handled once: similarity is computed between
    *distinct* trigram sets (requests and titles), and every title set keeps
    only its best ``limit`` titles in the final tie order (score desc,
    display title, id) before expansion. A title outside its set's best
    ``limit`` is beaten by ``limit`` titles with at least its similarity, so
    the result is exact while a title string shared by millions of rows costs
    ``limit`` rows per matching request.
    """
    if not (0.0 < threshold <= 1.0):
        raise ValueError("threshold must be in (0, 1]")
    if limit <= 0:
        return requests.sparkSession.createDataFrame(
            [],
            "request_id string, query string, rank int, tconst string, display_title string, primary_title string, "
            "weighted_score double, title_similarity double",
        )
    m = movies.where(F.col("active")) if "active" in movies.columns else movies
    m = m.select("tconst", "display_title", "primary_title", "weighted_score")
    fields = m.select("tconst", trigrams(F.col("display_title")).alias("grams")).unionByName(
        m.select("tconst", trigrams(F.col("primary_title")).alias("grams"))
    )
    fields = fields.where(F.size("grams") > 0).select("tconst", F.array_sort("grams").alias("grams"))
    # distinct title sets and, per set, its best `limit` titles (map-side cut)
    attrs = m.select("tconst", "display_title", "weighted_score")
    members = fields.dropDuplicates(["grams", "tconst"]).join(attrs, "tconst")
    w_set = Window.partitionBy("grams").orderBy(
        F.col("weighted_score").desc_nulls_last(), F.col("display_title").asc(), F.col("tconst").asc()
    )
    best = members.withColumn("rn", F.row_number().over(w_set)).where(F.col("rn") <= limit).select("grams", "tconst")
    tsets = fields.select("grams").distinct()
    req = requests.select(
        F.col("request_id").cast("string"), F.col("query").cast("string"), F.array_sort(trigrams(F.col("query"))).alias("rgrams")
    )
    rsets = req.where(F.size("rgrams") > 0).select(F.col("rgrams").alias("grams")).distinct()
    rsets, tsets = _numbered(rsets, "request-sets"), _numbered(tsets, "title-sets")
    pairs = candidate_pairs(rsets, tsets, threshold)
    pairs = pairs.join(rsets.select(F.col("id").alias("r"), F.col("grams").alias("rgrams")), "r").join(tsets.withColumnRenamed("id", "t"), "t")
    pairs = pairs.withColumn("sim", jaccard(F.col("grams"), F.col("rgrams"))).where(F.col("sim") >= F.lit(float(threshold)))
    hits = pairs.join(best, "grams").groupBy("rgrams", "tconst").agg(F.max("sim").alias("title_similarity"))
    scored = req.join(hits, "rgrams").join(m, "tconst")
    w = Window.partitionBy("request_id").orderBy(
        F.col("title_similarity").desc(),
        F.col("weighted_score").desc_nulls_last(),
        F.col("display_title").asc(),
        F.col("tconst").asc(),
    )
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return ranked.select(
        "request_id", "query", F.col("rank").cast("int"), "tconst", "display_title", "primary_title", "weighted_score", "title_similarity"
    )
