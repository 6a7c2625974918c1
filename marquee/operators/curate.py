"""Curation: raw source tables → the typed, scored, de-duplicated catalogue.

Plan shape (one lazy plan, nothing collected):

* movie filter is pushed into the title scan; titles ⋈ ratings ⋈ crew are
  inner equi-joins on ``tconst`` (AQE picks broadcast or sort-merge);
* the mean rating ``C`` and the vote quantile are one aggregate evaluated as
  a scalar subquery (exact ``percentile``, linear interpolation), used both as
  the threshold and inside the score - no cross join, no driver round trip;
* director and cast lists are built only for surviving titles, in one
  pass (one union, one join with names, one grouping). The cast top-k uses
  ``row_number() <= k`` which Spark plans as a *partial* WindowGroupLimit
  before the shuffle, so a title with a huge credit list is cut map-side.
  List aggregation collects at most 3 + 5 structs per title and keeps null
  names (``collect_list`` of a struct never drops the element);
* duplicate titles are found with an aggregate + join (partial aggregation
  and AQE skew-join split absorb a hot title string) instead of a window that
  would put a hot title in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.session import materialize
from marquee.functions.scalars import (
    EMPTY_STRING_ARRAY,
    disambiguated_title,
    empty_if_null,
    first_or_empty,
    split_genres,
    split_ids,
    weighted_score,
)

# Fixed values of the curation.
DIRECTOR_LIMIT = 3
CAST_LIMIT = 5
DEFAULT_VOTE_QUANTILE = 0.90
DEFAULT_MIN_VOTES = 1000
MOVIE_TYPE = "movie"
CAST_CATEGORIES = ("actor", "actress")
CURATED_COLUMNS = [
    "tconst",
    "title",
    "primary_title",
    "director",
    "director_ids",
    "director_names",
    "genres",
    "score",
    "cast_ids",
    "actors",
]


def _mean_and_quantile(base: DataFrame, vote_quantile: float | None) -> DataFrame:
    """One-row frame ``(mean_rating, vote_quantile_value)``, exact.

    The rows are first counted per distinct vote number (partial sums before
    the shuffle); the interpolated quantile then comes from running counts
    over these distinct numbers only.
    """
    counts = base.groupBy("numVotes").agg(
        F.count(F.lit(1)).alias("n"), F.sum("averageRating").alias("ratings"), F.count("averageRating").alias("rated")
    )
    known = F.when(F.col("numVotes").isNotNull(), F.col("n")).otherwise(0)
    upto = Window.orderBy(F.col("numVotes").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("upto", F.sum(known).over(upto)).withColumn("total", F.sum(known).over(Window.partitionBy()))
    place = F.lit(float(vote_quantile if vote_quantile is not None else 0.0)) * (F.col("total") - 1)
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("numVotes")))
    found = ranked.agg(
        F.try_divide(F.sum("ratings"), F.sum("rated")).alias("mean_rating"),
        F.max(place).alias("place"), at(F.floor(place)).alias("low"), at(F.ceil(place)).alias("high"),
    )
    part = F.col("place") - F.floor("place")
    value = F.when(F.col("low") == F.col("high"), F.col("low").cast("double")).otherwise((1 - part) * F.col("low") + part * F.col("high"))
    return found.select("mean_rating", (value if vote_quantile is not None else F.lit(None)).cast("double").alias("vote_quantile_value"))


def vote_stats(base: DataFrame, vote_quantile: float | None, min_votes: int | None) -> DataFrame:
    """One-row frame ``(mean_rating, vote_quantile_value, threshold)``.

    ``threshold`` is the stricter of the active thresholds, 0 when none is
    active; it is also the ``m`` of the weighted score.
    """
    stats = _mean_and_quantile(base, vote_quantile)
    parts: list[Column] = []
    if vote_quantile is not None:
        parts.append(F.col("vote_quantile_value"))
    if min_votes is not None:
        parts.append(F.lit(float(min_votes)))
    if not parts:
        threshold = F.lit(0.0)
    elif len(parts) == 1:
        threshold = F.coalesce(parts[0], F.lit(0.0))
    else:
        threshold = F.greatest(*parts)
    return stats.withColumn("threshold", threshold.cast("double"))


def joined_movies(titles: DataFrame, ratings: DataFrame, crew: DataFrame) -> DataFrame:
    """Movies with a rating row and a crew row (both inner joins). Merge joins:
    a million titles pass the size check of a broadcast in their packed files,
    and would be unpacked in the driver."""
    movies = titles.where(F.col("titleType") == MOVIE_TYPE).select("tconst", "primaryTitle", "genres")
    return movies.join(ratings.select("tconst", "averageRating", "numVotes").hint("merge"), "tconst").join(
        crew.select("tconst", "directors").hint("merge"), "tconst"
    )


def score_titles(
    base: DataFrame,
    vote_quantile: float | None = DEFAULT_VOTE_QUANTILE,
    min_votes: int | None = DEFAULT_MIN_VOTES,
) -> DataFrame:
    """Keep rows with ``numVotes >= m`` and add the weighted ``score``.

    ``C`` and the quantile are computed over ``base`` *before* the vote
    filter. Both come from one scalar subquery (reused by Spark for every
    reference).
    """
    stats = vote_stats(base, vote_quantile, min_votes)
    s = stats.select(F.struct("mean_rating", "threshold").alias("s")).scalar()
    m = s.getField("threshold")
    c = s.getField("mean_rating")
    return base.where(F.col("numVotes").cast("double") >= m).withColumn(
        "score", weighted_score("numVotes", "averageRating", c, m)
    )


def director_lists(crew: DataFrame, names: DataFrame, limit: int = DIRECTOR_LIMIT) -> DataFrame:
    """``(tconst, director_ids, director_names)``, first ``limit`` ids in order.

    The limit applies to ids before the name lookup; unknown ids keep a null
    name in place.
    """
    ids = crew.select("tconst", split_ids("directors", limit).alias("ids"))
    exploded = ids.select("tconst", F.posexplode("ids").alias("pos", "nconst"))
    named = exploded.join(names.select("nconst", "primaryName"), "nconst", "left")
    return _ordered_lists(named, "pos", "director_ids", "director_names")


def _cast_credits(principals: DataFrame) -> DataFrame:
    """Actor/actress credits ``(tconst, ordering, nconst)``; without an
    ``ordering`` column the order falls back to the person id (Spark rows
    have no input order to preserve)."""
    order = F.col("ordering").cast("bigint") if "ordering" in principals.columns else F.lit(None).cast("bigint")
    return principals.where(F.col("category").isin(*CAST_CATEGORIES)).select("tconst", order.alias("ordering"), "nconst")


def cast_lists(principals: DataFrame, names: DataFrame, limit: int = CAST_LIMIT, keep: DataFrame | None = None) -> DataFrame:
    """``(tconst, cast_ids, actors)``: first ``limit`` actor/actress credits.

    Order is ``ordering`` then ``nconst`` (a deterministic tie-break). The
    limit is applied before the name lookup. ``keep`` (optional ``tconst``
    frame) restricts the output after the per-title limit.
    """
    cast = _cast_credits(principals)
    if keep is not None:  # before ranking, which needs the same partitioning
        cast = cast.join(keep.select("tconst"), "tconst", "left_semi")
    w = Window.partitionBy("tconst").orderBy(F.col("ordering").asc_nulls_last(), F.col("nconst"))
    top = cast.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit)
    named = top.join(names.select("nconst", "primaryName"), "nconst", "left")
    return _ordered_lists(named, "pos", "cast_ids", "actors")


def people_lists(
    crew: DataFrame,
    principals: DataFrame,
    names: DataFrame,
    keep: DataFrame,
    director_limit: int = DIRECTOR_LIMIT,
    cast_limit: int = CAST_LIMIT,
) -> DataFrame:
    """Director and cast lists of the ``keep`` titles in one pass:
    ``(tconst, director_ids, director_names, cast_ids, actors)``.

    Both credit kinds are unioned, joined with ``names`` once and grouped
    once (at most ``director_limit + cast_limit`` structs per title), which
    saves a join and a shuffle against building the two lists separately.
    """
    d = crew.join(keep.select("tconst"), "tconst", "left_semi").select(
        "tconst", F.posexplode(split_ids("directors", director_limit)).alias("pos", "nconst")
    ).withColumn("role", F.lit(0))
    # only the kept titles' credits are ranked; both steps need one partitioning
    cast = _cast_credits(principals).join(keep.select("tconst"), "tconst", "left_semi")
    w = Window.partitionBy("tconst").orderBy(F.col("ordering").asc_nulls_last(), F.col("nconst"))
    c = (
        cast.withColumn("pos", F.row_number().over(w))
        .where(F.col("pos") <= cast_limit)
        .select("tconst", "pos", "nconst", F.lit(1).alias("role"))
    )
    named = d.unionByName(c).join(names.select("nconst", "primaryName"), "nconst", "left")
    packed = named.groupBy("tconst").agg(
        F.array_sort(
            F.collect_list(F.struct("role", F.col("pos").alias("p"), F.col("nconst").alias("i"), F.col("primaryName").alias("n")))
        ).alias("xs")
    )
    dirs = F.filter("xs", lambda x: x["role"] == 0)
    cst = F.filter("xs", lambda x: x["role"] == 1)
    return packed.select(
        "tconst",
        F.transform(dirs, lambda x: x["i"]).alias("director_ids"),
        F.transform(dirs, lambda x: x["n"]).alias("director_names"),
        F.transform(cst, lambda x: x["i"]).alias("cast_ids"),
        F.transform(cst, lambda x: x["n"]).alias("actors"),
    )


def _ordered_lists(named: DataFrame, pos: str, ids_name: str, names_name: str) -> DataFrame:
    packed = named.groupBy("tconst").agg(
        F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("nconst").alias("i"), F.col("primaryName").alias("n")))).alias("xs")
    )
    return packed.select(
        "tconst",
        F.transform("xs", lambda x: x["i"]).alias(ids_name),
        F.transform("xs", lambda x: x["n"]).alias(names_name),
    )


def disambiguate(df: DataFrame, title_col: str = "primaryTitle") -> DataFrame:
    """Add ``primary_title`` (unchanged) and ``title`` (suffixed if duplicated).

    Duplicates are counted among the rows of ``df``; null titles count as one
    group (null-safe join).
    """
    counts = df.groupBy(F.col(title_col).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    joined = df.join(counts, df[title_col].eqNullSafe(counts["_t"]), "left")
    return joined.withColumn("primary_title", F.col(title_col)).withColumn(
        "title", disambiguated_title(F.col(title_col), F.col("tconst"), F.col("_n") > 1)
    ).drop("_t", "_n")


def curate(
    titles: DataFrame,
    crew: DataFrame,
    ratings: DataFrame,
    names: DataFrame,
    principals: DataFrame,
    vote_quantile: float | None = DEFAULT_VOTE_QUANTILE,
    min_votes: int | None = DEFAULT_MIN_VOTES,
    sort: bool = True,
    materialize_survivors: bool = True,
) -> DataFrame:
    """The curated catalogue with the fixed 10-column layout.

    Sorted by score descending (nulls last) then ``tconst`` when ``sort``.

    The surviving scored titles feed four branches (director lists, cast
    lists, duplicate counts, the output). With ``materialize_survivors``
    they are written once to the shared checkpoint folder (one job runs the
    three-way join and the threshold subquery); every branch then scans that
    small table instead of re-running the joins over the full inputs.
    """
    scored = score_titles(joined_movies(titles, ratings, crew), vote_quantile, min_votes)
    scored = scored.select("tconst", "primaryTitle", split_genres("genres").alias("genres"), "score")
    if materialize_survivors:
        scored = materialize(scored, "curate-survivors")
    keep = scored.select("tconst")
    out = scored.join(people_lists(crew, principals, names, keep), "tconst", "left")
    out = out.select(
        "tconst",
        "primaryTitle",
        "genres",
        "score",
        *[empty_if_null(c).alias(c) for c in ("director_ids", "director_names", "cast_ids", "actors")],
    ).withColumn("director", first_or_empty("director_names"))
    out = disambiguate(out).select(*CURATED_COLUMNS)
    if sort:
        out = out.orderBy(F.col("score").desc_nulls_last(), F.col("tconst"))
    return out


def curate_sources(src: dict[str, DataFrame], **kwargs) -> DataFrame:
    return curate(src["titles"], src["crew"], src["ratings"], src["names"], src["principals"], **kwargs)


__all__ = [
    "CURATED_COLUMNS",
    "DIRECTOR_LIMIT",
    "CAST_LIMIT",
    "vote_stats",
    "joined_movies",
    "score_titles",
    "director_lists",
    "cast_lists",
    "disambiguate",
    "curate",
    "curate_sources",
    "EMPTY_STRING_ARRAY",
]


# Natural keys of the raw sources (duplicates fan out the curation joins).
SOURCE_KEYS = {
    "titles": ["tconst"],
    "crew": ["tconst"],
    "ratings": ["tconst"],
    "names": ["nconst"],
    "principals": ["tconst", "ordering", "nconst"],
}


def source_key_violations(src: dict[str, DataFrame]) -> DataFrame:
    """``(source, key, rows)`` for every key value held by more than one row
    (partial aggregation per source; nothing reaches the driver)."""
    out = None
    for kind, key in SOURCE_KEYS.items():
        if kind not in src:
            continue
        keytext = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("\\N")) for k in key])
        v = (
            src[kind]
            .groupBy(*key)
            .agg(F.count(F.lit(1)).alias("rows"))
            .where(F.col("rows") > 1)
            .select(F.lit(kind).alias("source"), keytext.alias("key"), "rows")
        )
        out = v if out is None else out.unionByName(v)
    return out
