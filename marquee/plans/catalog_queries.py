"""Registered queries over the driver tables, with their DuckDB oracles.

Each query callable takes ``(spark, sf_dir)``, builds the catalogue source
tables from the driver tables (``marquee.sources.bindings``) and runs the
library operators over the whole input. Each oracle is an independent
brute-force statement of the same result in DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.scalars import list_text
from marquee.operators import curate as cu
from marquee.sources import bindings as b

# Parameters of the bound catalogue. Votes per title are 13-49 at every
# scale factor, so the reference default of 1000 minimum votes would keep
# nothing; the quantile path (0.9) is the active threshold.
VOTE_QUANTILE = 0.9
MIN_VOTES = 10

QUERIES: dict = {}
_ORACLES: dict[str, str | Callable[[], str]] = {}


def register(name: str, oracle: str | Callable[[], str] | None = None):
    """Register a query; an oracle given as a function is built on request."""
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return deco


def oracle_sql() -> dict[str, str]:
    return {name: sql() if callable(sql) else sql for name, sql in _ORACLES.items()}


def _with(sql: str) -> str:
    """Prefix the binding CTEs; ``sql`` continues the WITH list."""
    return "WITH " + b.BINDINGS_SQL.strip() + ",\n" + sql.strip()


def r6(c) -> F.Column:
    return F.round(c if not isinstance(c, str) else F.col(c), 6)


# --------------------------------------------------------------------------
# curation
# --------------------------------------------------------------------------

_BASE_SQL = f"""
base AS (
  SELECT t.tconst, t.primaryTitle, t.genres, r.averageRating, r.numVotes, c.directors
  FROM b_titles t JOIN b_ratings r USING (tconst) JOIN b_crew c USING (tconst)
  WHERE t.titleType = 'movie'),
stats AS (
  SELECT avg(averageRating) AS mean_rating,
         quantile_cont(numVotes, {VOTE_QUANTILE}) AS vote_quantile_value,
         greatest(quantile_cont(numVotes, {VOTE_QUANTILE}), {float(MIN_VOTES)}) AS threshold
  FROM base),
scored AS (
  SELECT base.*,
         numVotes / (numVotes + threshold) * averageRating
           + threshold / (threshold + numVotes) * mean_rating AS score
  FROM base, stats WHERE numVotes >= threshold)
"""

_DIRECTORS_SQL = r"""
d_ids AS (
  SELECT tconst,
         CASE WHEN directors IS NULL OR directors = '\N' THEN []
              ELSE list_filter(string_split(directors, ','), lambda x: x <> '' AND x <> '\N')[1:3] END AS ids
  FROM b_crew),
d_pos AS (SELECT tconst, unnest(ids) AS nconst, generate_subscripts(ids, 1) AS pos FROM d_ids),
d_lists AS (
  SELECT d.tconst,
         string_agg(d.nconst, '|' ORDER BY d.pos) AS director_ids,
         string_agg(coalesce(n.primaryName, '?'), '|' ORDER BY d.pos) AS director_names,
         CAST(count(*) AS BIGINT) AS n_directors,
         list(n.primaryName ORDER BY d.pos)[1] AS first_name,
         list(n.primaryName ORDER BY d.pos) AS director_names_l
  FROM d_pos d LEFT JOIN b_names n ON n.nconst = d.nconst
  GROUP BY d.tconst)
"""

_CAST_SQL = r"""
c_top AS (
  SELECT tconst, ordering, nconst,
         row_number() OVER (PARTITION BY tconst ORDER BY ordering, nconst) AS pos
  FROM b_principals WHERE category IN ('actor', 'actress')),
c_lists AS (
  SELECT c.tconst,
         string_agg(c.nconst, '|' ORDER BY c.pos) AS cast_ids,
         string_agg(coalesce(n.primaryName, '?'), '|' ORDER BY c.pos) AS actors,
         list(n.primaryName ORDER BY c.pos) AS actors_l,
         CAST(count(*) AS BIGINT) AS n_cast
  FROM c_top c LEFT JOIN b_names n ON n.nconst = c.nconst
  WHERE c.pos <= 5
  GROUP BY c.tconst)
"""

_CURATED_SQL = (
    _BASE_SQL
    + ","
    + _DIRECTORS_SQL
    + ","
    + _CAST_SQL
    + r""",
dup AS (SELECT primaryTitle, count(*) AS n FROM scored GROUP BY primaryTitle),
curated AS (
  SELECT s.tconst,
         CASE WHEN dup.n > 1 THEN s.primaryTitle || ' (' || s.tconst || ')' ELSE s.primaryTitle END AS title,
         s.primaryTitle AS primary_title,
         CASE WHEN d.tconst IS NULL THEN '' ELSE d.first_name END AS director,
         coalesce(d.director_ids, '') AS director_ids,
         coalesce(d.director_names, '') AS director_names,
         array_to_string(list_filter(string_split(s.genres, ','), lambda x: x <> '' AND x <> '\N'), '|') AS genres,
         round(s.score, 6) AS score,
         coalesce(c.cast_ids, '') AS cast_ids,
         coalesce(c.actors, '') AS actors,
         coalesce(c.actors_l, []) AS actors_l,
         list_filter(string_split(s.genres, ','), lambda x: x <> '' AND x <> '\N') AS genres_l
  FROM scored s
  LEFT JOIN dup ON dup.primaryTitle IS NOT DISTINCT FROM s.primaryTitle
  LEFT JOIN d_lists d ON d.tconst = s.tconst
  LEFT JOIN c_lists c ON c.tconst = s.tconst)
"""
)


def _sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return b.sources(spark, sf_dir)


def curated_typed(spark: SparkSession, sf_dir: str, sort: bool = False) -> DataFrame:
    return cu.curate_sources(_sources(spark, sf_dir), vote_quantile=VOTE_QUANTILE, min_votes=MIN_VOTES, sort=sort)


def curated_text(df: DataFrame) -> DataFrame:
    """Curated rows with list columns as text and a rounded score."""
    return df.select(
        "tconst",
        "title",
        "primary_title",
        "director",
        list_text("director_ids").alias("director_ids"),
        list_text("director_names").alias("director_names"),
        list_text("genres").alias("genres"),
        r6("score").alias("score"),
        list_text("cast_ids").alias("cast_ids"),
        list_text("actors").alias("actors"),
    )


@register(
    "weighted_score",
    _with(_BASE_SQL + """
SELECT tconst, numVotes, round(averageRating, 6) AS averageRating, round(score, 6) AS score FROM scored"""),
)
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _sources(spark, sf_dir)
    base = cu.joined_movies(src["titles"], src["ratings"], src["crew"])
    scored = cu.score_titles(base, VOTE_QUANTILE, MIN_VOTES)
    return scored.select("tconst", "numVotes", r6("averageRating").alias("averageRating"), r6("score").alias("score"))


@register(
    "vote_threshold_scalars",
    _with(_BASE_SQL + """
SELECT round(mean_rating, 6) AS mean_rating, round(vote_quantile_value, 6) AS vote_quantile_value,
       round(threshold, 6) AS threshold FROM stats"""),
)
def vote_threshold_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _sources(spark, sf_dir)
    base = cu.joined_movies(src["titles"], src["ratings"], src["crew"])
    st = cu.vote_stats(base, VOTE_QUANTILE, MIN_VOTES)
    return st.select(r6("mean_rating").alias("mean_rating"), r6("vote_quantile_value").alias("vote_quantile_value"), r6("threshold").alias("threshold"))


@register(
    "director_lists",
    _with(_DIRECTORS_SQL + """
SELECT tconst, director_ids, director_names, n_directors FROM d_lists"""),
)
def director_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _sources(spark, sf_dir)
    d = cu.director_lists(src["crew"], src["names"])
    return d.select(
        "tconst",
        list_text("director_ids").alias("director_ids"),
        list_text("director_names").alias("director_names"),
        F.size("director_ids").cast("bigint").alias("n_directors"),
    )


@register(
    "cast_lists",
    _with(_CAST_SQL + """
SELECT tconst, cast_ids, actors, n_cast FROM c_lists"""),
)
def cast_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _sources(spark, sf_dir)
    c = cu.cast_lists(src["principals"], src["names"])
    return c.select(
        "tconst",
        list_text("cast_ids").alias("cast_ids"),
        list_text("actors").alias("actors"),
        F.size("cast_ids").cast("bigint").alias("n_cast"),
    )


@register(
    "genre_split",
    _with(r"""
g AS (SELECT tconst, CASE WHEN genres IS NULL OR genres = '\N' THEN []
                          ELSE list_filter(string_split(genres, ','), lambda x: x <> '' AND x <> '\N') END AS gs
      FROM b_titles)
SELECT tconst, array_to_string(gs, '|') AS genres, CAST(len(gs) AS BIGINT) AS n_genres FROM g"""),
)
def genre_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.functions.scalars import split_genres

    t = b.titles(spark, sf_dir).select("tconst", split_genres("genres").alias("gs"))
    return t.select("tconst", F.array_join("gs", "|").alias("genres"), F.size("gs").cast("bigint").alias("n_genres"))


@register(
    "disambiguated_titles",
    _with(_BASE_SQL + """,
dup AS (SELECT primaryTitle, count(*) AS n FROM scored GROUP BY primaryTitle)
SELECT s.tconst,
       CASE WHEN dup.n > 1 THEN s.primaryTitle || ' (' || s.tconst || ')' ELSE s.primaryTitle END AS title,
       s.primaryTitle AS primary_title
FROM scored s LEFT JOIN dup ON dup.primaryTitle IS NOT DISTINCT FROM s.primaryTitle"""),
)
def disambiguated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _sources(spark, sf_dir)
    scored = cu.score_titles(cu.joined_movies(src["titles"], src["ratings"], src["crew"]), VOTE_QUANTILE, MIN_VOTES)
    return cu.disambiguate(scored).select("tconst", "title", "primary_title")


@register(
    "curated",
    _with(_CURATED_SQL + """
SELECT tconst, title, primary_title, director, director_ids, director_names, genres, score, cast_ids, actors
FROM curated"""),
)
def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curated_text(curated_typed(spark, sf_dir, sort=True))


# --------------------------------------------------------------------------
# term index and overlap recommendation
# --------------------------------------------------------------------------

from marquee.operators import index as ix  # noqa: E402
from marquee.operators import recommend as rc  # noqa: E402

# Recommendation parameters of the registered queries.
TOP_N = 10
CANDIDATE_LIMIT = 500
# A low document-frequency cut that makes genre-like terms "hot" at sf0.01,
# so the registered check also covers the sub-vector list path.
SPLIT_HOT_MIN_DF = 16

_CAT_SQL = (
    _CURATED_SQL
    + r""",
cat AS (SELECT tconst, title, score, director, actors_l, genres_l FROM curated),
tt AS (
  SELECT DISTINCT term, tconst FROM (
    SELECT tconst, regexp_replace(lower(v), '[^a-z0-9]+', '', 'g') AS term
    FROM (SELECT tconst, unnest(list_concat(actors_l, [director], genres_l)) AS v FROM cat))
  WHERE term IS NOT NULL AND term <> '')
"""
)


def _rec_sql(n: int | str, lim: int) -> str:
    """Closed-form recommendation for every catalogue title (brute force);
    ``n`` is a number or a scalar subquery."""
    k = f"least({lim}, {n})"
    return f"""
ov AS (
  SELECT a.tconst AS q, b.tconst AS c, CAST(count(*) AS BIGINT) AS overlap
  FROM tt a JOIN tt b USING (term) WHERE a.tconst <> b.tconst GROUP BY 1, 2),
st1 AS (
  SELECT * FROM (
    SELECT ov.q, ov.c, ov.overlap,
           row_number() OVER (PARTITION BY ov.q ORDER BY ov.overlap DESC, cat.score DESC, cat.title, ov.c) AS rk
    FROM ov JOIN cat ON cat.tconst = ov.c) WHERE rk <= {k}),
pool AS (SELECT tconst, title, score FROM cat ORDER BY score DESC, title LIMIT ({n} + 1)),
st2 AS (
  SELECT r.tconst AS q, p.tconst AS c,
         row_number() OVER (PARTITION BY r.tconst ORDER BY p.score DESC, p.title) AS rk
  FROM cat r CROSS JOIN pool p
  WHERE p.tconst <> r.tconst
    AND NOT EXISTS (SELECT 1 FROM st1 WHERE st1.q = r.tconst AND st1.c = p.tconst)),
u AS (
  SELECT q, c, 1 AS stage, rk, overlap, 'terms' AS source FROM st1
  UNION ALL SELECT q, c, 2, rk, CAST(NULL AS BIGINT), 'fallback' FROM st2),
recs AS (
  SELECT * FROM (
    SELECT u.q, u.c, u.overlap, u.source,
           CAST(row_number() OVER (PARTITION BY u.q ORDER BY u.stage, u.rk) AS INTEGER) AS rank
    FROM u) WHERE rank <= {n})
"""


def catalog_index(spark: SparkSession, sf_dir: str):
    """Titles and terms of the bound catalogue (score rounded to 6 places
    so both engines rank identical values)."""
    from marquee.plans.store import build_store

    cat = curated_typed(spark, sf_dir).withColumn("score", r6("score"))
    return build_store(cat)


@register("title_terms", _with(_CAT_SQL + "\nSELECT term, tconst FROM tt"))
def title_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, terms = catalog_index(spark, sf_dir)
    return terms


def _rec_columns(df: DataFrame) -> DataFrame:
    return df.select("query_tconst", "rank", "tconst", "title", "score", "overlap", "source")


_REC_SELECT = """
SELECT recs.q AS query_tconst, recs.rank, recs.c AS tconst, cat.title, cat.score, recs.overlap, recs.source
FROM recs JOIN cat ON cat.tconst = recs.c"""


@register("recommend_all", _with(_CAT_SQL + "," + _rec_sql(TOP_N, CANDIDATE_LIMIT) + _REC_SELECT))
def recommend_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles, terms = catalog_index(spark, sf_dir)
    return _rec_columns(rc.recommend_all(titles, terms, top_n=TOP_N, candidate_limit=CANDIDATE_LIMIT))


@register("recommend_all_hot_split", _with(_CAT_SQL + "," + _rec_sql(TOP_N, CANDIDATE_LIMIT) + _REC_SELECT))
def recommend_all_hot_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles, terms = catalog_index(spark, sf_dir)
    return _rec_columns(
        rc.recommend_all(titles, terms, top_n=TOP_N, candidate_limit=CANDIDATE_LIMIT, hot_min_df=SPLIT_HOT_MIN_DF)
    )


@register("recommend_fallback", _with(_CAT_SQL + "," + _rec_sql(5, 1) + _REC_SELECT))
def recommend_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate limit 1: one term-ranked title, the rest by score."""
    titles, terms = catalog_index(spark, sf_dir)
    return _rec_columns(rc.recommend_all(titles, terms, top_n=5, candidate_limit=1))


@register(
    "candidates_bounded",
    _with(
        _CAT_SQL
        + """,
ov AS (
  SELECT a.tconst AS q, b.tconst AS c, CAST(count(*) AS BIGINT) AS overlap
  FROM tt a JOIN tt b USING (term) WHERE a.tconst <> b.tconst GROUP BY 1, 2),
rk AS (
  SELECT ov.q, ov.c, ov.overlap,
         CAST(row_number() OVER (PARTITION BY ov.q ORDER BY ov.overlap DESC, cat.score DESC, cat.title, ov.c) AS INTEGER) AS rank
  FROM ov JOIN cat ON cat.tconst = ov.c)
SELECT q AS query_tconst, rank, c AS tconst, overlap FROM rk WHERE rank <= 25"""
    ),
)
def candidates_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles, terms = catalog_index(spark, sf_dir)
    return rc.candidates(titles, terms, candidate_limit=25, hot_min_df=SPLIT_HOT_MIN_DF)


@register(
    "recommend_requests_with_errors",
    _with(
        _CAT_SQL
        + ","
        + _rec_sql(TOP_N, CANDIDATE_LIMIT)
        + """,
req AS (SELECT CAST(p_partkey AS VARCHAR) AS request_id, p_name AS query FROM part),
res AS (SELECT req.request_id, req.query, cat.tconst AS q FROM req LEFT JOIN cat ON cat.title = req.query)
SELECT res.request_id, res.query, res.q AS query_tconst, recs.rank, recs.c AS tconst, cat.title, cat.score,
       recs.overlap, recs.source, CAST(NULL AS VARCHAR) AS error
FROM res JOIN recs ON recs.q = res.q JOIN cat ON cat.tconst = recs.c
UNION ALL
SELECT request_id, query, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'This movie is not in the dataset.'
FROM res WHERE q IS NULL"""
    ),
)
def recommend_requests_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part name is a request; bare duplicate titles are not findable."""
    titles, terms = catalog_index(spark, sf_dir)
    part = b.table(spark, sf_dir, "part")
    requests = part.select(F.col("p_partkey").cast("string").alias("request_id"), F.col("p_name").alias("title"))
    return rc.recommend(titles, terms, requests, top_n=TOP_N, candidate_limit=CANDIDATE_LIMIT)


# --------------------------------------------------------------------------
# evaluation
# --------------------------------------------------------------------------

from marquee.operators import evaluate as ev  # noqa: E402

_EVAL_SQL = (
    _CAT_SQL
    + ","
    + _rec_sql("(SELECT max(top_n) FROM b_cases)", CANDIDATE_LIMIT)
    + """,
res AS (SELECT c.*, cat.tconst AS q FROM b_cases c LEFT JOIN cat ON cat.title = c.query),
crec AS (
  SELECT res.id, list(cat.title ORDER BY recs.rank) AS recs
  FROM res JOIN recs ON recs.q = res.q AND recs.rank <= res.top_n JOIN cat ON cat.tconst = recs.c
  GROUP BY res.id),
cr AS (
  SELECT res.id, res.query, res.top_n, res.expected_good, res.expected_bad, res.expected_error,
         coalesce(crec.recs, []) AS recs,
         CASE WHEN res.q IS NULL THEN 'This movie is not in the dataset.' END AS error
  FROM res LEFT JOIN crec USING (id)),
fin AS (
  SELECT *,
         list_filter(expected_good, lambda x: NOT list_contains(recs, x)) AS missing_good,
         list_filter(expected_bad, lambda x: list_contains(recs, x)) AS present_bad,
         coalesce(nullif(expected_error, '') IS NOT NULL AND error IS NOT NULL AND contains(error, expected_error), false) AS error_hit
  FROM cr),
fin2 AS (
  SELECT *,
         CASE WHEN nullif(expected_error, '') IS NOT NULL THEN error_hit AND len(recs) = 0
              ELSE error IS NULL AND len(missing_good) = 0 AND len(present_bad) = 0 END AS passed
  FROM fin)
"""
)


def _eval_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles, terms = catalog_index(spark, sf_dir)
    cases = b.eval_cases(spark, sf_dir)
    return ev.case_results(cases, titles, terms, candidate_limit=CANDIDATE_LIMIT)


@register(
    "evaluate_cases",
    _with(
        _EVAL_SQL
        + """
SELECT id, query, top_n, array_to_string(recs, '|') AS recommendations, error,
       array_to_string(missing_good, '|') AS missing_good, array_to_string(present_bad, '|') AS present_bad, passed
FROM fin2"""
    ),
)
def evaluate_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _eval_results(spark, sf_dir)
    return r.select(
        "id",
        "query",
        "top_n",
        F.array_join("recommendations", "|").alias("recommendations"),
        "error",
        F.array_join("missing_good", "|").alias("missing_good"),
        F.array_join("present_bad", "|").alias("present_bad"),
        "passed",
    )


@register(
    "evaluate_report",
    _with(
        _EVAL_SQL
        + """
SELECT CAST(count(*) AS BIGINT) AS cases_total,
       CAST(count(*) FILTER (WHERE passed) AS BIGINT) AS cases_passed,
       CAST(sum(len(expected_good) - len(missing_good)) AS BIGINT) AS expected_good_hits,
       CAST(sum(len(expected_good)) AS BIGINT) AS expected_good_total,
       CAST(sum(len(expected_bad) - len(present_bad)) AS BIGINT) AS expected_bad_absent,
       CAST(sum(len(expected_bad)) AS BIGINT) AS expected_bad_total,
       CAST(count(*) FILTER (WHERE error_hit) AS BIGINT) AS expected_error_hits,
       CAST(count(*) FILTER (WHERE nullif(expected_error, '') IS NOT NULL) AS BIGINT) AS expected_error_total,
       coalesce(bool_and(passed), true) AS passed
FROM fin2"""
    ),
)
def evaluate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.report(_eval_results(spark, sf_dir))


# --------------------------------------------------------------------------
# cosine recommendation
# --------------------------------------------------------------------------

from marquee.functions.text import default_stop_words  # noqa: E402
from marquee.operators import cosine as co  # noqa: E402


def _cosine_sql(n: int) -> str:
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in default_stop_words())
    return (
        _CAT_SQL
        + f""",
toks AS (
  SELECT tconst, tok FROM (
    SELECT tconst, unnest(regexp_split_to_array(lower(replace(v, ' ', '')), '[^a-zA-Z0-9_]+')) AS tok
    FROM (SELECT tconst, unnest(list_concat(actors_l, [director, director], genres_l)) AS v FROM cat)
    WHERE v IS NOT NULL)
  WHERE length(tok) >= 2 AND tok NOT IN ({stop})),
tf AS (SELECT tconst, tok, CAST(count(*) AS BIGINT) AS w FROM toks GROUP BY 1, 2),
nrm AS (SELECT tconst, sum(w * w) AS n2 FROM tf GROUP BY 1),
dots AS (
  SELECT a.tconst AS q, b.tconst AS c, sum(a.w * b.w) AS dot
  FROM tf a JOIN tf b USING (tok) WHERE a.tconst <> b.tconst GROUP BY 1, 2),
sims AS (
  SELECT q, c, dot / (sqrt(nq.n2) * sqrt(nc.n2)) AS sim
  FROM dots JOIN nrm nq ON nq.tconst = dots.q JOIN nrm nc ON nc.tconst = dots.c),
st1 AS (SELECT * FROM (SELECT q, c, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) AS rk FROM sims) WHERE rk <= {n}),
pool AS (SELECT tconst FROM cat ORDER BY tconst LIMIT ({n} + 1)),
st2 AS (
  SELECT r.tconst AS q, p.tconst AS c, row_number() OVER (PARTITION BY r.tconst ORDER BY p.tconst) AS rk
  FROM cat r CROSS JOIN pool p
  WHERE p.tconst <> r.tconst AND NOT EXISTS (SELECT 1 FROM st1 WHERE st1.q = r.tconst AND st1.c = p.tconst)),
u AS (SELECT q, c, 1 AS stage, rk, sim, 'similar' AS source FROM st1
      UNION ALL SELECT q, c, 2, rk, 0.0, 'zero' FROM st2),
recs AS (
  SELECT * FROM (
    SELECT q, c, sim, source, CAST(row_number() OVER (PARTITION BY q ORDER BY stage, rk) AS INTEGER) AS rank FROM u)
  WHERE rank <= {n})
SELECT recs.q AS query_tconst, recs.rank, recs.c AS tconst, cat.title, round(recs.sim, 9) AS similarity, recs.source
FROM recs JOIN cat ON cat.tconst = recs.c"""
    )


def _cosine(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    from marquee.session import materialize

    cat = materialize(curated_typed(spark, sf_dir).withColumn("score", r6("score")), "cosine-catalog")
    r = co.cosine_recommend(cat, top_n=TOP_N, **kw)
    return r.select("query_tconst", "rank", "tconst", "title", F.round("similarity", 9).alias("similarity"), "source")


@register("cosine_recommend", lambda: _with(_cosine_sql(TOP_N)))
def cosine_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cosine(spark, sf_dir)


@register("cosine_recommend_hot_split", lambda: _with(_cosine_sql(TOP_N)))
def cosine_recommend_hot_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cosine(spark, sf_dir, hot_min_df=SPLIT_HOT_MIN_DF)


# --------------------------------------------------------------------------
# files: raw sources, curated CSV, inventory, fingerprint, staleness
# --------------------------------------------------------------------------

from marquee.session import scratch_path  # noqa: E402
from marquee.sources import curated_io as cio  # noqa: E402
from marquee.sources import inventory as inv  # noqa: E402
from marquee.sources import raw  # noqa: E402


def _written_sources(spark: SparkSession, sf_dir: str) -> str:
    """The bound source tables written as tab-separated source files."""
    folder = scratch_path(spark, "sources")
    raw.write_sources(_sources(spark, sf_dir), folder)
    return folder


@register("curate_files_roundtrip", _with(_CURATED_SQL + """
SELECT tconst, title, primary_title, director, director_ids, director_names, genres, score, cast_ids, actors
FROM curated"""))
def curate_files_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources → TSV files → the file job (read, curate, write CSV+Parquet)."""
    from marquee.plans.jobs import curate_files

    folder = _written_sources(spark, sf_dir)
    res = curate_files(spark, folder, scratch_path(spark, "curated"), vote_quantile=VOTE_QUANTILE, min_votes=MIN_VOTES)
    return curated_text(res.curated)


@register("curated_csv_terms", _with(_CAT_SQL + "\nSELECT term, tconst FROM tt"))
def curated_csv_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated → CSV with list literals → read back as text → index terms."""
    path = cio.write_curated_csv(curated_typed(spark, sf_dir), scratch_path(spark, "curated-csv"))
    _, terms = ix.build_index(cio.read_curated_csv(spark, path))
    return terms


@register(
    "duplicate_title_check",
    _with(_BASE_SQL + """
SELECT primaryTitle AS title, CAST(count(*) AS BIGINT) AS title_count FROM scored GROUP BY primaryTitle HAVING count(*) > 1"""),
)
def duplicate_title_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _sources(spark, sf_dir)
    scored = cu.score_titles(cu.joined_movies(src["titles"], src["ratings"], src["crew"]), VOTE_QUANTILE, MIN_VOTES)
    return ix.duplicate_titles(scored.select(F.col("primaryTitle").alias("title"), "genres", F.lit("").alias("director"), "score", F.lit("[]").alias("actors")))


def _violation_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in store input with defects: shorts carry no id, titles are the
    raw part names, titles rated from fewer than 20 lines carry a non-number
    score."""
    t = b.titles(spark, sf_dir)
    r = b.ratings(spark, sf_dir)
    j = t.join(r, "tconst")
    return j.select(
        F.when(F.col("titleType") == "short", F.lit(None)).otherwise(F.col("tconst")).alias("tconst"),
        F.col("primaryTitle").alias("title"),
        F.lit("").alias("director"),
        F.col("genres"),
        F.when(F.col("numVotes") < 20, F.lit("n/a")).otherwise(F.col("averageRating").cast("string")).alias("score"),
        F.lit("[]").alias("actors"),
    )


@register(
    "score_violations",
    _with(r"""
vc AS (
  SELECT CASE WHEN t.titleType = 'short' THEN NULL ELSE t.tconst END AS tconst, t.primaryTitle AS title,
         CASE WHEN r.numVotes < 20 THEN 'n/a' ELSE CAST(r.averageRating AS VARCHAR) END AS score
  FROM b_titles t JOIN b_ratings r USING (tconst)),
cnt AS (SELECT title, count(*) AS n FROM vc GROUP BY title)
SELECT 'duplicate_title_without_id' AS kind, vc.title,
       'Dataset contains duplicate title values and no tconst values to disambiguate them.' AS detail
FROM vc JOIN cnt USING (title) WHERE cnt.n > 1 AND vc.tconst IS NULL
UNION ALL
SELECT 'bad_score', title, 'score is not a number' FROM vc WHERE TRY_CAST(score AS DOUBLE) IS NULL"""),
)
def score_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.violations(_violation_catalog(spark, sf_dir)).select("kind", "title", "detail")


@register(
    "source_inventory",
    lambda: "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{n}.gz', 'skip')" for k, n in raw.SOURCE_FILES.items()) + ") AS t(kind, file_name, action)",
)
def source_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written source folder against the required manifest."""
    folder = _written_sources(spark, sf_dir)
    return inv.source_inventory(spark, folder).select("kind", "file_name", "action")


@register("source_fingerprint")
def source_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows only: path, size, mtime and SHA-256 of every curated CSV part."""
    path = cio.write_curated_csv(curated_typed(spark, sf_dir), scratch_path(spark, "curated-csv"))
    return inv.fingerprint(spark, path)


@register("staleness")
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows only: a rewritten dataset against the stored fingerprint."""
    path = cio.write_curated_csv(curated_typed(spark, sf_dir), scratch_path(spark, "curated-csv"))
    stored_path = scratch_path(spark, "snapshots")
    inv.fingerprint(spark, path).write.parquet(stored_path)
    cio.write_curated_csv(curated_typed(spark, sf_dir).where(F.col("score") > 0), path)
    return inv.staleness(inv.fingerprint(spark, path), spark.read.parquet(stored_path))


@register(
    "row_ids",
    _with(
        _CURATED_SQL
        + """
SELECT 'row:' || CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, tconst) AS VARCHAR) AS tconst, title FROM curated"""
    ),
)
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row:N`` ids for catalogue files written in order, without ids."""
    ordered = curated_typed(spark, sf_dir).orderBy(F.col("score").desc_nulls_last(), "tconst").drop("tconst")
    path = cio.write_curated_csv(ordered, scratch_path(spark, "noid-csv"))
    titles, _ = ix.build_index(cio.read_curated_csv(spark, path))
    return titles.select("tconst", "title")


# --------------------------------------------------------------------------
# serving contract (second tier): search, text features, credits, ids
# --------------------------------------------------------------------------

from marquee.operators import features as fe  # noqa: E402
from marquee.operators import search as se_  # noqa: E402

_TRGM_SQL = """
list_distinct(flatten(list_transform(
    list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> ''),
    lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"""


def _movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fe.movies_from_curated(curated_typed(spark, sf_dir))


_MOVIES_SQL = r"""
movies AS (
  SELECT tconst, coalesce(primary_title, regexp_replace(title, ' \(tt[0-9]+\)$', '')) AS display_title,
         primary_title, round(score, 6) AS weighted_score
  FROM curated)
"""


@register(
    "fuzzy_title_search",
    _with(
        _CURATED_SQL
        + ","
        + _MOVIES_SQL
        + f""",
req AS (
  SELECT DISTINCT p_name || '|' || query AS request_id, query
  FROM (SELECT p_name, unnest([p_name, substring(p_name, 1, length(p_name) - 1)]) AS query FROM part)),
rg AS (SELECT request_id, query, {_TRGM_SQL.format(x='query')} AS g FROM req),
mg AS (SELECT *, {_TRGM_SQL.format(x='display_title')} AS dg, {_TRGM_SQL.format(x='primary_title')} AS pg FROM movies),
sims AS (
  SELECT rg.request_id, rg.query, mg.tconst, mg.display_title, mg.primary_title, mg.weighted_score,
         greatest(
           CASE WHEN len(list_distinct(list_concat(dg, g))) = 0 THEN 0.0
                ELSE len(list_intersect(dg, g)) / len(list_distinct(list_concat(dg, g))) END,
           CASE WHEN len(list_distinct(list_concat(pg, g))) = 0 THEN 0.0
                ELSE len(list_intersect(pg, g)) / len(list_distinct(list_concat(pg, g))) END) AS title_similarity
  FROM rg CROSS JOIN mg),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY request_id
             ORDER BY title_similarity DESC, weighted_score DESC NULLS LAST, display_title, tconst) AS INTEGER) AS rank
  FROM sims WHERE title_similarity >= 0.3)
SELECT request_id, query, rank, tconst, display_title, primary_title, weighted_score, round(title_similarity, 9) AS title_similarity
FROM ranked WHERE rank <= 10"""
    ),
)
def fuzzy_title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct part name, as it is and with its last letter missing,
    searched over the served movies (display title from the backfill rule)."""
    movies = _movies(spark, sf_dir).withColumn("weighted_score", r6("weighted_score"))
    part = b.table(spark, sf_dir, "part")
    asked = F.explode(F.array(F.col("p_name"), F.expr("substring(p_name, 1, length(p_name) - 1)")))
    req = part.select("p_name", asked.alias("query")).select(F.concat_ws("|", "p_name", "query").alias("request_id"), "query").distinct()
    r = se_.fuzzy_title_search(movies, req, threshold=0.3, limit=10)
    return r.withColumn("title_similarity", F.round("title_similarity", 9))


_SOUP_SQL = r"""
soup AS (
  SELECT tconst,
         concat_ws(' | ',
           trim(regexp_replace(lower(primary_title), '\s+', ' ', 'g')),
           array_to_string(list_transform(genres_l, lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g'))), ', '),
           array_to_string(list_transform(list_filter(director_names_l[1:3], lambda x: x IS NOT NULL),
                                          lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g'))), ', '),
           array_to_string(list_transform(list_filter(actors_l[1:5], lambda x: x IS NOT NULL),
                                          lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g'))), ', ')) AS source_text
  FROM curated2)
"""

_CURATED2_SQL = (
    _CURATED_SQL
    + """,
curated2 AS (
  SELECT c.*, coalesce(d.director_names_l, []) AS director_names_l
  FROM curated c LEFT JOIN d_lists d USING (tconst))
"""
)


@register(
    "text_feature_soup",
    _with(
        _CURATED2_SQL
        + ","
        + _SOUP_SQL
        + """
SELECT tconst, 'recommendation_soup' AS feature_name, 'v1' AS feature_version, source_text,
       sha256(source_text) AS source_text_sha256
FROM soup"""
    ),
)
def text_feature_soup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fe.recommendation_soup(curated_typed(spark, sf_dir)).drop("build_method")


@register(
    "strip_title_suffix",
    _with(
        _CURATED_SQL
        + r"""
SELECT tconst, title, regexp_replace(title, ' \(tt[0-9]+\)$', '') AS display_title FROM curated"""
    ),
)
def strip_title_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = curated_typed(spark, sf_dir)
    return c.select("tconst", "title", fe.strip_title_suffix("title").alias("display_title"))


@register(
    "credits_union",
    _with(
        r"""
cd AS (
  SELECT tconst, unnest(ids) AS nconst, generate_subscripts(ids, 1) AS credit_order FROM (
    SELECT tconst, CASE WHEN directors IS NULL OR directors = '\N' THEN []
                        ELSE list_filter(string_split(directors, ','), lambda x: x <> '' AND x <> '\N') END AS ids
    FROM b_crew)),
cw AS (
  SELECT tconst, unnest(ids) AS nconst, generate_subscripts(ids, 1) AS credit_order FROM (
    SELECT tconst, CASE WHEN writers = '\N' THEN [] ELSE string_split(writers, ',') END AS ids FROM b_crew)),
d AS (
  SELECT tconst, nconst, 'director' AS role_type, CAST(credit_order AS BIGINT) AS credit_order, 'crew' AS source, NULL AS category FROM cd
  UNION ALL SELECT tconst, nconst, 'writer', CAST(credit_order AS BIGINT), 'crew', NULL FROM cw),
p AS (
  SELECT p.tconst, p.nconst, p.category AS role_type, CAST(p.ordering AS BIGINT) AS credit_order, 'principals' AS source, p.category
  FROM b_principals p
  WHERE p.nconst IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM d WHERE d.tconst = p.tconst AND d.nconst = p.nconst AND d.role_type = p.category)),
u AS (SELECT * FROM d UNION ALL SELECT * FROM p)
SELECT DISTINCT ON (tconst, nconst, role_type, credit_order) tconst, nconst, role_type, credit_order, source, category FROM u"""
    ),
)
def credits_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _sources(spark, sf_dir)
    return fe.credits(src["crew"], src["principals"]).drop("job")


@register(
    "id_validation",
    _with(
        _BASE_SQL
        + """,
ids AS (
  SELECT tconst AS id FROM scored
  UNION ALL SELECT 'row:' || CAST(p_partkey AS VARCHAR) FROM part)
SELECT id, coalesce(regexp_matches(id, '^tt[0-9]+$'), false) AS accepted FROM ids"""
    ),
)
def id_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store ids to backfill: curated ids plus synthetic ``row:N`` ids of all
    parts (as a store built without ids would carry)."""
    src = _sources(spark, sf_dir)
    scored = cu.score_titles(cu.joined_movies(src["titles"], src["ratings"], src["crew"]), VOTE_QUANTILE, MIN_VOTES)
    part = b.table(spark, sf_dir, "part")
    ids = scored.select("tconst").unionByName(
        part.select(F.concat(F.lit("row:"), F.col("p_partkey").cast("string")).alias("tconst"))
    )
    return fe.validate_ids(ids)


# --------------------------------------------------------------------------
# vectors
# --------------------------------------------------------------------------

from marquee.operators import vectors as vx  # noqa: E402

VECTOR_DIM = 64

_VEC_SQL = """
u AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
nrm AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS n FROM u GROUP BY 1),
dots AS (
  SELECT a.vec_id AS q, b.vec_id AS c, sum(CAST(a.x AS DOUBLE) * CAST(b.x AS DOUBLE)) AS dot
  FROM u a JOIN u b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY 1, 2),
dist AS (
  SELECT dots.q, dots.c, 1.0 - dot / (nq.n * nc.n) AS distance
  FROM dots JOIN nrm nq ON nq.vec_id = dots.q JOIN nrm nc ON nc.vec_id = dots.c
  WHERE nq.n > 0 AND nc.n > 0)
"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("id"), "embedding", "label")


@register(
    "vector_topk",
    "WITH "
    + _VEC_SQL.strip()
    + """,
r AS (SELECT q, c, distance, row_number() OVER (PARTITION BY q ORDER BY distance, CAST(c AS VARCHAR)) AS rank FROM dist)
SELECT CAST(q AS VARCHAR) AS q, CAST(c AS VARCHAR) AS c, CAST(rank AS INTEGER) AS rank, round(distance, 9) AS distance
FROM r WHERE rank <= 10""",
)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = vx.vector_topk(_vectors(spark, sf_dir), k=10, block_rows=256)
    return r.select("q", "c", "rank", F.round("distance", 9).alias("distance"))


@register(
    "vector_rerank_label",
    "WITH "
    + _VEC_SQL.strip()
    + """,
r AS (SELECT q, c, distance, row_number() OVER (PARTITION BY q ORDER BY distance, CAST(c AS VARCHAR)) AS rank FROM dist),
cand AS (SELECT r.*, (lq.label = lc.label) AS same_label FROM r
         JOIN (SELECT DISTINCT vec_id, label FROM embeddings) lq ON lq.vec_id = r.q
         JOIN (SELECT DISTINCT vec_id, label FROM embeddings) lc ON lc.vec_id = r.c
         WHERE rank <= 50),
rr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY same_label DESC, distance, CAST(c AS VARCHAR)) AS rerank FROM cand)
SELECT CAST(q AS VARCHAR) AS q, CAST(c AS VARCHAR) AS c, CAST(rerank AS INTEGER) AS rerank, same_label, round(distance, 9) AS distance
FROM rr WHERE rerank <= 10""",
)
def vector_rerank_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded vector candidates (50) re-ranked by label agreement."""
    v = _vectors(spark, sf_dir)
    cands = vx.vector_topk(v, k=50, block_rows=256)
    labels = v.select("id", "label")
    j = cands.join(labels.select(F.col("id").alias("q"), F.col("label").alias("ql")), "q").join(
        labels.select(F.col("id").alias("c"), F.col("label").alias("cl")), "c"
    )
    j = j.withColumn("same_label", F.col("ql") == F.col("cl"))
    r = vx.rerank_by_metadata(j, F.col("same_label"), 10)
    return r.select("q", "c", F.col("rerank").cast("int"), "same_label", F.round("distance", 9).alias("distance"))


@register(
    "embedding_integrity",
    _with(
        _CURATED_SQL
        + f""",
e AS (SELECT 'tt' || lpad(CAST(vec_id AS VARCHAR), 7, '0') AS id, embedding FROM embeddings)
SELECT id, 'dimension' AS problem FROM e
WHERE embedding IS NULL OR len(embedding) <> {VECTOR_DIM} OR list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x)))
UNION ALL SELECT id, 'orphan' FROM e WHERE id NOT IN (SELECT tconst FROM curated)"""
    ),
)
def embedding_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of wrong size or content, and those of titles that have no
    text feature (every title outside the curated catalogue)."""
    emb, _ = _title_embeddings(spark, sf_dir)
    features = fe.recommendation_soup(curated_typed(spark, sf_dir))
    return vx.embedding_integrity(emb.withColumnRenamed("tconst", "id"), VECTOR_DIM, features.select(F.col("tconst").alias("id")))


# Embedding slice binding: every driver embedding belongs to one configured
# model; vector ``vec_id`` is the part key of its title.
EMB_MODEL = ("configured-model", "v1", VECTOR_DIM)


def _title_embeddings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = b.table(spark, sf_dir, "embeddings")
    emb = e.select(
        F.concat(F.lit("tt"), F.lpad(F.col("vec_id").cast("string"), 7, "0")).alias("tconst"),
        "embedding",
        F.lit(EMB_MODEL[0]).alias("model_name"),
        F.lit(EMB_MODEL[1]).alias("model_version"),
        F.lit(EMB_MODEL[2]).alias("vector_dimension"),
        F.lit(True).alias("active"),
    )
    config = spark.createDataFrame([EMB_MODEL], "model_name string, model_version string, vector_dimension int")
    return emb, config


@register(
    "embedding_fallback",
    _with(
        _CAT_SQL
        + ","
        + _rec_sql(TOP_N, CANDIDATE_LIMIT)
        + """,
emb AS (SELECT 'tt' || lpad(CAST(vec_id AS VARCHAR), 7, '0') AS tconst, embedding FROM embeddings),
ve AS (SELECT emb.tconst, emb.embedding, cat.title, cat.score FROM emb JOIN cat USING (tconst)),
vu AS (SELECT tconst, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM ve),
vn AS (SELECT tconst, sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS n FROM vu GROUP BY 1),
vd AS (
  SELECT a.tconst AS q, b.tconst AS c, sum(CAST(a.x AS DOUBLE) * CAST(b.x AS DOUBLE)) AS dot
  FROM vu a JOIN vu b ON a.i = b.i AND a.tconst <> b.tconst GROUP BY 1, 2),
vdist AS (
  SELECT vd.q, vd.c, 1.0 - dot / (nq.n * nc.n) AS distance, ve.title, ve.score
  FROM vd JOIN vn nq ON nq.tconst = vd.q JOIN vn nc ON nc.tconst = vd.c JOIN ve ON ve.tconst = vd.c
  WHERE nq.n > 0 AND nc.n > 0),
vr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, score DESC NULLS LAST, title, c) AS rank FROM vdist)
SELECT q AS query_tconst, CAST(rank AS INTEGER) AS rank, c AS tconst, title, 'vector' AS source, round(distance, 9) AS distance
FROM vr WHERE rank <= 10
UNION ALL
SELECT recs.q, recs.rank, recs.c, cat.title, recs.source, NULL
FROM recs JOIN cat ON cat.tconst = recs.c
WHERE recs.q NOT IN (SELECT tconst FROM ve)"""
    ),
)
def embedding_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marquee.plans.serving import recommend_with_fallback

    titles, terms = catalog_index(spark, sf_dir)
    emb, config = _title_embeddings(spark, sf_dir)
    r = recommend_with_fallback(titles, terms, emb, config, top_n=TOP_N, candidate_limit=CANDIDATE_LIMIT, block_rows=256)
    return r.withColumn("distance", F.round("distance", 9))


# --------------------------------------------------------------------------
# upserts, provenance, external ids, feature versions
# --------------------------------------------------------------------------

from marquee.operators import lineage as ln  # noqa: E402


@register(
    "upsert_latest",
    """
WITH r AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn,
         min(ts) OVER (PARTITION BY user_id, event_type) AS first_seen,
         max(ts) OVER (PARTITION BY user_id, event_type) AS last_seen,
         count(*) OVER (PARTITION BY user_id, event_type) AS versions
  FROM events)
SELECT user_id, event_type, event_id, ts, round(value, 6) AS value, props, first_seen, last_seen,
       CAST(versions AS BIGINT) AS versions, true AS active
FROM r WHERE rn = 1""",
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events keyed by (user, event type), loaded in two batches (before and
    after the middle of their time range); the latest row by time wins."""
    ev_ = b.table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    mid = ev_.select(((F.min(micros) + F.max(micros)) / 2).alias("m")).scalar()
    first = ev_.where(micros <= mid)
    second = ev_.where(micros > mid)
    out = ln.upsert_latest(first, second, ["user_id", "event_type"], ["ts", "event_id"])
    return out.select(
        "user_id", "event_type", "event_id", "ts", F.round("value", 6).alias("value"), "props", "first_seen", "last_seen", "versions", "active"
    )


@register(
    "row_hash_provenance",
    _with(
        _CURATED_SQL
        + """
SELECT 'movies' AS table_name, tconst AS entity_key,
       sha256(concat_ws(chr(31), coalesce(tconst, '\\N'), coalesce(title, '\\N'), coalesce(primary_title, '\\N'),
                        coalesce(director, '\\N'), coalesce(CAST(CAST(round(score * 1000000) AS BIGINT) AS VARCHAR), '\\N'))) AS source_row_sha256,
       CAST(1 AS BIGINT) AS etl_run_id
FROM curated"""
    ),
)
def row_hash_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = curated_typed(spark, sf_dir).withColumn("score_micros", F.round(F.col("score") * 1000000).cast("bigint"))
    p = ln.row_provenance(c, "movies", ["tconst"], ["tconst", "title", "primary_title", "director", "score_micros"], 0, 1)
    return p.select("table_name", "entity_key", "source_row_sha256", "etl_run_id")


@register(
    "external_id_resolve",
    """
WITH bridge AS (SELECT 'part' AS source_name, CAST(p_partkey AS VARCHAR) AS source_id,
                       'tt' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS tconst FROM part),
rows AS (SELECT 'part' AS source_name, CAST(vec_id AS VARCHAR) AS source_id, vec_id FROM embeddings)
SELECT rows.vec_id, rows.source_id, bridge.tconst, bridge.tconst IS NOT NULL AS resolved
FROM rows LEFT JOIN bridge USING (source_name, source_id)""",
)
def external_id_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding rows carry a part id as external id; the bridge maps part
    ids to title ids."""
    part = b.table(spark, sf_dir, "part")
    bridge = part.select(
        F.lit("part").alias("source_name"),
        F.col("p_partkey").cast("string").alias("source_id"),
        F.concat(F.lit("tt"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("tconst"),
    )
    rows = b.table(spark, sf_dir, "embeddings").select(
        F.lit("part").alias("source_name"), F.col("vec_id").cast("string").alias("source_id"), "vec_id"
    )
    return ln.resolve_external_ids(rows, bridge).select("vec_id", "source_id", "tconst", "resolved")


@register("snapshot_run_trace")
def snapshot_run_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows only: all five written source files registered as snapshots of
    run 1, the curated movies' provenance, traced back from the run."""
    folder = _written_sources(spark, sf_dir)
    fps = reduce(DataFrame.unionByName, [inv.fingerprint(spark, f"{folder}/{name}") for name in raw.SOURCE_FILES.values()])
    snaps = ln.register_snapshots(fps, "raw_tsv", "sources", "2026-01-01")
    _, bridge = ln.run_log(snaps, 1, "raw_load")
    movies = curated_typed(spark, sf_dir)
    sid = snaps.agg(F.min("source_snapshot_id")).scalar()
    prov = ln.row_provenance(movies, "movies", ["tconst"], ["tconst", "title", "score"], sid, 1)
    return ln.run_trace(1, bridge, snaps, prov)


@register("text_feature_versions")
def text_feature_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soup features built three times: run 2 sees other names for the people
    with odd keys, run 3 the first names again, so that the rows of run 1 are
    active once more."""
    src = _sources(spark, sf_dir)
    run1 = fe.recommendation_soup(curated_typed(spark, sf_dir))
    sup = b.table(spark, sf_dir, "supplier")
    other = F.when(F.col("s_suppkey") % 2 == 1, F.concat("s_name", F.lit(" jr"))).otherwise(F.col("s_name"))
    names2 = sup.select(F.concat(F.lit("nm"), F.col("s_suppkey").cast("string")).alias("nconst"), other.alias("primaryName"))
    cur2 = cu.curate(src["titles"], src["crew"], src["ratings"], names2, src["principals"], vote_quantile=VOTE_QUANTILE, min_votes=MIN_VOTES, sort=False)
    run2 = fe.recommendation_soup(cur2)
    v1 = fe.add_feature_run(None, run1, 1)
    v2 = fe.add_feature_run(v1, run2, 2)
    v3 = fe.add_feature_run(v2, run1, 3)
    return v3.select(
        "tconst", "feature_name", "feature_version", "source_text_sha256", "source_etl_run_id", "last_built_run_id", "active"
    )


@register("one_active_check")
def one_active_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows only (expected empty): contracts with more than one active row."""
    return fe.one_active_violations(text_feature_versions(spark, sf_dir))


def _suffix_ctes(sql: str, names: list[str], suffix: str) -> str:
    import re

    for n in sorted(names, key=len, reverse=True):
        sql = re.sub(rf"\b{n}\b", n + suffix, sql)
    return sql


_RUN_CTES = ["base", "stats", "scored", "d_ids", "d_pos", "d_lists", "c_top", "c_lists", "dup", "curated", "curated2", "soup"]
_SOUP_RUN1 = _CURATED2_SQL + "," + _SOUP_SQL
_SOUP_RUN2 = _suffix_ctes(_SOUP_RUN1, _RUN_CTES + ["b_names"], "_2")

_FEATURE_VERSIONS_SQL = _with(
    """
b_names_2 AS (
  SELECT 'nm' || CAST(s_suppkey AS VARCHAR) AS nconst, CASE WHEN s_suppkey % 2 = 1 THEN s_name || ' jr' ELSE s_name END AS primaryName
  FROM supplier),"""
    + _SOUP_RUN1
    + ","
    + _SOUP_RUN2
    + """,
s1 AS (SELECT tconst, sha256(source_text) AS h FROM soup),
s2 AS (SELECT tconst, sha256(source_text) AS h FROM soup_2),
fv AS (
  SELECT tconst, h, 1 AS run FROM s1
  UNION ALL
  SELECT s2.tconst, s2.h, 2 FROM s2 WHERE NOT EXISTS (SELECT 1 FROM s1 WHERE s1.tconst = s2.tconst AND s1.h = s2.h)),
fva AS (
  SELECT tconst, 'recommendation_soup' AS feature_name, 'v1' AS feature_version, h AS source_text_sha256,
         CAST(run AS BIGINT) AS source_etl_run_id,
         CAST(CASE WHEN run = 1 THEN 3 ELSE 2 END AS BIGINT) AS last_built_run_id,
         run = 1 AS active
  FROM fv)
"""
)
_ORACLES["text_feature_versions"] = _FEATURE_VERSIONS_SQL + "SELECT * FROM fva"
_ORACLES["one_active_check"] = (
    _FEATURE_VERSIONS_SQL
    + """SELECT tconst, feature_name, feature_version, CAST(count(*) FILTER (WHERE active) AS BIGINT) AS active_rows
FROM fva GROUP BY ALL HAVING count(*) FILTER (WHERE active) > 1"""
)


@register(
    "source_key_check",
    _with(
        """
v AS (
  SELECT 'titles' AS source, tconst AS key, count(*) AS n FROM b_titles GROUP BY tconst HAVING count(*) > 1
  UNION ALL SELECT 'crew', tconst, count(*) FROM b_crew GROUP BY tconst HAVING count(*) > 1
  UNION ALL SELECT 'ratings', tconst, count(*) FROM b_ratings GROUP BY tconst HAVING count(*) > 1
  UNION ALL SELECT 'names', nconst, count(*) FROM b_names GROUP BY nconst HAVING count(*) > 1
  UNION ALL SELECT 'principals', tconst || '|' || CAST(ordering AS VARCHAR) || '|' || nconst, count(*)
            FROM b_principals GROUP BY tconst, ordering, nconst HAVING count(*) > 1)
SELECT source, key, CAST(n AS BIGINT) AS rows FROM v"""
    ),
)
def source_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-uniqueness report over the five bound sources (fan-out guard)."""
    return cu.source_key_violations(_sources(spark, sf_dir))


@register("recommend_all_heavy_path", _with(_CAT_SQL + "," + _rec_sql(TOP_N, CANDIDATE_LIMIT) + _REC_SELECT))
def recommend_all_heavy_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same result as ``recommend_all`` with every title holding more than
    one hot term paired directly (exercises the engine's third branch)."""
    titles, terms = catalog_index(spark, sf_dir)
    return _rec_columns(
        rc.recommend_all(titles, terms, top_n=TOP_N, candidate_limit=CANDIDATE_LIMIT, hot_min_df=SPLIT_HOT_MIN_DF, max_hot=1)
    )


@register(
    "evaluate_report_lines",
    _with(
        _EVAL_SQL
        + """
SELECT id, concat_ws(chr(10),
         printf('[%s] %s: %s', CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END, id, query),
         CASE WHEN error IS NOT NULL THEN '  error: ' || error
              ELSE printf('  top %d: %s', top_n, coalesce(nullif(array_to_string(recs, ', '), ''), '(none)')) END,
         CASE WHEN len(expected_good) > 0 THEN '  missing expected good: ' || coalesce(nullif(array_to_string(missing_good, ', '), ''), '(none)') END,
         CASE WHEN len(expected_bad) > 0 THEN '  present expected bad: ' || coalesce(nullif(array_to_string(present_bad, ', '), ''), '(none)') END,
         CASE WHEN coalesce(expected_error, '') <> '' THEN '  expected error: ' || expected_error END) AS text
FROM fin2"""
    ),
)
def evaluate_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-case report text of the seed-case evaluation."""
    return ev.report_lines(_eval_results(spark, sf_dir))
