"""Registered queries of the serving contract, with their DuckDB oracles.

The contract's text features and embeddings are bound to the driver tables:
part ``p`` is title ``tt<p>``, vector ``v`` is an embedding of title ``tt<v>``
in two feature versions. Rows that break each rule are dealt by the keys'
remainders, so every rule is broken by rows that depend on the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators import curate as cu
from marquee.operators import features as fe
from marquee.operators import lineage as ln
from marquee.operators import slices as sl
from marquee.operators.ivf import vector_topk_lists
from marquee.operators.vectors import vector_topk
from marquee.plans import runs
from marquee.plans.catalog_queries import _with, register
from marquee.session import scratch_path
from marquee.sources import bindings as b
from marquee.sources import digest, split_csv

DIM = 64
FEATURE, MODEL, MODEL_VERSION = "recommendation_soup", "configured-model", "v1"


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One title per part; every 29th is not served."""
    p = b.table(spark, sf_dir, "part")
    return p.select(
        b._tconst(F.col("p_partkey")).alias("tconst"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("score"), (F.col("p_partkey") % 29 != 0).alias("active")
    )


def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions per title; the first version of every 7th title has a
    superseded row beside its active one."""
    p = b.table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    old = key % 7 == 0
    row = lambda n, version, text, active: F.struct(
        (key * 10 + n).alias("text_feature_id"), F.lit(version).alias("feature_version"), F.sha2(text, 256).alias("source_text_sha256"), active.alias("active")
    )
    name = F.col("p_name")
    first = row(1, "v1", F.when(old, F.concat(name, F.lit(" (old)"))).otherwise(name), ~old)
    second = row(2, "v2", F.concat_ws(" | ", name, "p_type"), F.lit(True))
    third = row(3, "v1", name, F.lit(True))
    rows = p.select(key, F.explode(F.when(old, F.array(first, second, third)).otherwise(F.array(first, second))).alias("f"))
    return rows.select(b._tconst(key).alias("tconst"), F.lit(FEATURE).alias("feature_name"), "f.*")


def title_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two embeddings per vector, one of each feature version; some copy other
    keys than their feature's, some are of another model version."""
    v, p = b.table(spark, sf_dir, "embeddings"), b.table(spark, sf_dir, "part")
    texts = p.select(F.col("p_partkey").alias("vec_id"), "p_name", "p_type")
    x, n = F.col("vec_id"), F.col("n")
    both = v.select("vec_id", "embedding", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).join(texts.hint("merge"), "vec_id", "left")
    old = F.when(x % 7 == 0, F.concat("p_name", F.lit(" (old)"))).otherwise(F.col("p_name"))
    text = F.when(x % 11 == 3, F.lit("outdated")).when(n == 1, old).otherwise(F.concat_ws(" | ", "p_name", "p_type"))
    return both.select(
        (x * 2 + n).alias("movie_embedding_id"),
        (x * 10 + n + F.when(x % 23 == 7, 1_000_000_000).otherwise(0)).alias("text_feature_id"),
        b._tconst(x + F.when(x % 19 == 6, 1).otherwise(0)).alias("tconst"),
        F.lit(FEATURE).alias("feature_name"),
        F.when(x % 17 == 4, "v9").otherwise(F.concat(F.lit("v"), n)).alias("feature_version"),
        F.sha2(F.coalesce(text, F.lit("")), 256).alias("source_text_sha256"),
        F.lit(MODEL).alias("model_name"),
        F.when(x % 5 == 2, "v0").otherwise(MODEL_VERSION).alias("model_version"),
        F.when(x % 13 == 5, 32).otherwise(DIM).cast("int").alias("vector_dimension"),
        "embedding",
        (x % 31 != 1).alias("active"),
    )


_CONTRACT_SQL = f"""
movies AS (SELECT 'tt' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS tconst, p_name AS title, p_retailprice AS score, p_partkey % 29 <> 0 AS active FROM part),
features AS (
  SELECT p_partkey * 10 + 1 AS id, 'tt' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS tconst, 'v1' AS version,
         sha256(CASE WHEN p_partkey % 7 = 0 THEN p_name || ' (old)' ELSE p_name END) AS sha, p_partkey % 7 <> 0 AS active FROM part
  UNION ALL SELECT p_partkey * 10 + 2, 'tt' || lpad(CAST(p_partkey AS VARCHAR), 7, '0'), 'v2', sha256(concat_ws(' | ', p_name, p_type)), true FROM part
  UNION ALL SELECT p_partkey * 10 + 3, 'tt' || lpad(CAST(p_partkey AS VARCHAR), 7, '0'), 'v1', sha256(p_name), true FROM part WHERE p_partkey % 7 = 0),
stored AS (
  SELECT v.vec_id * 2 + n AS id, v.vec_id * 10 + n + CASE WHEN v.vec_id % 23 = 7 THEN 1000000000 ELSE 0 END AS feature_id,
         'tt' || lpad(CAST(v.vec_id + CASE WHEN v.vec_id % 19 = 6 THEN 1 ELSE 0 END AS VARCHAR), 7, '0') AS tconst,
         CASE WHEN v.vec_id % 17 = 4 THEN 'v9' ELSE 'v' || n END AS version,
         sha256(coalesce(CASE WHEN v.vec_id % 11 = 3 THEN 'outdated' WHEN n = 1 AND v.vec_id % 7 = 0 THEN p.p_name || ' (old)'
                              WHEN n = 1 THEN p.p_name ELSE concat_ws(' | ', p.p_name, p.p_type) END, '')) AS sha,
         CASE WHEN v.vec_id % 5 = 2 THEN 'v0' ELSE 'v1' END AS model_version, CASE WHEN v.vec_id % 13 = 5 THEN 32 ELSE {DIM} END AS dimension,
         v.embedding, v.vec_id % 31 <> 1 AS active
  FROM embeddings v CROSS JOIN (VALUES (1), (2)) t(n) LEFT JOIN part p ON p.p_partkey = v.vec_id)
"""


@register(
    "embedding_constraints",
    "WITH "
    + _CONTRACT_SQL.strip()
    + """,
broken AS (
  SELECT s.id, unnest([
    CASE WHEN s.embedding IS NULL OR len(s.embedding) = 0 OR len(list_filter(s.embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'bad_vector' END,
    CASE WHEN len(s.embedding) <> s.dimension THEN 'dimension' END,
    CASE WHEN f.id IS NULL THEN 'no_text_feature' END,
    CASE WHEN f.id IS NOT NULL AND f.tconst <> s.tconst THEN 'other_movie' END,
    CASE WHEN f.id IS NOT NULL AND f.version <> s.version THEN 'other_feature_version' END,
    CASE WHEN f.id IS NOT NULL AND f.sha <> s.sha THEN 'outdated_text' END,
    CASE WHEN f.id IS NOT NULL AND s.active AND NOT f.active THEN 'inactive_text_feature' END,
    CASE WHEN m.tconst IS NULL THEN 'no_movie' WHEN NOT m.active THEN 'inactive_movie' END]) AS problem
  FROM stored s LEFT JOIN features f ON f.id = s.feature_id LEFT JOIN movies m ON m.tconst = s.tconst)
SELECT id AS movie_embedding_id, string_agg(problem, ',' ORDER BY problem) AS problems FROM broken WHERE problem IS NOT NULL GROUP BY id""",
)
def embedding_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every constraint that each stored embedding breaks."""
    found = sl.embedding_problems(title_embeddings(spark, sf_dir), text_features(spark, sf_dir), movies(spark, sf_dir))
    return found.select("movie_embedding_id", F.array_join("problems", ",").alias("problems"))


def _served(spark: SparkSession, sf_dir: str, version: str) -> DataFrame:
    """id, embedding, score, title of the configured slice."""
    kinds = "feature_name string, feature_version string, model_name string, model_version string, vector_dimension int"
    config = spark.createDataFrame([(FEATURE, version, MODEL, MODEL_VERSION, DIM)], kinds)
    shown = movies(spark, sf_dir)
    served = sl.serving_slice(title_embeddings(spark, sf_dir), text_features(spark, sf_dir), shown, config)
    return served.join(shown.drop("active").hint("merge"), "tconst").withColumnRenamed("tconst", "id")


def _slice_sql(version: str) -> str:
    return (
        "WITH "
        + _CONTRACT_SQL.strip()
        + f""",
served AS (
  SELECT s.tconst, s.embedding, m.score, m.title FROM stored s
  JOIN features f ON f.id = s.feature_id AND f.tconst = s.tconst AND f.version = s.version AND f.sha = s.sha AND f.active
  JOIN movies m ON m.tconst = s.tconst AND m.active
  WHERE s.active AND s.version = '{version}' AND s.model_version = 'v1' AND s.dimension = {DIM} AND len(s.embedding) = {DIM}),
parts AS (SELECT tconst, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM served),
lengths AS (SELECT tconst, sqrt(sum(x * x)) AS n FROM parts GROUP BY 1),
dots AS (SELECT a.tconst AS q, c.tconst AS c, sum(a.x * c.x) AS dot FROM parts a JOIN parts c ON a.i = c.i AND a.tconst <> c.tconst GROUP BY 1, 2),
ranked AS (
  SELECT q, c, 1.0 - dot / (nq.n * nc.n) AS distance, s.score, s.title,
         row_number() OVER (PARTITION BY q ORDER BY 1.0 - dot / (nq.n * nc.n), s.score DESC NULLS LAST, s.title, c) AS rank
  FROM dots JOIN lengths nq ON nq.tconst = q JOIN lengths nc ON nc.tconst = c JOIN served s ON s.tconst = c)"""
    )


@register("vector_topk_slice", _slice_sql("v2") + "\nSELECT q, c, CAST(rank AS INTEGER) AS rank, round(distance, 9) AS distance FROM ranked WHERE rank <= 10")
def vector_topk_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest titles within the configured slice (feature version v2 of
    two, model version v1 of two), for every title that the slice serves."""
    found = vector_topk(_served(spark, sf_dir, "v2"), k=10, block_rows=256)
    return found.select("q", "c", "rank", F.round("distance", 9).alias("distance"))


def _title_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, term): genres and credited people of every title."""
    genres = b.titles(spark, sf_dir).select(F.col("tconst").alias("id"), F.explode(F.split("genres", ",")).alias("term"))
    people = b.principals(spark, sf_dir).select(F.col("tconst").alias("id"), F.col("nconst").alias("term"))
    return genres.unionByName(people)


@register(
    "vector_rerank_overlap",
    lambda: _slice_sql("v1").replace("WITH ", "WITH " + b.BINDINGS_SQL.strip() + ",\n", 1)
    + """,
terms AS (
  SELECT tconst, unnest(string_split(genres, ',')) AS term FROM b_titles UNION SELECT tconst, nconst FROM b_principals),
near AS (SELECT * FROM ranked WHERE rank <= 50),
shared AS (
  SELECT n.q, n.c, count(*) AS overlap FROM near n JOIN terms a ON a.tconst = n.q JOIN terms t ON t.tconst = n.c AND t.term = a.term GROUP BY 1, 2),
again AS (
  SELECT q, c, coalesce(overlap, 0) AS overlap, distance,
         row_number() OVER (PARTITION BY q ORDER BY coalesce(overlap, 0) DESC, distance, score DESC NULLS LAST, title, c) AS rerank
  FROM near LEFT JOIN shared USING (q, c))
SELECT q, c, CAST(rerank AS INTEGER) AS rerank, overlap, round(distance, 9) AS distance FROM again WHERE rerank <= 10""",
)
def vector_rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty nearest titles of the slice, re-ranked by shared genres and
    credited people; the first ten."""
    near = vector_topk(_served(spark, sf_dir, "v1"), k=50, block_rows=256)
    best = sl.rerank_by_overlap(near, _title_terms(spark, sf_dir), 10)
    return best.select("q", "c", F.col("rerank").cast("int"), "overlap", F.round("distance", 9).alias("distance"))


@register("vector_topk_lists")
def vector_topk_lists_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows only (approximate; its recall is tested): ten nearest vectors of
    every vector over an inverted file."""
    v = b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    return vector_topk_lists(v, k=10).select("q", "c", "rank", F.round("distance", 9).alias("distance"))


#: Year of the orders that make up each full snapshot, in order of arrival.
ARRIVALS = ((1, 1996), (3, 1998), (2, 1997))


@register(
    "snapshot_merge",
    """
WITH loads AS (
  SELECT CASE year(o_orderdate) WHEN 1996 THEN 1 ELSE 3 END AS load, o_custkey, count(*) AS orders, max(o_orderpriority) AS priority
  FROM orders WHERE year(o_orderdate) IN (1996, 1998) GROUP BY ALL),
per AS (
  SELECT o_custkey, max(load) AS last_seen, min(load) AS first_seen, arg_max(orders, load) AS orders, arg_max(priority, load) AS priority,
         count(DISTINCT (orders, priority)) AS kinds FROM loads GROUP BY 1)
SELECT o_custkey, orders, priority, last_seen = 3 AS active, CAST(first_seen AS BIGINT) AS first_seen, CAST(last_seen AS BIGINT) AS last_seen,
       CAST(CASE WHEN last_seen = 1 OR first_seen = 3 OR kinds > 1 THEN 3 ELSE 1 END AS BIGINT) AS changed_in,
       CAST(CASE WHEN last_seen = 1 THEN 3 END AS BIGINT) AS inactive_since, CAST(3 AS BIGINT) AS merged_load
FROM per""",
)
def snapshot_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of three years as full snapshots; the second arrives last and
    changes nothing, customers that the third lacks are inactive."""
    o = b.table(spark, sf_dir, "orders")
    state = None
    for load, year in ARRIVALS:
        rows = o.where(F.year("o_orderdate") == year).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderpriority").alias("priority"))
        state = ln.merge_snapshot(state, rows, ["o_custkey"], load)
    return state


@register(
    "split_csv_cells",
    """
SELECT doc_id, lang, source, length(text) AS chars, sha256(text) AS text_sha256 FROM documents WHERE text IS NOT NULL AND text <> ''""",
)
def split_csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, line breaks and all, written as quoted CSV cells and read
    back by many tasks per file."""
    path = scratch_path(spark, "csv-cells")
    docs = b.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text").where("text is not null and text <> ''")
    docs.write.options(header=True, quote='"', escape='"', nullValue="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    back = split_csv.read_csv(spark, path, ["doc_id", "lang", "source", "text"])
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "source", F.length("text").cast("bigint").alias("chars"), F.sha2("text", 256).alias("text_sha256"))


@register(
    "streamed_digests",
    """
WITH lines AS (SELECT o_orderstatus, o_orderkey, concat_ws('|', o_orderkey, o_custkey, o_orderpriority) AS line FROM orders)
SELECT o_orderstatus AS name, CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes, sha256(string_agg(line, chr(10) ORDER BY o_orderkey) || chr(10)) AS sha256
FROM lines GROUP BY 1""",
)
def streamed_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of one file of orders per status, lines in order of their keys."""
    path = scratch_path(spark, "order-files")
    o = b.table(spark, sf_dir, "orders")
    lines = o.select("o_orderstatus", "o_orderkey", F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderpriority").alias("line"))
    ordered = lines.repartition("o_orderstatus").sortWithinPartitions("o_orderstatus", "o_orderkey")
    ordered.select("o_orderstatus", "line").write.partitionBy("o_orderstatus").text(path)
    found = digest.file_digests(spark, path)
    return found.select(F.regexp_extract("source_path", "o_orderstatus=([^/]+)/", 1).alias("name"), F.col("source_size").alias("n_bytes"), F.col("source_sha256").alias("sha256"))


@register(
    "run_log",
    _with(
        """
joined AS (SELECT t.tconst FROM b_titles t JOIN b_ratings r USING (tconst) WHERE t.titleType = 'movie' AND r.numVotes >= 20),
reads AS (SELECT 'title_basics' AS role, count(*) AS n FROM b_titles UNION ALL SELECT 'title_ratings', count(*) FROM b_ratings)
SELECT r.role, 'imdb_load' AS run_type, 'succeeded' AS status, CAST(r.n AS BIGINT) AS source_records_read,
       CAST((SELECT sum(n) FROM reads) AS BIGINT) AS records_read, CAST((SELECT count(*) FROM joined) AS BIGINT) AS records_written
FROM reads r"""
    ),
)
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows of a load whose counts were gathered while it wrote."""
    sources = {"title_basics": runs.Source(b.titles(spark, sf_dir), 1), "title_ratings": runs.Source(b.ratings(spark, sf_dir), 2)}

    def build(rows: dict[str, DataFrame]) -> DataFrame:
        kept = rows["title_basics"].where("titleType = 'movie'")
        return kept.join(rows["title_ratings"].where("numVotes >= 20"), "tconst")

    run = runs.run_job(1, "imdb_load", sources, build, scratch_path(spark, "run-output"))
    return run.sources.join(run.runs, "etl_run_id").select(
        "role", "run_type", "status", run.sources["records_read"].alias("source_records_read"), run.runs["records_read"], "records_written"
    )


@register(
    "one_active_violations",
    """
WITH f AS (
  SELECT 'tt' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS tconst, p_partkey, unnest(CASE WHEN p_partkey % 7 = 0 THEN [1, 2, 3] ELSE [1, 2] END) AS n FROM part)
SELECT tconst, 'recommendation_soup' AS feature_name, 'v1' AS feature_version, CAST(count(*) AS BIGINT) AS active_rows
FROM f WHERE n IN (1, 3) AND (n = 3 OR p_partkey % 7 <> 0 OR p_partkey % 2 = 0) GROUP BY tconst HAVING count(*) > 1""",
)
def one_active_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature contracts with two active rows: for every other superseded row
    the older one was never made inactive."""
    f = text_features(spark, sf_dir)
    key = F.col("text_feature_id")
    forgotten = (key % 10 == 1) & (F.floor(key / 10) % 2 == 0)
    return fe.one_active_violations(f.withColumn("active", F.col("active") | forgotten))


@register(
    "source_key_violations",
    _with(
        """
twice AS (SELECT * FROM b_principals UNION ALL SELECT * FROM b_principals WHERE ordering % 50 = 1)
SELECT 'titles' AS source, tconst AS key, CAST(2 AS BIGINT) AS rows FROM b_titles WHERE titleType = 'short'
UNION ALL
SELECT 'principals', tconst || '|' || CAST(ordering AS VARCHAR) || '|' || nconst, CAST(count(*) AS BIGINT) FROM twice GROUP BY tconst, ordering, nconst HAVING count(*) > 1"""
    ),
)
def source_key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated keys, where a second load repeated all shorts and every 50th credit."""
    src = b.sources(spark, sf_dir)
    src["titles"] = src["titles"].unionByName(src["titles"].where("titleType = 'short'"))
    src["principals"] = src["principals"].unionByName(src["principals"].where("ordering % 50 = 1"))
    return cu.source_key_violations(src)
