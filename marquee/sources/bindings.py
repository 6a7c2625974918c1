"""Driver test tables → catalogue source tables (stand-in input only).

The driver ships TPC-H-like tables. These functions only reshape them into
the five raw source schemas the catalogue jobs read; they do none of the
jobs' work (no threshold, no list building, no ranking).

=============  ==============================================================
titles         part: ``tconst = 'tt' + 7-digit part key``, PROMO parts are
               shorts, ``primaryTitle = p_name`` (many duplicates),
               ``genres = p_type + ',' + p_brand``
ratings        lineitem per part: ``numVotes = count``,
               ``averageRating = avg(l_quantity) / 5``
principals     lineitem: one credit per line, ``ordering = orderkey*8 +
               linenumber``, ``nconst = 'nm' + suppkey``, return flag A/R/N →
               actor/actress/writer
crew           per part all distinct supplier ids in order as a comma list
               (the curation keeps three); parts of size <= 3 carry the
               missing marker instead; writers: the suppliers of lines with
               return flag N
names          supplier: ``nconst = 'nm' + suppkey``, ``primaryName = s_name``
=============  ==============================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.functions.scalars import MISSING_MARKER

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _tconst(key: F.Column) -> F.Column:
    return F.concat(F.lit("tt"), F.lpad(key.cast("string"), 7, "0"))


def _nconst(key: F.Column) -> F.Column:
    return F.concat(F.lit("nm"), key.cast("string"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        _tconst(F.col("p_partkey")).alias("tconst"),
        F.when(F.col("p_type") == "PROMO", F.lit("short")).otherwise(F.lit("movie")).alias("titleType"),
        F.col("p_name").alias("primaryTitle"),
        F.concat_ws(",", "p_type", "p_brand").alias("genres"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_partkey").agg(
        (F.avg("l_quantity") / F.lit(5.0)).alias("averageRating"),
        F.count(F.lit(1)).alias("numVotes"),
    ).select(_tconst(F.col("l_partkey")).alias("tconst"), "averageRating", "numVotes")


def principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        _tconst(F.col("l_partkey")).alias("tconst"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ordering"),
        _nconst(F.col("l_suppkey")).alias("nconst"),
        F.when(F.col("l_returnflag") == "A", "actor")
        .when(F.col("l_returnflag") == "R", "actress")
        .otherwise("writer")
        .alias("category"),
    )


def crew(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    lists = li.groupBy("l_partkey").agg(
        F.array_sort(F.collect_set("l_suppkey")).alias("d"),
        F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "N", F.col("l_suppkey")))).alias("w"),
    )
    # a million parts are small in their packed file only: no broadcast
    joined = lists.join(part.hint("merge"), lists.l_partkey == part.p_partkey)
    text = lambda ids: F.array_join(F.transform(ids, _nconst), ",")
    return joined.select(
        _tconst(F.col("l_partkey")).alias("tconst"),
        F.when(F.col("p_size") <= 3, F.lit(MISSING_MARKER)).otherwise(text("d")).alias("directors"),
        F.when(F.size("w") == 0, F.lit(MISSING_MARKER)).otherwise(text("w")).alias("writers"),
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = table(spark, sf_dir, "supplier")
    return sup.select(_nconst(F.col("s_suppkey")).alias("nconst"), F.col("s_name").alias("primaryName"))


def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed cases from orders: the first line's part name is the query, the
    other lines' part names are expected (returned lines: expected absent);
    ``top_n`` is the number of lines; finished orders expect the not-found
    error.
    """
    from marquee.functions.scalars import NOT_FOUND_ERROR

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = li.withColumn("rn", F.row_number().over(w)).join(part, "l_partkey")
    per = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("rn", "p_name", "l_returnflag"))).alias("ls"))
    rest = F.filter("ls", lambda x: x["rn"] > 1)
    return per.join(orders, "l_orderkey").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("id"),
        F.col("ls")[0]["p_name"].alias("query"),
        F.size("ls").cast("int").alias("top_n"),
        F.transform(F.filter(rest, lambda x: x["l_returnflag"] != "R"), lambda x: x["p_name"]).alias("expected_good"),
        F.transform(F.filter(rest, lambda x: x["l_returnflag"] == "R"), lambda x: x["p_name"]).alias("expected_bad"),
        F.when(F.col("o_orderstatus") == "F", F.lit(NOT_FOUND_ERROR)).alias("expected_error"),
        F.lit("").alias("failure_mode"),
        F.lit("").alias("notes"),
    )


def sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five source tables, keyed like the raw file set."""
    return {
        "titles": titles(spark, sf_dir),
        "crew": crew(spark, sf_dir),
        "ratings": ratings(spark, sf_dir),
        "names": names(spark, sf_dir),
        "principals": principals(spark, sf_dir),
    }


# The same bindings as DuckDB SQL common table expressions, used by the
# oracle queries in ``__spark_entry__``.
BINDINGS_SQL = r"""
b_titles AS (
  SELECT 'tt' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS tconst,
         CASE WHEN p_type = 'PROMO' THEN 'short' ELSE 'movie' END AS titleType,
         p_name AS primaryTitle,
         p_type || ',' || p_brand AS genres
  FROM part),
b_ratings AS (
  SELECT 'tt' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS tconst,
         avg(l_quantity) / 5.0 AS averageRating,
         CAST(count(*) AS BIGINT) AS numVotes
  FROM lineitem GROUP BY l_partkey),
b_principals AS (
  SELECT 'tt' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS tconst,
         l_orderkey * 8 + l_linenumber AS ordering,
         'nm' || CAST(l_suppkey AS VARCHAR) AS nconst,
         CASE l_returnflag WHEN 'A' THEN 'actor' WHEN 'R' THEN 'actress' ELSE 'writer' END AS category
  FROM lineitem),
b_crew AS (
  SELECT 'tt' || lpad(CAST(s.l_partkey AS VARCHAR), 7, '0') AS tconst,
         CASE WHEN p.p_size <= 3 THEN '\N'
              ELSE string_agg('nm' || CAST(s.l_suppkey AS VARCHAR), ',' ORDER BY s.l_suppkey) END AS directors,
         coalesce(string_agg('nm' || CAST(s.l_suppkey AS VARCHAR), ',' ORDER BY s.l_suppkey) FILTER (s.writes), '\N') AS writers
  FROM (SELECT l_partkey, l_suppkey, bool_or(l_returnflag = 'N') AS writes FROM lineitem GROUP BY ALL) s
  JOIN part p ON p.p_partkey = s.l_partkey
  GROUP BY s.l_partkey, p.p_size),
b_names AS (
  SELECT 'nm' || CAST(s_suppkey AS VARCHAR) AS nconst, s_name AS primaryName
  FROM supplier),
b_lines AS (
  SELECT l.l_orderkey, l.rn, p.p_name, l.l_returnflag FROM (
    SELECT l_orderkey, l_partkey, l_returnflag,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn
    FROM lineitem) l JOIN part p ON p.p_partkey = l.l_partkey),
b_cases AS (
  SELECT 'o' || CAST(o.o_orderkey AS VARCHAR) AS id,
         max(CASE WHEN x.rn = 1 THEN x.p_name END) AS query,
         CAST(count(*) AS INTEGER) AS top_n,
         coalesce(list(x.p_name ORDER BY x.rn) FILTER (WHERE x.rn > 1 AND x.l_returnflag <> 'R'), []) AS expected_good,
         coalesce(list(x.p_name ORDER BY x.rn) FILTER (WHERE x.rn > 1 AND x.l_returnflag = 'R'), []) AS expected_bad,
         CASE WHEN o.o_orderstatus = 'F' THEN 'This movie is not in the dataset.' END AS expected_error
  FROM b_lines x JOIN orders o ON o.o_orderkey = x.l_orderkey
  GROUP BY o.o_orderkey, o.o_orderstatus)
"""
