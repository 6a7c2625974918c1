"""Recommendation quality evaluation over seed cases.

Cases are a DataFrame ``(id, query, top_n, expected_good, expected_bad,
expected_error, failure_mode, notes)``. All cases run as one batch of
recommendation requests; each case's recommendation list is at most
``top_n`` long, so collecting it per case is bounded.

A case passes when

* it expects an error (non-empty ``expected_error``): an error occurred,
  its text contains the expected text, and there are no recommendations;
* otherwise: no error, no expected-good title missing, no expected-bad title
  present (list multiplicity kept).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions.scalars import join_or_none
from marquee.operators.recommend import DEFAULT_CANDIDATE_LIMIT, recommend
from marquee.operators.similarity import DEFAULT_HOT_MIN_DF

# Fixed values of the case format.
DEFAULT_SCORER = "sqlite-bounded-term-overlap"
DEFAULT_CASE_TOP_N = 10

CASE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("top_n", T.LongType()),
        T.StructField("expected_good", T.ArrayType(T.StringType())),
        T.StructField("expected_bad", T.ArrayType(T.StringType())),
        T.StructField("expected_error", T.StringType()),
        T.StructField("failure_mode", T.StringType()),
        T.StructField("notes", T.StringType()),
    ]
)
FILE_SCHEMA = T.StructType(
    [
        T.StructField("schema_version", T.LongType()),
        T.StructField("scorer", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("cases", T.ArrayType(CASE_SCHEMA)),
    ]
)


def normalize_cases(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Apply the per-field defaults of the case format."""
    empty = F.array().cast("array<string>")
    return raw.select(
        *keep,
        F.col("id").cast("string").alias("id"),
        F.col("query").cast("string").alias("query"),
        F.coalesce(F.col("top_n").cast("int"), F.lit(DEFAULT_CASE_TOP_N)).alias("top_n"),
        F.coalesce(F.col("expected_good"), empty).alias("expected_good"),
        F.coalesce(F.col("expected_bad"), empty).alias("expected_bad"),
        F.col("expected_error").cast("string").alias("expected_error"),
        F.coalesce(F.col("failure_mode"), F.lit("")).alias("failure_mode"),
        F.coalesce(F.col("notes"), F.lit("")).alias("notes"),
    )


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Read a JSON case file → ``(scorer, <case columns>)`` one row per case."""
    doc = spark.read.schema(FILE_SCHEMA).option("multiLine", True).json(path)
    rows = doc.select(F.coalesce(F.col("scorer"), F.lit(DEFAULT_SCORER)).alias("scorer"), F.explode("cases").alias("c"))
    return normalize_cases(rows.select("scorer", "c.*"), keep=("scorer",))


def case_results(
    cases: DataFrame,
    titles: DataFrame,
    terms: DataFrame,
    top_n: int | None = None,
    candidate_limit: int = DEFAULT_CANDIDATE_LIMIT,
    hot_min_df: int | str = DEFAULT_HOT_MIN_DF,
) -> DataFrame:
    """One row per case with its recommendations, misses and verdict.

    ``top_n`` overrides every case's own value. The recommender runs once
    with the largest effective ``top_n`` (lists are prefixes of longer
    lists), which a one-row aggregate over the cases provides.
    """
    # deterministic key (content hash): recomputed tasks give the same key;
    # identical cases share one request and both read its result
    case_cols = [c for c in cases.columns if c != "scorer"]
    cases = cases.withColumn("_key", F.sha2(F.to_json(F.struct(*[F.col(c) for c in case_cols])), 256))
    eff = F.lit(int(top_n)) if top_n is not None else F.col("top_n")
    cases = cases.withColumn("eff_top_n", F.greatest(F.lit(0), eff.cast("int")))
    largest = (top_n if top_n is not None else cases.agg(F.max("eff_top_n")).first()[0]) or 0
    requests = cases.select(
        F.col("_key").alias("request_id"), F.col("query").alias("title"), F.col("eff_top_n").alias("top_n")
    ).dropDuplicates(["request_id"])
    recs = recommend(titles, terms, requests, top_n=max(int(largest), 0), candidate_limit=candidate_limit, hot_min_df=hot_min_df)
    per_case = recs.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "title")))).alias("rs"),
        F.max("error").alias("error"),
    )
    joined = cases.join(per_case, cases["_key"] == per_case["request_id"], "left")
    rec_titles = F.coalesce(F.transform(F.col("rs"), lambda r: r["title"]), F.array().cast("array<string>"))
    out = joined.withColumn("recommendations", rec_titles)
    out = out.withColumn(
        "missing_good", F.filter("expected_good", lambda x: ~F.array_contains(F.col("recommendations"), x))
    ).withColumn("present_bad", F.filter("expected_bad", lambda x: F.array_contains(F.col("recommendations"), x)))
    expects_error = F.coalesce(F.nullif(F.col("expected_error"), F.lit("")), F.lit(None)).isNotNull()
    error_hit = expects_error & F.col("error").isNotNull() & F.col("error").contains(F.col("expected_error"))
    passed = F.when(expects_error, error_hit & (F.size("recommendations") == 0)).otherwise(
        F.col("error").isNull() & (F.size("missing_good") == 0) & (F.size("present_bad") == 0)
    )
    return out.select(
        "id",
        "query",
        F.col("eff_top_n").alias("top_n"),
        "expected_good",
        "expected_bad",
        "expected_error",
        "failure_mode",
        "notes",
        "recommendations",
        "error",
        "missing_good",
        "present_bad",
        F.coalesce(error_hit, F.lit(False)).alias("error_hit"),
        passed.alias("passed"),
    )


def report(results: DataFrame) -> DataFrame:
    """One-row totals of :func:`case_results`."""
    expects_error = F.coalesce(F.nullif(F.col("expected_error"), F.lit("")), F.lit(None)).isNotNull()
    return results.agg(
        F.count(F.lit(1)).alias("cases_total"),
        F.count_if(F.col("passed")).alias("cases_passed"),
        F.coalesce(F.sum(F.size("expected_good") - F.size("missing_good")), F.lit(0)).cast("bigint").alias("expected_good_hits"),
        F.coalesce(F.sum(F.size("expected_good")), F.lit(0)).cast("bigint").alias("expected_good_total"),
        F.coalesce(F.sum(F.size("expected_bad") - F.size("present_bad")), F.lit(0)).cast("bigint").alias("expected_bad_absent"),
        F.coalesce(F.sum(F.size("expected_bad")), F.lit(0)).cast("bigint").alias("expected_bad_total"),
        F.count_if(F.col("error_hit")).alias("expected_error_hits"),
        F.count_if(expects_error).alias("expected_error_total"),
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"),
    )


def report_lines(results: DataFrame) -> DataFrame:
    """Per-case report text (status line and expectation lines)."""
    status = F.when(F.col("passed"), F.lit("PASS")).otherwise(F.lit("FAIL"))
    head = F.format_string("[%s] %s: %s", status, F.col("id"), F.col("query"))
    body = F.when(F.col("error").isNotNull(), F.concat(F.lit("  error: "), F.col("error"))).otherwise(
        F.format_string("  top %d: %s", F.col("top_n"), join_or_none("recommendations"))
    )
    good = F.when(F.size("expected_good") > 0, F.concat(F.lit("  missing expected good: "), join_or_none("missing_good")))
    bad = F.when(F.size("expected_bad") > 0, F.concat(F.lit("  present expected bad: "), join_or_none("present_bad")))
    err = F.when(F.coalesce(F.col("expected_error"), F.lit("")) != "", F.concat(F.lit("  expected error: "), F.col("expected_error")))
    fm = F.when(F.col("failure_mode") != "", F.concat(F.lit("  failure mode: "), F.col("failure_mode")))
    notes = F.when(F.col("notes") != "", F.concat(F.lit("  notes: "), F.col("notes")))
    return results.select("id", F.concat_ws("\n", head, body, good, bad, err, fm, notes).alias("text"))
