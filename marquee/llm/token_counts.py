"""Exact histogram of encoded lengths and what it answers.

Documents are reduced to their encoded length, and the lengths to a histogram
(partial sums before the shuffle, so copies and hot sources weigh nothing).
Sums over all longer documents then answer, for every context limit, totals,
quantiles and the tokens that remain after truncation. The sums run on two
levels, over ranges of lengths and inside each range, so no task sees the
whole histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.session import materialize

#: Lengths per range of the two-level sums.
RANGE = 256
LIMITS = (512, 1024, 2048, 4096, 8192, 16384, 32768, 65536, 131072)
QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)


def length_histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """(length, n_docs); a null length counts as 0."""
    return lengths.groupBy(F.coalesce(F.col(length), F.lit(0)).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))


def answers(histogram: DataFrame, limits: tuple[int, ...] = LIMITS, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """One row per context limit: every observed length and every ``limits``.

    Columns: context_limit, n_docs (of exactly that length), docs_within,
    docs_over, total_docs, total_tokens, truncated_total (tokens left when
    every document is cut to the limit), share_within and quantiles (those
    ``q`` whose value this length is: the smallest length that a share of at
    least ``q`` of the documents does not exceed). Between two observed
    lengths the counts are those of the lower one, so the rows determine the
    answer for any other limit. No documents: total 0, share null.
    """
    spark = histogram.sparkSession
    histogram = materialize(histogram, "length-histogram")  # it is read twice, its documents only once
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("length"), F.lit(0).cast("long").alias("n_docs"))
    rows = histogram.unionByName(wanted).groupBy("length").agg(F.sum("n_docs").alias("n_docs"))
    rows = rows.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("range", F.floor(F.col("length") / RANGE))

    above = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    ranges = rows.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t")).select(
        "range",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(all_rows).alias("total_docs"),
        F.sum("t").over(all_rows).alias("total_tokens"),
    )
    inside = Window.partitionBy("range").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    summed = (
        rows.withColumn("docs_in", F.coalesce(F.sum("n_docs").over(inside), F.lit(0)))
        .withColumn("tokens_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(ranges, "range")
        .withColumn("docs_over", F.col("docs_above") + F.col("docs_in"))
        .withColumn("tokens_over", F.col("tokens_above") + F.col("tokens_in"))
        .withColumn("docs_within", F.col("total_docs") - F.col("docs_over"))
    )
    met = lambda q: F.ceil(F.lit(q) * F.col("total_docs"))
    here = [
        F.when((F.col("n_docs") > 0) & (F.col("docs_within") >= met(q)) & (F.col("docs_within") - F.col("n_docs") < met(q)), F.lit(str(q)))
        for q in quantiles
    ]
    return summed.select(
        F.col("length").alias("context_limit"),
        "n_docs",
        "docs_within",
        "docs_over",
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - F.col("tokens_over") + F.col("length") * F.col("docs_over")).alias("truncated_total"),
        F.try_divide("docs_within", "total_docs").alias("share_within"),
        F.concat_ws(",", *here).alias("quantiles"),
    )
