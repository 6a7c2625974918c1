"""Mix sources to target weights with capped water-filling.

Every source gets a share of the wanted total in proportion to its weight,
but never more than ``max_epochs`` times its own size; what a capped source
cannot take goes to the others by weight, until none is above its cap. The
fill level has a closed form: sources reach their cap in order of
cap / weight, so running sums in that order give the level at which the rest
absorbs the remainder.

A source's target is met by whole repetitions of all its documents and one
fractional repetition: documents in a seeded random order up to the remainder.
The order is by 16 bits of a hash, so a source is described by at most 65,536
sums whatever its size, and the cut falls within one of these (one document
in small sources, 1/65,536 of the source in large ones) of the target.
Documents themselves are never shuffled or sorted.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import text_or_empty, unused
from marquee.session import materialize

#: Most source rows (name and four numbers each) that are broadcast.
BROADCAST_SOURCES = 100_000
SALTS = 32


def with_word_count(df: DataFrame, text: str, into: str) -> DataFrame:
    """Add the number of words (runs of other than 20 and 09-0D; null: 0).

    Plain byte searches do the work for usual texts; only one with rare white
    space or repeated spaces goes through a regular expression.
    """
    flat, single = unused(df, into + "_flat"), unused(df, into + "_single")
    t = text_or_empty(text)
    rare = reduce(or_, [F.contains(t, F.lit(c)) for c in "\t\x0b\x0c\r"])
    out = df.withColumn(flat, F.when(rare, F.regexp_replace(t, r"[\x09-\x0D]", " ")).otherwise(F.replace(t, F.lit("\n"), F.lit(" "))))
    repeated = F.contains(F.col(flat), F.lit("  "))
    out = out.withColumn(single, F.trim(F.when(repeated, F.regexp_replace(F.col(flat), "  ++", " ")).otherwise(F.col(flat))))
    gaps = F.length(F.col(single)) - F.length(F.replace(F.col(single), F.lit(" "), F.lit("")))
    return out.withColumn(into, F.when(F.col(single) == "", F.lit(0)).otherwise(gaps + 1).cast("long")).drop(flat, single)


def draw(doc_id: Column, seed: int) -> Column:
    """16 seeded pseudo-random bits of a document id (null: of the word null)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")


def by_rotation(weights: tuple[float, ...]):
    """Weights given in turn to the sources in code point order, null last."""

    def give(sources: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
        listed = F.array(*[F.lit(float(w)) for w in weights])
        return sources.withColumn("weight", F.get(listed, (place % len(weights)).cast("int")))

    return give


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to (source, source_size, weight).

    One row per source goes through the two ordered sums; documents do not.
    If every source reaches its cap the wanted total is out of reach and all
    caps are returned. A source of size or weight zero gets zero.
    """
    wanted = F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy())
    capped = sources.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size")).withColumn("wanted", wanted)
    order = Window.orderBy((F.try_divide("cap", "weight")).asc_nulls_last(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = F.try_divide(F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.sum("weight").over(onward))
    # the first source that the level leaves below its cap fixes it for the rest
    leveled = capped.withColumn("level", level)
    stays_below = (F.col("weight") > 0) & (F.col("level") * F.col("weight") <= F.col("cap"))
    placed = F.struct(F.try_divide("cap", "weight").alias("r"), F.col("source").isNull().alias("n"), "source", "level")
    below = F.min(F.when(stays_below, placed)).over(Window.partitionBy())
    final = leveled.withColumn("fill", below["level"])
    return final.select(
        "source", "source_size", "weight",
        F.when(F.col("fill").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("fill") * F.col("weight"))).alias("target"),
    )


def plan_mix(docs: DataFrame, share: float, max_epochs: float, give_weights, seed: int) -> DataFrame:
    """One row per source: size, target, ``whole`` repetitions and ``cut``,
    the largest draw that gets one repetition more (-1: none).

    ``docs``: (source, size, draw). Sums are partial before the shuffle, so a
    hot source arrives as at most 65,536 sums from each task.
    """
    steps = docs.groupBy("source", "draw").agg(F.sum("size").alias("step"))
    sources = steps.groupBy("source").agg(F.sum("step").alias("source_size"))
    targets = water_fill(give_weights(sources), share, max_epochs)
    whole = F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    running = Window.partitionBy("source").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        steps.withColumn("before", F.coalesce(F.sum("step").over(running), F.lit(0)))
        .withColumnsRenamed({"source": "s"})
        .join(targets.select("source", "rest"), F.col("s").eqNullSafe(F.col("source")))
        .where((F.col("rest") > 0) & (F.col("before") + F.col("step") / 2 <= F.col("rest")))
        .groupBy("s").agg(F.max("draw").alias("cut"))
    )
    return targets.join(cut, F.col("s").eqNullSafe(F.col("source")), "left").select(
        "source", "source_size", "weight", "target", F.col("whole").cast("int").alias("whole"), F.coalesce("cut", F.lit(-1)).alias("cut")
    )


def mix(
    df: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", share: float = 1.5, max_epochs: float = 2.0,
    give_weights=None, seed: int = 42, into: str = "mix",
) -> DataFrame:
    """Add struct ``into``: size, source_size, target, repeats, taken.

    ``size`` is the number of words of the text (null: 0); ``repeats`` is how
    often the mix takes the document and ``taken`` the words that makes. Null
    is a source like any other. Rows of one id share one draw, so repeated
    rows are taken alike. An empty table gives no row.

    The plan per source is written to the shared folder first: it is small,
    its row count decides between a broadcast and a salted join, and the
    documents are then only streamed past it.
    """
    spark = df.sparkSession
    give_weights = give_weights or by_rotation((3.0, 1.0, 2.0))
    needed = df.select(F.col(source).alias("source"), F.col(text).alias("text"), draw(F.col(doc_id), seed).alias("draw"))
    measured = with_word_count(needed, "text", "size").drop("text")
    plan = materialize(plan_mix(measured, share, max_epochs, give_weights, seed), "mix-plan")

    m, s, salt = unused(df, "mix_measured"), unused(df, "mix_source"), unused(df, "mix_salt")
    n = unused(df, "mix_words")
    docs = with_word_count(df, text, n).withColumn(m, F.struct(F.col(n).alias("size"), draw(F.col(doc_id), seed).alias("draw"))).drop(n)
    per_source = plan.select(F.struct(*plan.columns).alias(s))
    same = F.col(source).eqNullSafe(F.col(f"{s}.source"))
    if plan.count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(per_source), same)
    else:  # split every source, hot ones included, over several tasks
        spread = per_source.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        docs = docs.withColumn(salt + "d", F.pmod(F.col(f"{m}.draw"), F.lit(SALTS)))
        joined = docs.join(spread, same & (F.col(salt + "d") == F.col(salt))).drop(salt, salt + "d")
    repeats = F.col(f"{s}.whole") + F.when(F.col(f"{m}.draw") <= F.col(f"{s}.cut"), 1).otherwise(0)
    fields = F.struct(
        F.col(f"{m}.size").alias("size"),
        F.col(f"{s}.source_size").alias("source_size"),
        F.col(f"{s}.target").alias("target"),
        repeats.alias("repeats"),
        (repeats * F.col(f"{m}.size")).cast("long").alias("taken"),
    )
    return joined.withColumn(into, fields).drop(m, s)
