"""Candidate pairs of the fuzzy search: none lost, at most half verified."""

import random

from pyspark.sql import functions as F

from marquee.functions.text import trigrams
from marquee.operators import search as se


def sets_of(spark, texts):
    df = spark.createDataFrame(sorted(enumerate(sorted(set(texts)))), "id bigint, text string")
    return df.select("id", F.array_sort(trigrams(F.col("text"))).alias("grams")).where(F.size("grams") > 0)


def pairs(df):
    return {(r["r"], r["t"]) for r in df.collect()}


def similar(a, b):
    return len(a & b) / len(a | b)


def test_no_pair_is_lost_and_few_are_verified(spark, monkeypatch):
    rnd = random.Random(7)
    words = ["part", "steel", "brass", "copper", "anodized", "plated", "large", "small", "night", "river", "a", "of", "the"]
    titles = [" ".join(rnd.choices(words, k=rnd.randint(1, 6))) for _ in range(250)]
    asked = [" ".join(rnd.choices(words, k=rnd.randint(1, 4))) + rnd.choice(["", "x", " zz"]) for _ in range(60)] + ["", "  "]
    t, r = sets_of(spark, titles), sets_of(spark, asked)
    tg, rg = ({x["id"]: set(x["grams"]) for x in df.collect()} for df in (t, r))
    for threshold in (0.3, 0.5, 0.8, 1.0):
        found = pairs(se.candidate_pairs(r, t, threshold))
        true = {(i, j) for i, a in rg.items() for j, b in tg.items() if similar(a, b) >= threshold}
        assert true <= found
        monkeypatch.setattr(se, "HOT_TRIGRAM", 10)  # frequent trigrams dealt over tasks
        assert pairs(se.candidate_pairs(r, t, threshold)) == found
        monkeypatch.undo()


def test_given_names_need_fewer_verifications(spark):
    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet")
    names = [x["n"] for x in part.select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("n")).distinct().collect()]
    sets = sets_of(spark, names)
    asked = sets.where("id % 40 = 0")
    plain, placed = (pairs(se.candidate_pairs(asked, sets, 0.5, positional=p)) for p in (False, True))
    grams = {x["id"]: set(x["grams"]) for x in sets.collect()}
    true = {(i, j) for i in (x["id"] for x in asked.collect()) for j in grams if similar(grams[i], grams[j]) >= 0.5}
    assert true <= placed < plain and len(placed) < 0.75 * len(plain)
