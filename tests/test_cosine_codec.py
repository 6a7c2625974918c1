"""Cosine recommender goldens, soup text and the list-literal codec."""

from pyspark.sql import functions as F

from conftest import recs_by_query
from marquee.functions.listcodec import decode_list, encode_list
from marquee.functions.scalars import soup
from marquee.operators.cosine import cosine_recommend


def test_soup_golden(spark):
    df = spark.createDataFrame(
        [(["Actor X", "Actor Y"], ["Director A", "Director A"], ["Action", "Thriller"])],
        "a array<string>, d array<string>, g array<string>",
    )
    assert df.select(soup(F.col("a"), F.col("d"), F.col("g"))).first()[0] == "actorxactory directoradirectora actionthriller"


def test_cosine_basic(spark):
    rows = [
        ("Movie A", "Director A", "Action", 9.0, "Actor X Actor Y"),
        ("Movie B", "Director B", "Action", 8.0, "Actor Y Actor Z"),
        ("Movie C", "Director C", "Drama", 8.5, "Actor X Actor W"),
    ]
    cat = spark.createDataFrame(rows, "title string, director string, genres string, score double, actors string")
    req = spark.createDataFrame([("Movie A",)], "title string")
    assert recs_by_query(cosine_recommend(cat, req, top_n=2))["Movie A"] == ["Movie B", "Movie C"]


def test_cosine_duplicate_titles(spark):
    rows = [
        ("tt001", "Same Title", "Dir One", "['Action']", 9.0, "['Actor One']"),
        ("tt002", "Same Title", "Dir Two", "['Comedy']", 8.0, "['Actor Two']"),
        ("tt003", "Other Title", "Dir Three", "['Drama']", 7.5, "['Actor Three']"),
    ]
    cat = spark.createDataFrame(rows, "tconst string, title string, director string, genres string, score double, actors string")
    req = spark.createDataFrame([("Same Title (tt001)",)], "title string")
    got = recs_by_query(cosine_recommend(cat, req, top_n=2))
    assert got["Same Title (tt001)"] == ["Same Title (tt002)", "Other Title"]


def test_cosine_hot_path_equals_default(spark, eval_catalog):
    a = recs_by_query(cosine_recommend(eval_catalog, top_n=4))
    b = recs_by_query(cosine_recommend(eval_catalog, top_n=4, hot_min_df=1))
    assert a == b and a["Neon Heist"][0] == "Midnight Crew"


def test_decode_list_literals(spark):
    cases = [
        ("['a', 'b']", ["a", "b"]),
        ("[\"O'Brien\", 'x']", ["O'Brien", "x"]),
        ("['it\\'s']", ["it's"]),
        ("['a', nan]", ["a", None]),
        ("['a', None]", ["a", None]),
        ("[]", []),
        ("plain text", ["plain text"]),
        ("", []),
        (None, []),
    ]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    got = [r[0] for r in df.select(decode_list(F.col("t"))).collect()]
    assert got == [want for _, want in cases]


def test_encode_decode_round_trip(spark):
    vals = [["a", "b"], ["O'Brien", 'say "hi"'], ["back\\slash"], [None, "x"], []]
    df = spark.createDataFrame([(v,) for v in vals], "v array<string>")
    enc = df.select(encode_list(F.col("v")).alias("t"))
    texts = [r[0] for r in enc.collect()]
    assert texts[0] == "['a', 'b']" and texts[1] == "[\"O'Brien\", 'say \"hi\"']" and texts[4] == "[]"
    back = [r[0] for r in enc.select(decode_list(F.col("t"))).collect()]
    assert back == vals
