"""Row numbering (W4), configured embedding slice (D16), vector fallback (D15)."""

from pyspark.sql import functions as F

from marquee.operators.index import build_index, with_row_numbers
from marquee.operators.vectors import active_slice


def test_row_numbers_follow_file_order(spark, tmp_path):
    p = tmp_path / "c.csv"
    lines = ["title,director,genres,score,actors"] + [f"T{i:03d},D,[],{i % 7}.0,[]" for i in range(300)]
    p.write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        df = spark.read.option("header", True).csv(str(p))
        assert df.rdd.getNumPartitions() > 1
        got = [(r["title"], r["row_number"]) for r in with_row_numbers(df).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(n for _, n in got) == list(range(1, 301))
    assert all(t == f"T{n - 1:03d}" for t, n in got)
    titles, _ = build_index(df)
    ids = {r["title"]: r["tconst"] for r in titles.collect()}
    assert ids["T000"] == "row:1" and ids["T299"] == "row:300"


def test_active_slice_uses_configuration(spark):
    emb = spark.createDataFrame(
        [("t1", [1.0, 0.0], "m", "v1", 2, True), ("t2", [1.0, 0.0], "m", "v2", 2, True),
         ("t3", [1.0], "m", "v1", 2, True), ("t4", [0.0, 1.0], "m", "v1", 2, False)],
        "tconst string, embedding array<float>, model_name string, model_version string, vector_dimension int, active boolean",
    )
    cfg = spark.createDataFrame([("m", "v1", 2)], "model_name string, model_version string, vector_dimension int")
    assert [r["tconst"] for r in active_slice(emb, cfg).collect()] == ["t1"]


def test_vector_fallback_routes_by_embedding(spark, eval_catalog):
    from marquee.plans.serving import recommend_with_fallback

    titles, terms = build_index(eval_catalog)
    emb = spark.createDataFrame(
        [("tt001", [1.0, 0.0]), ("tt002", [0.9, 0.1]), ("tt003", [0.0, 1.0])], "tconst string, embedding array<float>"
    ).select("tconst", "embedding", F.lit("m").alias("model_name"), F.lit("v1").alias("model_version"), F.lit(2).alias("vector_dimension"))
    cfg = spark.createDataFrame([("m", "v1", 2)], "model_name string, model_version string, vector_dimension int")
    r = recommend_with_fallback(titles, terms, emb, cfg, top_n=2, block_rows=2)
    rows = {}
    for x in r.orderBy("query_tconst", "rank").collect():
        rows.setdefault(x["query_tconst"], []).append((x["tconst"], x["source"]))
    assert rows["tt001"] == [("tt002", "vector"), ("tt003", "vector")]
    assert rows["tt008"][0] == ("tt002", "terms")  # no embedding: term overlap
    assert len(rows) == 8
