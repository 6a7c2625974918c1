"""Raw TSV traps, file jobs, search, features, lineage, vectors."""

import os

import numpy as np
from pyspark.sql import functions as F

from marquee.operators import features as fe
from marquee.operators import lineage as ln
from marquee.operators.search import fuzzy_title_search, jaccard
from marquee.operators.vectors import vector_topk
from marquee.sources.raw import load_sources


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def test_raw_tsv_quotes_and_markers(spark, tmp_path):
    d = tmp_path / "src"
    _write(str(d / "title.basics.tsv"), "tconst\ttitleType\tprimaryTitle\tgenres\textra\n"
           'tt1\tmovie\t"Quoted start\tDrama\tx\ntt2\tmovie\tNone\t\\N\ty\ntt3\tmovie\tNA\tComedy,Drama\tz\n')
    _write(str(d / "title.crew.tsv"), "tconst\tdirectors\ntt1\tnm1\ntt2\t\\N\ntt3\tnm3\n")
    _write(str(d / "title.ratings.tsv"), "tconst\taverageRating\tnumVotes\ntt1\t7.0\t10\ntt2\t8.0\t20\ntt3\tbad\t30\n")
    _write(str(d / "title.principals.tsv"), "tconst\tordering\tnconst\tcategory\ntt1\t1\tnm9\tactor\n")
    _write(str(d / "name.basics.tsv"), "nconst\tprimaryName\nnm1\tOne\nnm9\tNine\n")
    src = load_sources(spark, str(d))
    titles = {r["tconst"]: r for r in src["titles"].collect()}
    assert titles["tt1"]["primaryTitle"] == '"Quoted start'
    assert titles["tt2"]["primaryTitle"] == "None" and titles["tt3"]["primaryTitle"] == "NA"
    assert titles["tt2"]["genres"] == "\\N"
    assert src["titles"].columns == ["tconst", "titleType", "primaryTitle", "genres"]
    ratings = {r["tconst"]: r for r in src["ratings"].collect()}
    assert ratings["tt3"]["averageRating"] is None and ratings["tt3"]["numVotes"] == 30


def test_curate_files_round_trip(spark, tmp_path):
    from marquee.plans.jobs import curate_files
    from marquee.sources.curated_io import read_curated_csv

    d = tmp_path / "src"
    _write(str(d / "title.basics.tsv"), "tconst\ttitleType\tprimaryTitle\tgenres\n"
           "tt001\tmovie\tSame Title\tDrama\ntt002\tmovie\tSame Title\tComedy\n")
    _write(str(d / "title.crew.tsv"), "tconst\tdirectors\ntt001\tnm001\ntt002\tnm002\n")
    _write(str(d / "title.ratings.tsv"), "tconst\taverageRating\tnumVotes\ntt001\t7.0\t10\ntt002\t8.0\t20\n")
    _write(str(d / "title.principals.tsv"), "tconst\tordering\tnconst\tcategory\ntt001\t1\tnm101\tactor\ntt002\t1\tnm102\tactor\n")
    _write(str(d / "name.basics.tsv"), "nconst\tprimaryName\nnm001\tD One\nnm002\tD Two\nnm101\tO'Brien\nnm102\tA Two\n")
    res = curate_files(spark, str(d), str(tmp_path / "out" / "movies"), vote_quantile=None, min_votes=0)
    csv = read_curated_csv(spark, res.csv_path)
    assert csv.columns == ["tconst", "title", "primary_title", "director", "director_ids", "director_names",
                           "genres", "score", "cast_ids", "actors"]
    rows = {r["tconst"]: r for r in csv.collect()}
    assert rows["tt001"]["title"] == "Same Title (tt001)"
    assert rows["tt001"]["actors"] == "[\"O'Brien\"]"
    assert res.curated.count() == 2


def test_fuzzy_search_matches_brute_force(spark):
    movies = spark.createDataFrame(
        [("t1", "Neon Heist", "Neon Heist", 8.0), ("t2", "Neon Nights", "Neon Nights", 7.0),
         ("t3", "Heist", "Heist", 9.0), ("t4", "Garden", "Garden", 5.0), ("t5", "Neon Heist", "Neon Heist", 6.0)],
        "tconst string, display_title string, primary_title string, weighted_score double",
    )
    req = spark.createDataFrame([("r1", "neon heist"), ("r2", "gardn"), ("r3", "zzz")], "request_id string, query string")
    got = [(r["request_id"], r["tconst"]) for r in fuzzy_title_search(movies, req, 0.3, 10).orderBy("request_id", "rank").collect()]
    from marquee.functions.text import trigrams

    m = movies.withColumn("g", trigrams(F.col("display_title")))
    q = req.withColumn("rg", trigrams(F.col("query")))
    brute = (
        q.crossJoin(m).withColumn("s", jaccard(F.col("g"), F.col("rg"))).where("s >= 0.3")
        .orderBy("request_id", F.col("s").desc(), F.col("weighted_score").desc(), "display_title", "tconst")
    )
    assert got == [(r["request_id"], r["tconst"]) for r in brute.collect()]
    assert got[0] == ("r1", "t1") and ("r1", "t5") in got


def test_feature_versions_keep_one_active(spark):
    cur = spark.createDataFrame(
        [("tt1", "A", "A", ["Drama"], ["Dir"], ["X", None])],
        "tconst string, title string, primary_title string, genres array<string>, director_names array<string>, actors array<string>",
    )
    v1 = fe.add_feature_run(None, fe.recommendation_soup(cur), 1)
    assert v1.first()["source_text"] == "a | drama | dir | x"
    cur2 = cur.withColumn("actors", F.array(F.lit("X"), F.lit("Y")))
    v2 = fe.add_feature_run(v1, fe.recommendation_soup(cur2), 2)
    rows = sorted((r["source_etl_run_id"], r["active"]) for r in v2.collect())
    assert rows == [(1, False), (2, True)]
    v3 = fe.add_feature_run(v2, fe.recommendation_soup(cur2), 3)
    assert v3.count() == 2 and fe.one_active_violations(v3).count() == 0


def test_upsert_latest_wins(spark):
    a = spark.createDataFrame([(1, "x", 1, 10.0), (1, "x", 2, 11.0), (2, "y", 1, 5.0)], "k long, t string, ts long, v double")
    b = spark.createDataFrame([(1, "x", 3, 12.0), (3, "z", 3, 1.0)], "k long, t string, ts long, v double")
    out = {(r["k"], r["t"]): r for r in ln.upsert_latest(a, b, ["k", "t"], ["ts"]).collect()}
    assert out[(1, "x")]["v"] == 12.0 and out[(1, "x")]["first_seen"] == 1 and out[(1, "x")]["versions"] == 3
    assert out[(2, "y")]["v"] == 5.0 and len(out) == 3


def test_credits_crew_authoritative(spark):
    crew = spark.createDataFrame([("tt1", "nm1,nm2")], "tconst string, directors string")
    pr = spark.createDataFrame(
        [("tt1", 1, "nm1", "director"), ("tt1", 2, "nm3", "actor"), ("tt1", 3, "nm1", "actor")],
        "tconst string, ordering long, nconst string, category string",
    )
    got = sorted((r["nconst"], r["role_type"], r["credit_order"]) for r in fe.credits(crew, pr).collect())
    assert got == [("nm1", "actor", 3), ("nm1", "director", 1), ("nm2", "director", 2), ("nm3", "actor", 2)]


def test_vector_topk_matches_numpy(spark):
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(40, 8)).astype(np.float32)
    df = spark.createDataFrame([(str(i), [float(x) for x in v]) for i, v in enumerate(vecs)], "id string, embedding array<float>")
    got = {(r["q"], r["rank"]): r["c"] for r in vector_topk(df, k=3, blocks=3).collect()}
    v = vecs.astype(np.float64)
    n = np.linalg.norm(v, axis=1)
    d = 1 - (v @ v.T) / np.outer(n, n)
    np.fill_diagonal(d, np.inf)
    for i in range(40):
        order = sorted(range(40), key=lambda j: (d[i, j], str(j)))[:3]
        assert [got[(str(i), r)] for r in (1, 2, 3)] == [str(j) for j in order]


def test_fuzzy_search_many_duplicates_matches_brute_force(spark):
    import random

    rnd = random.Random(3)
    names = ["red widget", "red wodget", "blue bolt", "small ring", "small rings"]
    rows = [(f"t{i:03d}", n, n, float(rnd.randint(0, 3))) for i, n in enumerate(rnd.choice(names) for _ in range(120))]
    movies = spark.createDataFrame(rows, "tconst string, display_title string, primary_title string, weighted_score double")
    req = spark.createDataFrame([("a", "red widge"), ("b", "small rin"), ("c", "blu bolt")], "request_id string, query string")
    got = [(r["request_id"], r["tconst"]) for r in fuzzy_title_search(movies, req, 0.3, 4).orderBy("request_id", "rank").collect()]
    from pyspark.sql import Window

    from marquee.functions.text import trigrams

    m = movies.withColumn("g", trigrams(F.col("display_title")))
    q = req.withColumn("rg", trigrams(F.col("query")))
    w = Window.partitionBy("request_id").orderBy(F.col("s").desc(), F.col("weighted_score").desc(), "display_title", "tconst")
    brute = (
        q.crossJoin(m).withColumn("s", jaccard(F.col("g"), F.col("rg"))).where("s >= 0.3")
        .withColumn("rank", F.row_number().over(w)).where("rank <= 4").orderBy("request_id", "rank")
    )
    assert got == [(r["request_id"], r["tconst"]) for r in brute.collect()]
    assert len(got) == 12


def test_vector_topk_emits_k_of_many_ties(spark):
    from marquee.operators.vectors import _block_topk
    import pandas as pd

    same = pd.DataFrame({"id": [str(i) for i in range(400)], "embedding": [[1.0, 2.0]] * 400, "score": [float(i % 7) for i in range(400)], "title": [None if i % 5 == 0 else f"t{i % 11}" for i in range(400)]})
    out = _block_topk(10)(same, same)
    assert len(out) == 400 * 10
    first = out[out["q"] == "0"]
    order = same[same["id"] != "0"].assign(nt=lambda d: d["title"].isna(), t=lambda d: d["title"].fillna(""), s=lambda d: -d["score"])
    assert list(first["c"]) == list(order.sort_values(["s", "nt", "t", "id"])["id"][:10])
