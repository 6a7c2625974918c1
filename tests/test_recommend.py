"""Overlap recommender goldens, traps and the exact-vs-brute-force property."""

import json
import random

import pytest
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conftest import errors_by_query, recs_by_query
from marquee.functions.scalars import NOT_FOUND_ERROR
from marquee.operators.index import build_index, violations
from marquee.operators.recommend import recommend
from marquee.operators.similarity import topk_shared

SCHEMA = "title string, director string, genres string, score double, actors string"
ID_SCHEMA = "tconst string, " + SCHEMA


def brute_force_topk(feats: DataFrame, items: DataFrame, k: int, mode: str = "overlap") -> DataFrame:
    """Reference plan: join every pair sharing a feature (small inputs only)."""
    attrs = ["score", "title"] if mode == "overlap" else []
    f = feats.select("id", "feat", F.col("w").cast("bigint").alias("w"))
    norms = f.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("n2"))
    pairs = (
        f.alias("a")
        .join(f.alias("b"), "feat")
        .where(F.col("a.id") != F.col("b.id"))
        .groupBy(F.col("a.id").alias("q"), F.col("b.id").alias("c"))
        .agg(F.sum(F.col("a.w") * F.col("b.w")).alias("dot"))
    )
    it = items.select(F.col("id").alias("c"), *attrs).join(norms.withColumnRenamed("id", "c"), "c")
    p = pairs.join(it, "c").join(norms.select(F.col("id").alias("q"), F.col("n2").alias("q_n2")), "q")
    if mode == "overlap":
        p = p.withColumn("sim", F.col("dot").cast("double"))
        order = [F.col("dot").desc(), F.col("score").desc_nulls_last(), F.col("title").asc_nulls_last(), F.col("c")]
    else:
        p = p.withColumn("sim", F.col("dot") / (F.sqrt(F.col("q_n2")) * F.sqrt(F.col("n2"))))
        order = [F.col("sim").desc(), F.col("c")]
    r = p.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
    return r.select("q", "c", "dot", "sim", "rank", *attrs)


def run(spark, rows, queries, schema=SCHEMA, **kw):
    cat = spark.createDataFrame(rows, schema)
    titles, terms = build_index(cat)
    req = spark.createDataFrame([(q,) for q in queries], "title string")
    return recommend(titles, terms, req, **kw)


def test_fixture_goldens_limit_500_and_1(spark, eval_catalog):
    titles, terms = build_index(eval_catalog)
    assert terms.count() == 34
    got500 = recs_by_query(recommend(titles, terms, None, top_n=3, candidate_limit=500))
    got1 = recs_by_query(recommend(titles, terms, None, top_n=3, candidate_limit=1))
    assert got500["Neon Heist"] == ["Midnight Crew", "Crime Alley", "Silent Orchard"]
    assert got500["Deep Space Laughs"] == ["Space Garden", "Galaxy Chase", "Romantic Kitchen"]
    assert got500["Romantic Kitchen"] == ["Deep Space Laughs", "Silent Orchard", "Neon Heist"]
    assert got1["Neon Heist"] == ["Midnight Crew", "Silent Orchard", "Space Garden"]
    assert got1["Space Garden"] == ["Galaxy Chase", "Silent Orchard", "Neon Heist"]
    # the hot-feature path gives the same lists (fixed and automatic cuts)
    assert recs_by_query(recommend(titles, terms, None, top_n=3, candidate_limit=500, hot_min_df=256)) == got500
    assert recs_by_query(recommend(titles, terms, None, top_n=3, candidate_limit=500, hot_min_df=1)) == got500
    assert recs_by_query(recommend(titles, terms, None, top_n=3, candidate_limit=1, hot_min_df=1)) == got1


def test_overlap_basic_with_typed_lists(spark):
    rows = [
        ("tt001", "Movie A", "Director A", ["Action"], 9.0, ["Actor X", "Actor Y"]),
        ("tt002", "Movie B", "Director B", ["Action"], 8.0, ["Actor Y"]),
        ("tt003", "Movie C", "Director C", ["Drama"], 8.5, ["Actor X"]),
    ]
    schema = "tconst string, title string, director string, genres array<string>, score double, actors array<string>"
    got = recs_by_query(run(spark, rows, ["Movie A"], schema=schema, top_n=2))
    assert got["Movie A"] == ["Movie B", "Movie C"]


def test_plain_text_lists(spark):
    rows = [
        ("Movie A", "Director A", "Action", 9.0, "Actor X Actor Y"),
        ("Movie B", "Director B", "Action", 8.0, "Actor Y Actor Z"),
        ("Movie C", "Director C", "Drama", 8.5, "Actor X Actor W"),
    ]
    assert recs_by_query(run(spark, rows, ["Movie A"], top_n=2))["Movie A"] == ["Movie B", "Movie C"]


def test_duplicate_titles_need_suffix(spark):
    rows = [
        ("tt001", "Same Title", "Dir One", "['Action']", 9.0, "['Actor One']"),
        ("tt002", "Same Title", "Dir Two", "['Comedy']", 8.0, "['Actor Two']"),
        ("tt003", "Other Title", "Dir Three", "['Drama']", 7.5, "['Actor Three']"),
    ]
    r = run(spark, rows, ["Same Title (tt001)", "Same Title"], schema=ID_SCHEMA, top_n=2)
    assert recs_by_query(r)["Same Title (tt001)"] == ["Same Title (tt002)", "Other Title"]
    assert errors_by_query(r) == {"Same Title": NOT_FOUND_ERROR}


def test_candidate_cap_then_score_fill(spark):
    rows = [
        ("Movie A", "Dir A", "['Action']", 9.0, "['P1']"),
        ("Movie B", "Dir B", "['Action']", 8.0, "['P2']"),
        ("Movie C", "Dir C", "['Action']", 7.0, "['P3']"),
        ("Movie D", "Dir D", "['Drama']", 10.0, "['P4']"),
    ]
    r = run(spark, rows, ["Movie A"], top_n=3, candidate_limit=1)
    assert recs_by_query(r)["Movie A"] == ["Movie B", "Movie D", "Movie C"]
    assert [x["tconst"] for x in r.orderBy("rank").collect()][0] == "row:2"


def test_distinct_candidates_under_cap(spark):
    rows = [
        ("Movie A", "Aab", "['Aaa']", 9.0, "[]"),
        ("Movie B", "Aab", "['Aaa']", 8.0, "[]"),
        ("Movie C", "Aab", "['Zzz']", 7.0, "[]"),
    ]
    from marquee.operators.recommend import candidates

    cat = spark.createDataFrame(rows, SCHEMA)
    titles, terms = build_index(cat)
    c = candidates(titles, terms, candidate_limit=2).where("query_tconst = 'row:1'").orderBy("rank")
    assert [x["tconst"] for x in c.collect()] == ["row:2", "row:3"]


def test_overlap_beats_score_under_cap(spark):
    rows = [
        ("Movie A", "Aab", "['Aaa']", 9.0, "[]"),
        ("Movie B", "Aab", "['Other']", 8.0, "[]"),
        ("Movie C", "Aab", "['Other']", 7.0, "[]"),
        ("Movie D", "Aab", "['Aaa']", 1.0, "[]"),
    ]
    assert recs_by_query(run(spark, rows, ["Movie A"], top_n=1, candidate_limit=1))["Movie A"] == ["Movie D"]


def test_score_order_inside_equal_overlap(spark):
    rows = [(f"Movie {c}", f"Dir {c}", "['Action']", s, "[]") for c, s in zip("ABCDE", (9.0, 1.0, 2.0, 8.0, 10.0))]
    assert recs_by_query(run(spark, rows, ["Movie A"], top_n=2, candidate_limit=4))["Movie A"] == ["Movie E", "Movie D"]


def test_limits_clamp_and_unknown_title(spark, eval_catalog):
    titles, terms = build_index(eval_catalog)
    req = spark.createDataFrame([("Neon Heist",), ("Not In Fixture",)], "title string")
    r0 = recommend(titles, terms, req, top_n=0)
    assert r0.where("rank is not null").count() == 0
    assert errors_by_query(r0) == {"Not In Fixture": NOT_FOUND_ERROR}
    rneg = recommend(titles, terms, req, top_n=3, candidate_limit=-5)
    # candidate limit clamps to 0: pure score fallback
    assert recs_by_query(rneg)["Neon Heist"] == ["Silent Orchard", "Space Garden", "Galaxy Chase"]
    assert recommend(titles, terms, req, top_n=-2).where("rank is not null").count() == 0


def test_violations_reported(spark):
    rows = [
        (None, "Dup", "D", "['x']", "8.0", "[]"),
        (None, "Dup", "D", "['x']", "7.0", "[]"),
        ("tt9", "Bad", "D", "['x']", "abc", "[]"),
    ]
    cat = spark.createDataFrame(rows, "tconst string, title string, director string, genres string, score string, actors string")
    kinds = sorted(r["kind"] for r in violations(cat).collect())
    assert kinds == ["bad_score", "duplicate_title_without_id", "duplicate_title_without_id"]
    with pytest.raises(ValueError, match="bad_score.*duplicate_title_without_id"):
        build_index(cat)  # refused as a whole, not thinned out


def test_missing_required_columns(spark):
    cat = spark.createDataFrame([("a", 1.0)], "title string, score double")
    with pytest.raises(ValueError, match="actors, director, genres"):
        build_index(cat)


@pytest.mark.parametrize("seed", [1, 2])
def test_engine_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    n_items = 60
    vocab = [f"t{i}" for i in range(25)]
    weights = [40, 30] + [1] * 23  # two very common features
    feats = set()
    for i in range(n_items):
        for f in rnd.choices(vocab, weights=weights, k=rnd.randint(0, 5)):
            feats.add((f"i{i:03d}", f, rnd.randint(1, 3)))
    by_key = {}
    for i, f, w in feats:
        by_key[(i, f)] = w
    frows = [(i, f, w) for (i, f), w in by_key.items()]
    items = spark.createDataFrame(
        [(f"i{i:03d}", float(rnd.randint(0, 5)), f"title {i:03d}") for i in range(n_items)], "id string, score double, title string"
    )
    fdf = spark.createDataFrame(frows, "id string, feat string, w long")
    fdf1 = fdf.withColumn("w", F.lit(1).cast("long"))
    for mode, f in (("overlap", fdf1), ("cosine", fdf)):
        it = items if mode == "overlap" else items.select("id")
        k = 3
        want = sorted(tuple(r) for r in brute_force_topk(f, it, k, mode).select("q", "c", "rank").collect())
        # all rare / hot sub-vector lists / heavy items paired directly
        for hot, max_hot in ((1000, 10), (5, 10), (1, 1), ("auto", 10)):
            got = sorted(
                tuple(r) for r in topk_shared(f, it, k, mode, hot_min_df=hot, max_hot=max_hot).select("q", "c", "rank").collect()
            )
            assert got == want, (mode, k, hot, max_hot)


def test_evaluation_fixture_report(spark, eval_catalog, tmp_path):
    from marquee.operators.evaluate import case_results, load_cases, report

    cases_doc = {
        "schema_version": 1,
        "scorer": "sqlite-bounded-term-overlap",
        "cases": [
            {"id": "crime-shared-terms", "query": "Neon Heist", "top_n": 3,
             "expected_good": ["Midnight Crew", "Crime Alley"], "expected_bad": ["Romantic Kitchen"]},
            {"id": "scifi-adventure-cluster", "query": "Space Garden", "top_n": 3,
             "expected_good": ["Galaxy Chase", "Deep Space Laughs"], "expected_bad": ["Romantic Kitchen"]},
            {"id": "missing-title", "query": "Not In Fixture", "top_n": 3, "expected_good": [], "expected_bad": [],
             "expected_error": "This movie is not in the dataset."},
        ],
    }
    p = tmp_path / "cases.json"
    p.write_text(json.dumps(cases_doc, indent=2))
    cases = load_cases(spark, str(p))
    titles, terms = build_index(eval_catalog)
    rep = report(case_results(cases, titles, terms)).first().asDict()
    assert rep["cases_total"] == 3 and rep["cases_passed"] == 3
    assert rep["expected_good_hits"] == 4 and rep["expected_bad_absent"] == 2
    assert rep["expected_error_hits"] == 1 and rep["expected_error_total"] == 1 and rep["passed"] is True

    bad = cases_doc | {"cases": [{"id": "fail", "query": "Neon Heist", "top_n": 3,
                                  "expected_good": ["Midnight Crew"], "expected_bad": ["Midnight Crew"]}]}
    p2 = tmp_path / "bad.json"
    p2.write_text(json.dumps(bad))
    res = case_results(load_cases(spark, str(p2)), titles, terms)
    r = res.first()
    assert r["passed"] is False and r["present_bad"] == ["Midnight Crew"]
    assert report(res).first()["cases_passed"] == 0


def test_recommend_titles_convenience(spark, eval_catalog):
    from marquee.operators.recommend import recommend_titles

    titles, terms = build_index(eval_catalog)
    got = recs_by_query(recommend_titles(titles, terms, ["Neon Heist", "Not In Fixture"], top_n=3))
    assert got["Neon Heist"] == ["Midnight Crew", "Crime Alley", "Silent Orchard"] and got["Not In Fixture"] == []
