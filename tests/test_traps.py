"""Trap tests for term, token and lookup semantics."""

from pyspark.sql import functions as F

from conftest import recs_by_query
from marquee.functions.scalars import normalize_term, split_ids
from marquee.functions.text import word_tokens
from marquee.operators.cosine import token_counts
from marquee.operators.index import build_index, prepare_catalog


def test_term_normalisation(spark):
    df = spark.createDataFrame([("Pedro Almodóvar",), ("Jean-Luc Godard",), ("黒澤 明",), ("Sci-Fi",)], "v string")
    got = [r[0] for r in df.select(normalize_term(F.col("v"))).collect()]
    assert got == ["pedroalmodvar", "jeanlucgodard", "", "scifi"]


def test_split_ids_edges(spark):
    df = spark.createDataFrame([("a,,\\N,b",), ("\\N",), (None,), ("",), ("x,y,z,w",)], "v string")
    assert [r[0] for r in df.select(split_ids(F.col("v"))).collect()] == [["a", "b"], [], [], [], ["x", "y", "z", "w"]]
    assert [r[0] for r in df.select(split_ids(F.col("v"), 3)).collect()][4] == ["x", "y", "z"]


def test_empty_terms_dropped_and_shared_namespace(spark):
    rows = [("A", "Same Person", "['Drama']", 1.0, "['Same Person', '黒澤']")]
    cat = spark.createDataFrame(rows, "title string, director string, genres string, score double, actors string")
    _, terms = build_index(cat)
    assert sorted(r["term"] for r in terms.collect()) == ["drama", "sameperson"]


def test_primary_title_falls_back_to_suffixed_title(spark):
    rows = [("t1", "Dup", "D", "[]", 1.0, "[]"), ("t2", "Dup", "D", "[]", 2.0, "[]")]
    cat = spark.createDataFrame(rows, "tconst string, title string, director string, genres string, score double, actors string")
    titles, _ = build_index(cat)
    got = {r["tconst"]: (r["title"], r["primary_title"]) for r in titles.collect()}
    assert got == {"t1": ("Dup (t1)", "Dup (t1)"), "t2": ("Dup (t2)", "Dup (t2)")}


def test_scalar_cells_stay_raw_text(spark):
    cat = spark.createDataFrame([("A", "1.50", "Drama", "7", "Actor One")],
                                "title string, director string, genres string, score string, actors string")
    p = prepare_catalog(cat).first()
    assert p["director_values"] == ["1.50"] and p["genres"] == ["Drama"] and p["score"] == 7.0


def test_unicode_word_tokens(spark):
    df = spark.createDataFrame([("['élodie', 'o'brien', 'x', 'a_b']",)], "v string")
    assert df.select(word_tokens(F.col("v"))).first()[0] == ["élodie", "brien", "a_b"]


def test_null_names_give_no_cosine_tokens(spark):
    items = spark.createDataFrame([("i1", None, ["Actor One", None], ["Drama"])],
                                  "id string, director string, actors array<string>, genres array<string>")
    got = sorted((r["feat"], r["w"]) for r in token_counts(items, ()).collect())
    assert got == [("actorone", 1), ("drama", 1)]


def test_director_counts_twice(spark):
    items = spark.createDataFrame([("i1", "Ava Lin", ["Ava Lin"], [])],
                                  "id string, director string, actors array<string>, genres array<string>")
    assert token_counts(items, ()).first()["w"] == 3


def test_unknown_title_with_zero_top_n_and_all_requests(spark, eval_catalog):
    from marquee.operators.recommend import recommend

    titles, terms = build_index(eval_catalog)
    req = spark.createDataFrame([("Neon Heist", 2), ("Space Garden", 0)], "title string, top_n int")
    got = recs_by_query(recommend(titles, terms, req, top_n=3))
    assert got["Neon Heist"] == ["Midnight Crew", "Crime Alley"] and got.get("Space Garden", []) == []


def test_error_expectation_is_substring(spark, eval_catalog):
    from marquee.operators.evaluate import case_results, normalize_cases

    titles, terms = build_index(eval_catalog)
    cases = normalize_cases(spark.createDataFrame(
        [("e1", "Nope", 3, None, None, "not in the dataset", None, None),
         ("e2", "Neon Heist", 3, None, None, "", None, None)],
        "id string, query string, top_n int, expected_good array<string>, expected_bad array<string>, "
        "expected_error string, failure_mode string, notes string"))
    got = {r["id"]: r["passed"] for r in case_results(cases, titles, terms).collect()}
    assert got == {"e1": True, "e2": True}
