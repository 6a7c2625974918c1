"""Curation goldens and traps (weighted score, lists, thresholds, titles)."""

import pytest
from pyspark.sql import functions as F

from marquee.functions.scalars import weighted_score
from marquee.operators import curate as cu

T_SCHEMA = "tconst string, titleType string, primaryTitle string, genres string"
C_SCHEMA = "tconst string, directors string"
R_SCHEMA = "tconst string, averageRating double, numVotes long"
N_SCHEMA = "nconst string, primaryName string"
P_SCHEMA = "tconst string, ordering long, nconst string, category string"


def frames(spark, titles, crew, ratings, names, principals):
    return (
        spark.createDataFrame(titles, T_SCHEMA),
        spark.createDataFrame(crew, C_SCHEMA),
        spark.createDataFrame(ratings, R_SCHEMA),
        spark.createDataFrame(names, N_SCHEMA),
        spark.createDataFrame(principals, P_SCHEMA),
    )


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_weighted_score_golden(spark):
    v = spark.range(1).select(weighted_score(F.lit(100), F.lit(8.0), 7.0, 50).alias("s")).first()["s"]
    assert round(v, 4) == 7.6667


def test_zero_denominator_gives_null(spark):
    v = spark.range(1).select(weighted_score(F.lit(0), F.lit(8.0), 7.0, 0).alias("s")).first()["s"]
    assert v is None


def test_duplicate_titles_are_suffixed(spark):
    f = frames(
        spark,
        [("tt001", "movie", "Same Title", "Drama"), ("tt002", "movie", "Same Title", "Comedy")],
        [("tt001", "nm001"), ("tt002", "nm002")],
        [("tt001", 7.0, 10), ("tt002", 8.0, 20)],
        [("nm001", "Director One"), ("nm002", "Director Two"), ("nm101", "Actor One"), ("nm102", "Actor Two")],
        [("tt001", 1, "nm101", "actor"), ("tt002", 1, "nm102", "actor")],
    )
    out = rows(cu.curate(*f, vote_quantile=None, min_votes=0))
    assert {r["title"] for r in out} == {"Same Title (tt001)", "Same Title (tt002)"}
    assert {r["primary_title"] for r in out} == {"Same Title"}
    assert list(out[0].keys()) == cu.CURATED_COLUMNS


def test_lists_keep_order_and_limits(spark):
    f = frames(
        spark,
        [("tt001", "movie", "Movie", "Action,Drama")],
        [("tt001", "nm001,nm002,nm003,nm004")],
        [("tt001", 8.0, 2000)],
        [
            ("nm001", "Director One"),
            ("nm002", "Director Two"),
            ("nm003", "Director Three"),
            ("nm004", "Director Four"),
            ("nm101", "Actor One"),
            ("nm102", "Actress One"),
            ("nm103", "Writer One"),
        ],
        [("tt001", 2, "nm101", "actor"), ("tt001", 1, "nm102", "actress"), ("tt001", 3, "nm103", "writer")],
    )
    (r,) = rows(cu.curate(*f, vote_quantile=None, min_votes=1000))
    assert r["director_ids"] == ["nm001", "nm002", "nm003"]
    assert r["director_names"] == ["Director One", "Director Two", "Director Three"]
    assert r["director"] == "Director One"
    assert r["cast_ids"] == ["nm102", "nm101"]
    assert r["actors"] == ["Actress One", "Actor One"]
    assert r["genres"] == ["Action", "Drama"]


def test_vote_threshold_and_score(spark):
    f = frames(
        spark,
        [("tt001", "movie", "Low", "Drama"), ("tt002", "movie", "High", "Drama")],
        [("tt001", "nm001"), ("tt002", "nm002")],
        [("tt001", 7.0, 999), ("tt002", 8.0, 1000)],
        [("nm001", "D1"), ("nm002", "D2")],
        [("tt001", 1, "nm001", "director"), ("tt002", 1, "nm002", "director")],
    )
    out = rows(cu.curate(*f, vote_quantile=None, min_votes=1000))
    assert [r["tconst"] for r in out] == ["tt002"]
    assert out[0]["score"] == pytest.approx(7.75)
    assert out[0]["actors"] == [] and out[0]["cast_ids"] == []


def sample_sources(spark):
    return frames(
        spark,
        [
            ("tt0000001", "movie", "Sample Movie", "Drama"),
            ("tt0000002", "movie", "Sample Sequel", "Comedy,Drama"),
            ("tt0000003", "short", "Sample Short", "Documentary"),
        ],
        [("tt0000001", "nm0000001"), ("tt0000002", "nm0000002"), ("tt0000003", "nm0000003")],
        [("tt0000001", 8.0, 1500), ("tt0000002", 7.5, 1200), ("tt0000003", 6.0, 10)],
        [
            ("nm0000001", "Sample Director"),
            ("nm0000002", "Second Director"),
            ("nm0000101", "Sample Actor"),
            ("nm0000102", "Sample Actress"),
            ("nm0000103", "Sequel Actor"),
        ],
        [
            ("tt0000001", 1, "nm0000101", "actor"),
            ("tt0000001", 2, "nm0000102", "actress"),
            ("tt0000002", 1, "nm0000103", "actor"),
            ("tt0000003", 1, "nm0000104", "actor"),
        ],
    )


def test_sample_sources_no_threshold(spark):
    out = rows(cu.curate(*sample_sources(spark), vote_quantile=0.0, min_votes=0))
    assert [r["tconst"] for r in out] == ["tt0000001", "tt0000002"]
    assert [round(r["score"], 6) for r in out] == [7.888889, 7.625]
    st = cu.vote_stats(cu.joined_movies(*[sample_sources(spark)[i] for i in (0, 2, 1)]), 0.0, 0).first()
    assert st["mean_rating"] == pytest.approx(7.75) and st["threshold"] == 1200


def test_missing_names_stay_null_in_lists(spark):
    f = frames(
        spark,
        [("tt001", "movie", "M", "Drama")],
        [("tt001", "nm001,nm404")],
        [("tt001", 8.0, 10)],
        [("nm001", "D1"), ("nm101", "A1")],
        [("tt001", 1, "nm101", "actor"), ("tt001", 2, "nm999", "actress")],
    )
    (r,) = rows(cu.curate(*f, vote_quantile=None, min_votes=0))
    assert r["director_names"] == ["D1", None]
    assert r["actors"] == ["A1", None]


def test_null_first_director_name_stays_null(spark):
    f = frames(
        spark,
        [("tt001", "movie", "M", "Drama")],
        [("tt001", "nm404,nm001")],
        [("tt001", 8.0, 10)],
        [("nm001", "D1")],
        [],
    )
    (r,) = rows(cu.curate(*f, vote_quantile=None, min_votes=0))
    assert r["director"] is None and r["director_names"] == [None, "D1"]


def test_missing_crew_row_dropped_and_marker_kept_empty(spark):
    f = frames(
        spark,
        [("tt001", "movie", "A", "\\N"), ("tt002", "movie", "B", "Drama")],
        [("tt001", "\\N")],
        [("tt001", 8.0, 10), ("tt002", 8.0, 10)],
        [],
        [],
    )
    out = rows(cu.curate(*f, vote_quantile=None, min_votes=0))
    assert [r["tconst"] for r in out] == ["tt001"]
    assert out[0]["director_ids"] == [] and out[0]["director"] == "" and out[0]["genres"] == []


def test_stats_before_vote_filter_and_duplicates_among_survivors(spark):
    f = frames(
        spark,
        [("t1", "movie", "Same", "D"), ("t2", "movie", "Same", "D"), ("t3", "movie", "Other", "D")],
        [("t1", "n1"), ("t2", "n2"), ("t3", "n3")],
        [("t1", 6.0, 5), ("t2", 8.0, 100), ("t3", 7.0, 100)],
        [],
        [],
    )
    out = rows(cu.curate(*f, vote_quantile=None, min_votes=50))
    # C includes the filtered-out t1: (6+8+7)/3 = 7
    by_id = {r["tconst"]: r for r in out}
    assert set(by_id) == {"t2", "t3"}
    assert by_id["t2"]["title"] == "Same"  # duplicate counted among survivors only
    assert by_id["t2"]["score"] == pytest.approx(100 / 150 * 8 + 50 / 150 * 7)


def test_cast_ties_broken_by_id_and_limit(spark):
    principals = [("t1", 1, f"nm{i}", "actor") for i in (5, 3, 9, 1, 7, 2)]
    f = frames(spark, [("t1", "movie", "M", "D")], [("t1", "n1")], [("t1", 8.0, 10)], [], principals)
    (r,) = rows(cu.curate(*f, vote_quantile=None, min_votes=0))
    assert r["cast_ids"] == ["nm1", "nm2", "nm3", "nm5", "nm7"]


def test_source_key_violations(spark):
    f = frames(
        spark,
        [("t1", "movie", "A", "D")],
        [("t1", "n1"), ("t1", "n2")],
        [("t1", 8.0, 10)],
        [("n1", "X"), ("n1", "Y")],
        [("t1", 1, "n9", "actor"), ("t1", 1, "n9", "actor")],
    )
    src = dict(zip(["titles", "crew", "ratings", "names", "principals"], f))
    got = sorted((r["source"], r["key"], r["rows"]) for r in cu.source_key_violations(src).collect())
    assert got == [("crew", "t1", 2), ("names", "n1", 2), ("principals", "t1|1|n9", 2)]


def test_cast_without_ordering_column_uses_person_id(spark):
    f = frames(spark, [("t1", "movie", "M", "D")], [("t1", "n1")], [("t1", 8.0, 10)], [], [])
    pr = spark.createDataFrame([("t1", "nm7", "actor"), ("t1", "nm2", "actress"), ("t1", "nm5", "writer")],
                               "tconst string, nconst string, category string")
    (r,) = rows(cu.curate(f[0], f[1], f[2], f[3], pr, vote_quantile=None, min_votes=0))
    assert r["cast_ids"] == ["nm2", "nm7"]
