"""Store reuse/rebuild by source fingerprint, id bridges, report text."""

import time

from conftest import recs_by_query
from marquee.operators import lineage as ln
from marquee.operators.recommend import recommend
from marquee.plans.jobs import build_store_if_stale
from marquee.sources.inventory import fingerprint, staleness

HEADER = "title,director,genres,score,actors\n"


def _csv(path, rows):
    path.write_text(HEADER + "".join(rows))


def test_store_rebuilds_on_new_source_identity(spark, tmp_path):
    a = tmp_path / "a.csv"
    b = tmp_path / "b.csv"
    _csv(a, ["Movie A,Dir A,\"['Drama']\",9.0,\"['X']\"\n", "Movie B,Dir B,\"['Drama']\",8.0,\"['Y']\"\n"])
    _csv(b, ["Movie C,Dir C,\"['Comedy']\",7.0,\"['Z']\"\n", "Movie D,Dir D,\"['Comedy']\",6.0,\"['W']\"\n"])
    store = str(tmp_path / "store")
    titles, terms, rebuilt = build_store_if_stale(spark, str(a), store)
    assert rebuilt and titles.count() == 2
    _, _, rebuilt = build_store_if_stale(spark, str(a), store)
    assert not rebuilt
    titles, terms, rebuilt = build_store_if_stale(spark, str(b), store)
    assert rebuilt
    req = spark.createDataFrame([("Movie C",)], "title string")
    assert recs_by_query(recommend(titles, terms, req, top_n=1))["Movie C"] == ["Movie D"]
    # the stored fingerprint now belongs to b, so a is stale again
    st = staleness(fingerprint(spark, str(a)), spark.read.parquet(store + "/source_snapshots"))
    assert all(r["stale"] for r in st.collect())


def test_store_rebuilds_after_content_change(spark, tmp_path):
    a = tmp_path / "a.csv"
    _csv(a, ["Movie A,Dir A,\"['Drama']\",9.0,\"['X']\"\n"])
    store = str(tmp_path / "store")
    build_store_if_stale(spark, str(a), store)
    time.sleep(0.01)
    _csv(a, ["Movie A,Dir A,\"['Drama']\",9.0,\"['X']\"\n", "Movie B,Dir B,\"['Drama']\",8.0,\"['Y']\"\n"])
    titles, _, rebuilt = build_store_if_stale(spark, str(a), store)
    assert rebuilt and titles.count() == 2


def test_external_id_bridge_uniqueness(spark):
    bridge = spark.createDataFrame(
        [("tmdb", "1", "tt1"), ("tmdb", "1", "tt2"), ("tmdb", "2", "tt3"), ("tmdb", "3", "tt3")],
        "source_name string, source_id string, tconst string",
    )
    probs = sorted((r["problem"], r["value"]) for r in ln.external_id_violations(bridge).collect())
    assert probs == [("source_id_maps_to_many", "1"), ("tconst_has_many_ids", "tt3")]
    rows = spark.createDataFrame([("tmdb", "2"), ("tmdb", "9")], "source_name string, source_id string")
    got = {r["source_id"]: (r["tconst"], r["resolved"]) for r in ln.resolve_external_ids(rows, bridge).collect()}
    assert got == {"2": ("tt3", True), "9": (None, False)}


def test_report_lines_text(spark, eval_catalog):
    from marquee.operators.evaluate import case_results, normalize_cases, report_lines
    from marquee.operators.index import build_index

    cases = normalize_cases(
        spark.createDataFrame(
            [("c1", "Neon Heist", 2, ["Midnight Crew"], ["Romantic Kitchen"], None, "fm", ""),
             ("c2", "Nope", 2, [], [], "This movie is not in the dataset.", "", "n")],
            "id string, query string, top_n int, expected_good array<string>, expected_bad array<string>, "
            "expected_error string, failure_mode string, notes string",
        )
    )
    titles, terms = build_index(eval_catalog)
    text = {r["id"]: r["text"] for r in report_lines(case_results(cases, titles, terms)).collect()}
    assert text["c1"].splitlines() == [
        "[PASS] c1: Neon Heist",
        "  top 2: Midnight Crew, Crime Alley",
        "  missing expected good: (none)",
        "  present expected bad: (none)",
        "  failure mode: fm",
    ]
    assert text["c2"].splitlines()[:2] == ["[PASS] c2: Nope", "  error: This movie is not in the dataset."]


def test_size_cap_fails_closed_and_message(spark, tmp_path):
    import pytest

    from marquee.plans.jobs import retained_message
    from marquee.sources.inventory import check_size_cap, source_inventory

    (tmp_path / "title.basics.tsv.gz").write_bytes(b"x" * 100)
    inv = source_inventory(spark, str(tmp_path))
    acts = {r["file_name"]: r["action"] for r in inv.collect()}
    assert acts["title.basics.tsv.gz"] == "skip" and acts["name.basics.tsv.gz"] == "download"
    check_size_cap(inv, 1000)
    with pytest.raises(ValueError, match="exceed 50 bytes"):
        check_size_cap(inv, 50)
    assert retained_message(0.9, 1000) == "curate: keeping the top 10% of movies by vote count (minimum votes: 1000)"
    assert retained_message(None, 5) == "curate: keeping all movies (minimum votes: 5)"
