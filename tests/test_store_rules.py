"""Ids, file order and refusals of the recommendation store; scratch rules."""

import gzip

import pytest

from conftest import errors_by_query, recs_by_query
from marquee.operators import features as fe
from marquee.operators.index import build_index, prepare_catalog, violations
from marquee.operators.recommend import recommend
from marquee.plans.jobs import build_store_if_stale
from marquee.plans.store import build_store
from marquee.sources.curated_io import read_curated_csv
from marquee.sources.raw import load_sources

SCHEMA = "tconst string, title string, director string, genres array<string>, score string, actors array<string>"


def _row(tconst, title, score="8.0", genres=("Drama",)):
    return (tconst, title, "Dir", list(genres), score, ["P"])


def test_empty_ids_get_row_ids(spark):
    cat = spark.createDataFrame([_row("t1", "A"), _row(None, "B"), _row("", "C"), _row("t2", "D")], SCHEMA).coalesce(1)
    titles, terms = build_index(cat)
    assert [r["tconst"] for r in titles.orderBy("title").collect()] == ["t1", "row:2", "row:3", "t2"]
    out = recommend(titles, terms, spark.createDataFrame([("B",)], "title string"), top_n=3)
    assert not errors_by_query(out) and sorted(recs_by_query(out)["B"]) == ["A", "C", "D"]


def test_row_numbers_follow_files_not_split_sizes(spark, tmp_path):
    head = "title,director,genres,score,actors\n"
    line = lambda name: f"{name},Dir,\"['Drama']\",8.0,\"['P']\"\n"
    (tmp_path / "a.csv").write_text(head + line("x1") + line("x2"))
    (tmp_path / "b.csv").write_text(head + "".join(line(f"y{i}") for i in range(50)))
    got = {r["raw_title"]: r["tconst"] for r in prepare_catalog(read_curated_csv(spark, str(tmp_path))).collect()}
    assert got["x1"] == "row:1" and got["x2"] == "row:2" and got["y0"] == "row:3" and got["y49"] == "row:52"


@pytest.mark.parametrize(
    "rows, kind",
    [
        ([_row("t1", "A"), _row("t1", "B")], "duplicate_id"),
        ([_row("t1", "A"), _row(None, "A")], "duplicate_title_without_id"),
        ([_row("t1", "A", "n/a"), _row("t2", "B")], "bad_score"),
        ([_row("t1", None), _row("t2", "B")], "null_title"),
    ],
)
def test_store_refuses_bad_catalogues(spark, tmp_path, rows, kind):
    cat = spark.createDataFrame(rows, SCHEMA)
    assert kind in {r["kind"] for r in violations(cat).collect()}
    with pytest.raises(ValueError, match=kind):
        build_store(cat, str(tmp_path / "store"))
    with pytest.raises(ValueError, match=kind):
        build_index(cat)


def test_refused_build_keeps_the_earlier_store(spark, tmp_path):
    head = "tconst,title,director,genres,score,actors\n"
    good = head + "t1,A,Dir,\"['Drama']\",8.0,\"['P']\"\n"
    (tmp_path / "c.csv").write_text(good)
    store = str(tmp_path / "store")
    build_store_if_stale(spark, str(tmp_path / "c.csv"), store)
    (tmp_path / "c.csv").write_text(good + "t1,B,Dir,\"['Drama']\",8.0,\"['P']\"\n")
    with pytest.raises(ValueError, match="duplicate_id"):
        build_store_if_stale(spark, str(tmp_path / "c.csv"), store)
    (tmp_path / "c.csv").write_text(good)
    titles, _, _ = build_store_if_stale(spark, str(tmp_path / "c.csv"), store)
    assert [r["title"] for r in titles.collect()] == ["A"]


def test_unreadable_store_is_not_taken_for_none(spark, tmp_path):
    (tmp_path / "c.csv").write_text("tconst,title,director,genres,score,actors\nt1,A,Dir,\"['Drama']\",8.0,\"['P']\"\n")
    snapshots = tmp_path / "store" / "source_snapshots"
    snapshots.mkdir(parents=True)
    (snapshots / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer|CANNOT_READ"):
        build_store_if_stale(spark, str(tmp_path / "c.csv"), str(tmp_path / "store"))


def test_gzip_sources_are_found_and_dealt_out(spark, tmp_path):
    tables = {
        "title.basics.tsv": "tconst\ttitleType\tprimaryTitle\tgenres\ntt1\tmovie\tA\tDrama\n",
        "title.crew.tsv": "tconst\tdirectors\ntt1\tnm1\n",
        "title.ratings.tsv": "tconst\taverageRating\tnumVotes\ntt1\t8.0\t10\n",
        "title.principals.tsv": "tconst\tordering\tnconst\tcategory\ntt1\t1\tnm1\tactor\n",
        "name.basics.tsv": "nconst\tprimaryName\nnm1\tP\n",
    }
    for name, text in tables.items():
        with gzip.open(tmp_path / (name + ".gz"), "wt") as f:
            f.write(text)
    src = load_sources(spark, "file:" + str(tmp_path))
    assert src["titles"].collect()[0]["primaryTitle"] == "A"
    assert src["ratings"].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_text_that_returns_is_active_again(spark):
    def soup(actor):
        cur = spark.createDataFrame(
            [("tt1", "A", "A", ["Drama"], ["Dir"], [actor])],
            "tconst string, title string, primary_title string, genres array<string>, director_names array<string>, actors array<string>",
        )
        return fe.recommendation_soup(cur)

    v = fe.add_feature_run(fe.add_feature_run(fe.add_feature_run(None, soup("x"), 1), soup("y"), 2), soup("x"), 3)
    assert {(r["source_text"][-1], r["active"]) for r in v.collect()} == {("x", True), ("y", False)}


def test_credits_backfill_says_actor_and_crew_gives_writers(spark):
    cur = spark.createDataFrame(
        [("tt1", ["nm1"], ["D"], ["nm2"], ["P"])],
        "tconst string, director_ids array<string>, director_names array<string>, cast_ids array<string>, actors array<string>",
    )
    assert {r["role_type"] for r in fe.credits_from_lists(cur).collect()} == {"director", "actor"}
    crew = spark.createDataFrame([("tt1", "nm1", "nm2,nm3")], "tconst string, directors string, writers string")
    pr = spark.createDataFrame([("tt1", 1, "nm2", "writer", "novel")], "tconst string, ordering long, nconst string, category string, job string")
    got = sorted((r["nconst"], r["role_type"], r["source"]) for r in fe.credits(crew, pr).collect())
    assert got == [("nm1", "director", "crew"), ("nm2", "writer", "crew"), ("nm3", "writer", "crew")]


def test_scratch_needs_a_shared_folder_off_local_masters():
    from marquee.session import checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app-x"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
