"""Run log with counts gathered while the job writes."""

import json

import pytest
from pyspark.sql import functions as F

from marquee.plans import runs as r


@pytest.fixture
def sources(spark):
    a = spark.range(100).withColumn("k", F.col("id") % 10)
    b = spark.range(7).withColumnRenamed("id", "k")
    return {"title_basics": r.Source(a, 11), "title_ratings": r.Source(b, 12)}


def rows(df):
    return [x.asDict() for x in df.collect()]


def test_counts_come_from_the_job(spark, tmp_path, sources):
    run = r.run_job(5, "imdb_load", sources, lambda s: s["title_basics"].join(s["title_ratings"], "k").where("id >= 50"), str(tmp_path / "o"), "v1", "curate", {"q": 0.9})
    log = rows(run.runs)[0]
    assert (log["etl_run_id"], log["run_type"], log["status"], log["code_version"], log["loader_name"]) == (5, "imdb_load", "succeeded", "v1", "curate")
    assert (log["records_read"], log["records_written"], log["error_message"]) == (107, 35, None) and json.loads(log["parameters"]) == {"q": 0.9}
    assert log["started_at"] <= log["finished_at"] and run.output.count() == 35
    assert sorted((x["role"], x["source_snapshot_id"], x["records_read"]) for x in rows(run.sources)) == [("title_basics", 11, 100), ("title_ratings", 12, 7)]


def test_unused_source_and_aggregates(spark, tmp_path, sources):
    run = r.run_job(6, "text_feature_build", sources, lambda s: s["title_basics"].groupBy("k").count(), str(tmp_path / "o"))
    assert {x["role"]: x["records_read"] for x in rows(run.sources)} == {"title_basics": 100, "title_ratings": None}
    assert (rows(run.runs)[0]["records_read"], rows(run.runs)[0]["records_written"]) == (100, 10)


def test_empty_sources(spark, tmp_path, sources):
    none = {role: r.Source(s.rows.limit(0), s.snapshot_id) for role, s in sources.items()}
    run = r.run_job(7, "csv_backfill", none, lambda s: s["title_basics"], str(tmp_path / "o"))
    assert run.status == r.SUCCEEDED and rows(run.runs)[0]["records_written"] == 0 and run.output.count() == 0


def test_failed_runs_are_logged(spark, tmp_path, sources):
    path = str(tmp_path / "o")
    broken = r.run_job(8, "imdb_load", sources, lambda s: s["title_basics"].withColumn("x", F.raise_error(F.lit("bad row"))), path)
    log = rows(broken.runs)[0]
    assert log["status"] == "failed" and "bad row" in log["error_message"] and log["records_written"] is None and broken.output is None
    refused = r.run_job(9, "imdb_load", sources, lambda s: s["title_basics"], path, check=lambda out: out.where("k = 3"))
    assert refused.status == r.FAILED and "break a rule" in rows(refused.runs)[0]["error_message"]
    good = r.run_job(10, "imdb_load", sources, lambda s: s["title_basics"], path, check=lambda out: out.where("k = 30"))
    assert good.status == r.SUCCEEDED
    with pytest.raises(ValueError, match="run_type"):
        r.run_job(11, "other", sources, lambda s: s["title_basics"], path)
