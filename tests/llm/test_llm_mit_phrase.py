"""Base phrase of mit: every place of "the mit license", whatever stands before it."""

from marquee.llm import queries as q

TEXTS = {  # n_base, first_word, last_word, base_labels
    "the MIT License": (1, 0, 0, "mit"),
    "Released Under the\nMIT-License": (1, 2, 2, "mit"),
    "see the MIT License; under the mit license, or (the mit license)": (3, 1, 9, "mit"),
    "thunder the mit license CC BY-NC": (2, 1, 4, "cc-by-nc,mit"),
    "the the mit license": (1, 1, 1, "mit"),
    "the mit licenses, bathe mit license": (0, None, None, ""),
}


def test_every_place_of_the_mit_license_counts(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in q.op1_licenses(spark, str(tmp_path)).collect()}
    for i, (text, want) in enumerate(TEXTS.items()):
        assert (rows[i]["n_base"], rows[i]["first_word"], rows[i]["last_word"], rows[i]["base_labels"]) == want, text
    assert "' the  mit  license '" in q.oracle_sql()["op1_licenses"]
