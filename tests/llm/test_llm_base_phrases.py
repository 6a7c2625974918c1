"""Base phrases of the license scan, against a plain search over the words."""

import re

from marquee.llm import queries as q

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEXTS = [
    "the MIT License", "The MIT License (MIT)", "Released Under the\nMIT-License", "under the mit license under the mit license",
    "under the the mit license", "Apache License, Version 2.0; CC BY-NC 4.0", "thunder the mit license", "under the mit licenses", None, "",
]


def by_hand(text):
    ascii_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ascii_lower))
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in hits}))


def test_base_phrases_are_those_of_the_contract(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in q.op1_licenses(spark, str(tmp_path)).collect()}
    for i, text in enumerate(TEXTS):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == by_hand(text), text
