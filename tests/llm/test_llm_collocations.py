"""Collocations against a count of every phrase by hand and against SQL."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from llm_tables import DOCS, by_duckdb, by_spark, edge_dir  # noqa: F401 - a fixture
from marquee.llm import collocations as c
from marquee.llm import queries as q


def pieces_of(text):
    text = (text or "").translate({i: i + 32 for i in range(65, 91)})
    for mark in ".,;:!?\n\x0b\x0c\r":
        text = text.replace(mark, "\n")
    return [[w for w in piece.replace("\t", " ").split(" ") if w] for piece in text.split("\n")]


def by_hand(docs, max_words, min_count, top, absorbed=100):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for words in pieces_of(text):
            n[lang] += len(words)
            for size in range(1, max_words + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    frequent = {k: v for k, v in f.items() if v >= min_count}
    out = []
    for (lang, phrase), a in frequent.items():
        if len(phrase) < 2:
            continue
        inside = lambda longer: any(longer[i : i + len(phrase)] == phrase for i in range(len(longer) - len(phrase) + 1))
        if any(g == lang and len(p) > len(phrase) and inside(p) and 100 * b >= absorbed * a for (g, p), b in frequent.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, phrase[:k]] * f[lang, phrase[k:]]), k) for k in range(1, len(phrase))]
        score, k = min(cuts)
        out.append((lang, " ".join(phrase), a, f[lang, phrase[:k]], f[lang, phrase[k:]], n[lang], score))
    rows = []
    for lang in {r[0] for r in out}:
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        rows += [(r[0], i + 1, *r[1:]) for i, r in enumerate(best)]
    return sorted(rows)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def random_docs(seed, n):
    rnd = random.Random(seed)
    marks = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " \x0b", " ", "!"]
    shared = " ".join(rnd.choices(["alpha", "Beta", "gamma", "x", "é"], k=40))
    docs = []
    for _ in range(n):
        text = "".join(rnd.choice(["alpha", "Beta", "gamma", "x", "É", "é", "spam", "zz"]) + rnd.choice(marks) for _ in range(rnd.randint(0, 80)))
        if rnd.random() < 0.3:
            text += shared
        docs.append((rnd.choice(["en", "fr", None, "und", "a.b"]), rnd.choice([text, text, text, None, ""])))
    return docs + [("en", "spam " * 500), ("en", "q"), ("fr", " , ,"), (None, "one two three four five " * 30)]


@pytest.mark.parametrize("max_words,min_count,bits", [(5, 20, None), (5, 5, 12), (3, 2, 11), (2, 3, None), (4, 30, 11)])
def test_equals_hand_count(spark, max_words, min_count, bits):
    docs = random_docs(max_words * min_count, 150)
    table = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    found = c.collocations(table, max_words=max_words, min_count=min_count, top=40, sieve_bits=bits)
    want = by_hand(docs, max_words, min_count, 40)
    assert want and rows_of(found) == want


def test_phrases_that_a_longer_one_holds(spark):
    docs = [("en", "one two three four")] * 6 + [("en", "two three")] * 4 + [("en", "three four")]
    found = c.collocations(spark.createDataFrame(docs, "lang string, text string"), min_count=3)
    assert rows_of(found) == by_hand(docs, 5, 3, 2000)
    assert {r[2] for r in rows_of(found)} == {"one two three four", "two three", "three four"}
    looser = c.collocations(spark.createDataFrame(docs, "lang string, text string"), min_count=3, absorbed=60)
    assert rows_of(looser) == by_hand(docs, 5, 3, 2000, 60) and {r[2] for r in rows_of(looser)} == {"one two three four"}


def test_large_products_stay_exact(spark):
    docs = [("en", "rare pair")] * 3 + [("en", "filler " * 20)]
    counts = spark.createDataFrame(docs, "lang string, text string")
    # as if every chunk stood 2**33 times in the corpus: 1000 a n has 80 bits
    many = c.chunk_dictionary(counts, 4).selectExpr("lang", "chunk", "weight * 8589934592 as weight")
    keep, c.chunk_dictionary = c.chunk_dictionary, lambda *_: many
    try:
        found = {r["phrase"]: r for r in c.collocations(counts, min_count=100).collect()}
    finally:
        c.chunk_dictionary = keep
    a, n = 3 << 33, 26 << 33
    assert (found["rare pair"]["a"], found["rare pair"]["n"], found["rare pair"]["score"]) == (a, n, 1000 * a * n // (a * a))


def test_chunks_hold_every_place_once():
    """Chunks overlap by one window; their own places make up the text."""
    docs = [(lang or "und", text) for lang, text in random_docs(1, 60)]
    table = c.parse(pa.array([d[1] for d in docs]), pa.array([d[0] for d in docs]), 4)
    weights = Counter()
    for lang, chunk, weight in zip(*(table[n].to_pylist() for n in ("lang", "chunk", "count_all"))):
        symbols = chunk.split(" ")
        for i in range(len(symbols) - 4):
            weights[lang, tuple(symbols[i : i + 5])] += weight
    want = Counter()
    for lang, text in docs:
        symbols = []
        for words in pieces_of(text):
            symbols += (["\n"] if symbols and words and symbols[-1] != "\n" else []) + words
        symbols += ["\n"] * 4 if symbols else []
        for i in range(len(symbols) - 4):
            want[lang, tuple(symbols[i : i + 5])] += 1
    assert weights == want
    again = c.parse(pa.array([d[1] for d in docs] * 2), pa.array([d[0] for d in docs] * 2), 4)
    assert again.num_rows == table.num_rows  # copies are cut alike


def test_query_equals_its_sql(spark, edge_dir):
    sql = q.oracle_sql()["op12_collocations"]
    for folder in (edge_dir, "/root/testdata/sf0.001"):
        tables = by_spark(q.op12_collocations(spark, folder))
        assert tables == by_duckdb(folder, sql)
    assert len(DOCS) and tables[1]


def test_awkward_tables(spark):
    docs = spark.createDataFrame([("x", None, "t", {"a": 1}), ("x", "en", None, None)], "`phrase.f` string, lang string, text string, weight map<string,int>")
    assert c.collocations(docs, min_count=1).collect() == [] and c.collocations(docs.limit(0)).collect() == []
