"""Periodic runs against a brute force over all periods."""

import random
import time
import zlib

import pyarrow as pa

from llm_tables import DOCS, edge_dir, sha  # noqa: F401 - a fixture
from marquee.llm import periodic, queries as q

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def words_of(text):
    for c in SPACE:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def runs_by_hand(words, min_length):
    """For every period the longest stretches that have it; a stretch counts
    once, with its smallest period."""
    found, seen = [], set()
    for period in range(1, len(words) // 2 + 1):
        i = 0
        while i + period < len(words):
            start = i
            while i + period < len(words) and words[i] == words[i + period]:
                i += 1
            length = i - start + period
            if i > start and length >= max(min_length, 2 * period) and (start, length) not in seen:
                seen.add((start, length))
                found.append((start, length, period))
            i = max(i, start + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed_by_hand(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, words):
    if doc_id is None:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_runs_of_random_texts():
    rnd = random.Random(5)
    for _ in range(1500):
        texts = []
        for _ in range(rnd.randint(1, 4)):
            n, letters = rnd.randint(0, 60), "abcde"[: rnd.choice([1, 2, 2, 3, 5])]
            words = [rnd.choice(letters) for _ in range(n)]
            if n and rnd.random() < 0.6:
                a = rnd.randrange(n)
                p = 1 + rnd.randrange(max(1, (n - a) // 2))
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(words)
        least = rnd.choice([12, 12, 2, 3, 5, 7])
        runs, collapsed, counts = periodic._with_runs(pa.array([" ".join(w) for w in texts]), least)
        for words, found, left, n in zip(texts, runs.to_pylist(), collapsed.to_pylist(), counts.to_pylist()):
            want = runs_by_hand(words, least)
            assert [(r["start"], r["length"], r["period"]) for r in found] == want and n == len(words)
            assert left == collapsed_by_hand(words, want)


def test_query_equals_brute_force(spark, edge_dir):
    check_query(q.op13_runs(spark, edge_dir).collect(), [(d[0], d[1]) for d in DOCS if len(d[1] or "") < 5000])


def test_query_on_given_documents(spark):
    path = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    check_query(q.op13_runs(spark, path).collect(), [d for d in docs if len(d[1] or "") < 8000])


def check_query(rows, docs):
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], set()).add(tuple(r))
    for doc_id, text in docs:
        words = planted(doc_id, words_of(text))
        runs = runs_by_hand(words, 12)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        start, length, period = best or (None,) * 3
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        milli = 1000 * length // period if best else None
        assert (doc_id, len(runs), start, length, period, milli, sha(listed), sha(collapsed_by_hand(words, runs))) in found[doc_id]


def test_any_row_shape(spark):
    rows = [(1, "x " * 30, "clash", {"k": 1}), (1, "x " * 30, "clash", {"k": 1}), (None, None, None, None), (2, "", "", {})]
    docs = spark.createDataFrame(rows, "`a.b` int, text string, periodic string, m map<string,int>")
    out = periodic.find_runs(docs)
    assert out.columns == ["a.b", "periodic", "m", "periodic_"]
    got = sorted(((r["a.b"], r["m"], [tuple(x) for x in r["periodic_"]["runs"]], r["periodic_"]["collapsed"]) for r in out.collect()), key=repr)
    assert got == sorted([(1, {"k": 1}, [(0, 30, 1)], "x"), (1, {"k": 1}, [(0, 30, 1)], "x"), (None, None, [], ""), (2, {}, [], "")], key=repr)
    assert periodic.find_runs(docs.limit(0)).collect() == []


def test_time_grows_with_the_words_alone():
    shapes = {
        "one word": lambda n: ["a"] * n,
        "period 7": lambda n: [str(i % 7) for i in range(n)],
        "a line again and again": lambda n: (" ".join(f"x{i} the quick brown fox jumps over" for i in range(n // 7))).split(),
        "two words": lambda n: random.Random(n).choices("ab", k=n),
    }
    for name, shape in shapes.items():
        seconds = []
        for n in (50_000, 200_000):
            text = pa.array([" ".join(shape(n))])
            begin = time.perf_counter()
            periodic._with_runs(text, 12)
            seconds.append(time.perf_counter() - begin)
        assert seconds[1] < 12 * seconds[0] + 1, (name, seconds)
