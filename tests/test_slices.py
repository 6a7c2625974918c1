"""Embedding constraints, the configured slice, overlap re-ranking, merges of
full snapshots: against rows worked out by hand and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from marquee.operators import lineage as ln
from marquee.operators import slices as sl

FEATURE = "text_feature_id long, tconst string, feature_name string, feature_version string, source_text_sha256 string, active boolean"
EMBEDDING = (
    "movie_embedding_id long, text_feature_id long, tconst string, feature_name string, feature_version string, source_text_sha256 string, "
    "model_name string, model_version string, vector_dimension int, embedding array<double>, embedding_sha256 string, active boolean"
)
FEATURES = [
    (1, "tt1", "soup", "v1", "h1", True), (2, "tt2", "soup", "v1", "h2", True), (3, "tt2", "soup", "v1", "old", False),
    (4, "tt1", "soup", "v2", "h4", True), (5, "tt3", "soup", "v1", "h5", True),
]
MOVIES = [("tt1", True), ("tt2", True), ("tt3", False)]


def tables(spark, embeddings):
    e = spark.createDataFrame(embeddings, EMBEDDING)
    return e, spark.createDataFrame(FEATURES, FEATURE), spark.createDataFrame(MOVIES, "tconst string, active boolean")


def emb(i, feature=1, tconst="tt1", name="soup", version="v1", text="h1", model="m", mv="1", dim=2, vector=(1.0, 0.5), digest=None, active=True):
    return (i, feature, tconst, name, version, text, model, mv, dim, None if vector is None else list(vector), digest, active)


def test_every_broken_constraint_is_reported(spark):
    nan, inf = float("nan"), float("inf")
    cases = {
        emb(1): [],
        emb(2, model="n", text="old"): ["outdated_text"],
        emb(3, feature=3, tconst="tt2", text="old"): ["inactive_text_feature"],
        emb(4, feature=3, tconst="tt2", text="old", model="n", active=False): [],
        emb(5, feature=99): ["no_text_feature"],
        emb(6, feature=None): ["no_text_feature"],
        emb(7, feature=2, tconst="tt9", text="h2"): ["no_movie", "other_movie"],
        emb(8, feature=5, tconst="tt3", text="h5"): ["inactive_movie"],
        emb(9, feature=4, version="v1", text="h4"): ["other_feature_version"],
        emb(10, feature=4, name="x", version=None, text=None, model="n"): ["other_feature_name", "other_feature_version", "outdated_text"],
        emb(11, model="o", dim=3): ["dimension"],
        emb(12, model="p", dim=None): ["dimension"],
        emb(13, model="q", vector=(1.0, nan)): ["bad_vector"],
        emb(14, model="r", vector=(None, 1.0)): ["bad_vector"],
        emb(15, model="s", vector=(inf, 1.0)): ["bad_vector"],
        emb(16, model="t", vector=None): ["bad_vector"],
        emb(17, model="u", vector=()): ["bad_vector", "dimension"],
        emb(18, model="v"): ["repeated_key"],
        emb(19, model="v"): ["repeated_key"],
        emb(20, model="w", digest="no such digest"): ["vector_digest"],
        emb(21, feature=2, tconst=None, text="h2", model="n"): ["no_movie", "other_movie"],
    }
    out = sl.embedding_problems(*tables(spark, [tuple(c) for c in _thawed(cases)]))
    found = {r["movie_embedding_id"]: list(r["problems"]) for r in out.collect()}
    assert found == {c[0]: p for c, p in zip(_thawed(cases), cases.values()) if p}
    assert out.columns == [*[c.split()[0] for c in EMBEDDING.split(", ")], "problems"]


def _thawed(cases):
    return [tuple(list(x) if isinstance(x, tuple) else x for x in c) for c in cases]


# rows are dict keys above, so vectors are frozen there
_emb = emb


def emb(i, **kw):  # noqa: F811
    row = _emb(i, **kw)
    return tuple(tuple(x) if isinstance(x, list) else x for x in row)


def test_digest_of_the_right_vector_passes(spark):
    e, f, m = tables(spark, _thawed([emb(1)]))
    e = e.withColumn("embedding_sha256", sl.embedding_digest(F.col("embedding")))
    assert sl.embedding_problems(e, f, m).count() == 0
    assert sl.embedding_problems(e.drop("embedding_sha256"), f, m).count() == 0
    assert sl.embedding_problems(e.limit(0), f.limit(0), m.limit(0)).count() == 0


def test_only_the_configured_slice_answers(spark):
    rows = [
        emb(1, vector=(1.0, 0.0)), emb(2, feature=4, version="v2", text="h4", vector=(2.0, 0.0)), emb(3, feature=2, tconst="tt2", text="h2", vector=(3.0, 0.0)),
        emb(4, feature=3, tconst="tt2", text="old", vector=(4.0, 0.0)), emb(5, feature=5, tconst="tt3", text="h5"), emb(6, model="n"), emb(7, mv="2"),
        emb(8, model="m", dim=3), emb(9, text="old"), emb(10, active=False),
    ]
    e, f, m = tables(spark, _thawed(rows))
    kinds = "feature_name string, feature_version string, model_name string, model_version string, vector_dimension int"
    config = lambda version: spark.createDataFrame([("soup", version, "m", "1", 2)], kinds)
    served = lambda cfg, feats=f: sorted((r["tconst"], r["text_feature_id"], r["embedding"][0]) for r in sl.serving_slice(e, feats, m, cfg).collect())
    assert served(config("v1")) == [("tt1", 1, 1.0), ("tt2", 2, 3.0)]
    assert served(config("v2")) == [("tt1", 4, 2.0)]
    assert served(config("v3")) == []
    # the feature's active row moves: its old embedding stops serving at once, and serves again after the return
    swapped = f.withColumn("active", F.when(F.col("tconst") == "tt2", ~F.col("active")).otherwise(F.col("active")))
    assert served(config("v1"), swapped) == [("tt1", 1, 1.0), ("tt2", 3, 4.0)]
    with pytest.raises(Exception, match="(?i)scalar|more than one row"):
        sl.serving_slice(e, f, m, config("v1").unionByName(config("v2"))).collect()


def test_overlap_counts_equal_brute_force(spark):
    rnd = random.Random(8)
    terms = [(f"i{rnd.randrange(40)}", rnd.choice("abcdefghij")) for _ in range(300)] + [("big", f"t{i}") for i in range(500)] + [(None, "a"), ("i1", None)]
    terms += [("i1", f"t{i}") for i in range(0, 500, 7)]
    pairs = [(f"i{rnd.randrange(45)}", f"i{rnd.randrange(45)}") for _ in range(400)] + [("big", f"i{i}") for i in range(40)] + [("i1", "big"), ("none", "big")]
    of = {}
    for i, t in terms:
        if i is not None and t is not None:
            of.setdefault(i, set()).add(t)
    want = {(q, c): len(of.get(q, set()) & of.get(c, set())) for q, c in pairs}
    found = sl.overlap_counts(spark.createDataFrame(pairs, "q string, c string"), spark.createDataFrame(terms, "id string, term string"))
    assert {(r["q"], r["c"]): r["overlap"] for r in found.collect()} == {p: n for p, n in want.items() if n}


def test_rerank_order(spark):
    rows = [
        ("q", "a", 0.1, 5.0, "t"), ("q", "b", 0.2, 5.0, "t"), ("q", "c", 0.2, 9.0, "t"), ("q", "d", 0.2, None, "t"), ("q", "e", 0.2, 5.0, "s"),
        ("q", "f", 0.2, 5.0, None), ("q", "g", 0.9, 1.0, "t"), ("r", "a", 0.5, None, None),
    ]
    cands = spark.createDataFrame(rows, "q string, c string, distance double, score double, title string")
    terms = spark.createDataFrame([("q", "x"), ("q", "y"), ("g", "x"), ("g", "y"), ("g", "z"), ("a", "y"), ("a", "y")], "id string, term string")
    out = sl.rerank_by_overlap(cands, terms, 7).orderBy("q", "rerank").collect()
    assert [(r["c"], r["overlap"]) for r in out if r["q"] == "q"] == [("g", 2), ("a", 1), ("c", 0), ("e", 0), ("b", 0), ("f", 0), ("d", 0)]
    assert [(r["c"], r["overlap"]) for r in out if r["q"] == "r"] == [("a", 0)]


def state(df):
    return {r["k"]: (r["v"], r["active"], r["first_seen"], r["last_seen"], r["changed_in"], r["inactive_since"], r["merged_load"]) for r in df.collect()}


def test_three_loads_one_of_them_late(spark):
    snap = lambda rows: spark.createDataFrame(rows, "k string, v string")
    one, two, three = snap([("a", "1"), ("b", "1"), ("c", None), (None, "n")]), snap([("a", "2"), ("late", "2")]), snap([("a", "1"), ("b", "3"), ("d", "3"), ("d", "4")])
    first = ln.merge_snapshot(None, one, ["k"], 10)
    assert state(first) == {"a": ("1", True, 10, 10, 10, None, 10), "b": ("1", True, 10, 10, 10, None, 10), "c": (None, True, 10, 10, 10, None, 10), None: ("n", True, 10, 10, 10, None, 10)}
    after = ln.merge_snapshot(first, three, ["k"], 30)
    want = {
        "a": ("1", True, 10, 30, 10, None, 30), "b": ("3", True, 10, 30, 30, None, 30), "d": ("3", True, 30, 30, 30, None, 30),
        "c": (None, False, 10, 10, 30, 30, 30), None: ("n", False, 10, 10, 30, 30, 30),
    }
    assert state(after) == want
    assert state(ln.merge_snapshot(after, two, ["k"], 20)) == want  # an older load that comes late
    assert state(ln.merge_snapshot(after, three, ["k"], 30)) == want  # the same load again
    back = state(ln.merge_snapshot(after, snap([("c", None)]), ["k"], 40))
    assert back["c"] == (None, True, 10, 40, 40, None, 40) and back["a"] == ("1", False, 10, 30, 40, 40, 40) and back[None][5] == 30
    none = state(ln.merge_snapshot(after, snap([]), ["k"], 50))
    assert len(none) == 5 and not any(r[1] for r in none.values()) and none["c"][5] == 30


def test_merges_equal_a_replay_in_load_order(spark):
    """Whatever the arrival order, the state is that of the loads that were
    newer than all before them."""
    rnd = random.Random(4)
    for _ in range(4):
        loads = {n: {f"k{rnd.randrange(6)}": str(rnd.randrange(3)) for _ in range(rnd.randrange(5))} for n in rnd.sample(range(1, 50), 4)}
        arrival = list(loads)
        now, expect, newest = None, {}, 0
        for n in arrival:
            df = spark.createDataFrame(list(loads[n].items()), "k string, v string")
            now = ln.merge_snapshot(now, df, ["k"], n) if now is not None or loads[n] else now
            if n > newest and (expect or loads[n]):
                newest = n
                for k in expect:
                    if k not in loads[n]:
                        expect[k] = (expect[k][0], False)
                expect |= {k: (v, True) for k, v in loads[n].items()}
        if now is not None:
            assert {k: s[:2] for k, s in state(now).items()} == expect
