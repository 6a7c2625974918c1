"""Embedding constraints without broadcasts; overlaps of short and long lists."""

import random

import pytest

from marquee.operators import slices as sl
from test_slices import _thawed, emb, tables


def test_constraints_send_no_table_through_the_driver(spark, tmp_path):
    stored = []
    for i, df in enumerate(tables(spark, _thawed([emb(1), emb(2, feature=99)]))):  # files have a known, small size
        df.write.parquet(str(tmp_path / str(i)))
        stored.append(spark.read.parquet(str(tmp_path / str(i))))
    e, f, m = stored
    plan = sl.embedding_problems(e, f, m)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 3


@pytest.mark.parametrize("list_terms", [0, 3, 1024])
def test_overlap_of_short_and_long_lists(spark, list_terms):
    rnd = random.Random(8)
    of = {f"i{i}": {f"t{rnd.randrange(12)}" for _ in range(rnd.randint(0, 9))} for i in range(30)}
    terms = [(i, t) for i, ts in of.items() for t in ts for _ in range(rnd.randint(1, 2))] + [(None, "t1"), ("i3", None)]
    pairs = [(f"i{rnd.randrange(32)}", f"i{rnd.randrange(32)}") for _ in range(300)] + [(None, "i1"), ("i1", None)]
    found = sl.overlap_counts(spark.createDataFrame(pairs, "q string, c string"), spark.createDataFrame(terms, "id string, term string"), salts=3, list_terms=list_terms)
    want = {(q, c): len(of.get(q, set()) & of.get(c, set())) for q, c in pairs}
    assert sorted((r["q"], r["c"], r["overlap"]) for r in found.collect()) == sorted((q, c, n) for (q, c), n in want.items() if n)
