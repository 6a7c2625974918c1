"""The corpus pipeline, stage by stage, against brute force."""

import duckdb
import pytest
from llm_tables import base_secrets, components_by_pairs, edge_dir, empty_dir, simhash_by_hand  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from marquee.llm import queries as q

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def _sql(rows, statement):
    """A contract query's SQL over a list of documents."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    found = con.execute(statement)
    names = [d[0] for d in found.description]
    return [dict(zip(names, r)) for r in found.fetchall()]


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows, stages = _rows(docs), dict(cp.STAGES)

    kept = {r["doc_id"] for r in _sql(rows, q.oracle_sql()["op4_quality"]) if r["kept"]}
    docs = stages["quality rules"](spark, docs, sf)
    rows = sorted((r for r in rows if r[0] in kept), key=repr)
    assert _rows(docs) == rows and docs.columns == COLUMNS

    by_id = sorted(rows)
    roots = components_by_pairs([simhash_by_hand(r[1]) for r in by_id], cp.MAX_BITS)
    docs = stages["SimHash near-dedup"](spark, docs, sf)
    rows = sorted((by_id[i] for i in set(roots)), key=repr)
    assert _rows(docs) == rows and docs.columns == COLUMNS

    def clear(text):
        out, last = "", 0
        for start, _, _, end in base_secrets(text):
            if start >= last:
                out += text[last:start] + "[SECRET]"
            last = max(last, end)
        return out + text[last:]

    docs = stages["secret scans"](spark, docs, sf)
    rows = sorted(((i, clear(t), lang, s, len(clear(t)) if base_secrets(t) else n) for i, t, lang, s, n in rows), key=repr)
    assert _rows(docs) == rows and any("[SECRET]" in r[1] for r in rows) and docs.columns == COLUMNS

    times = {r["doc_id"]: r["repeats"] for r in _sql(rows, q.oracle_sql()["op8_mixing"])}
    docs = stages["mixing sources"](spark, docs, sf)
    rows = sorted((r for r in rows for _ in range(times[r[0]])), key=repr)
    assert _rows(docs) == rows and docs.columns == COLUMNS

    library = Tokenizer.from_file(cp.TOKENIZER)
    out = stages["BPE encoding"](spark, docs, sf).collect()
    want = sorted((r[0], library.encode(r[1], add_special_tokens=False).ids) for r in rows)
    assert sorted((r["doc_id"], list(r["ids"])) for r in out) == want
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out)


@pytest.mark.parametrize("tables", ["edge_dir", "empty_dir"])
def test_awkward_and_empty_tables_pass_through(spark, request, tables):
    folder = request.getfixturevalue(tables)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    # the one very long text repeats itself and is no norm: clean ones stay, of copies one
    kept = {r["doc_id"] for r in cp.run(spark, folder).select("doc_id").distinct().collect()}
    assert ({None, 1} <= kept and not {2, 8, 13} & kept) if tables == "edge_dir" else not kept
    for name, stage in cp.STAGES[1:-1]:  # without the quality rules something is left
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
    out = cp.STAGES[-1][1](spark, docs, folder)
    assert out.where("not round_trip").count() == 0 and out.count() == docs.count()
    assert (docs.count() == 0) == (tables == "empty_dir")


def test_dedup_of_awkward_rows(spark, edge_dir):  # noqa: F811
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    out = cp.simhash_dedup(spark, docs, edge_dir)
    ids = sorted((r["doc_id"] for r in out.collect()), key=str)
    # 1 stands for its copies (2, twice, and 19 if near), 3 for all without words
    assert out.columns == docs.columns and None in ids and 2 not in ids and {1, 3} <= set(ids) and not {4, 5, 17} & set(ids)
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert cp.simhash_dedup(spark, nameless, edge_dir).count() == len(ids)


def test_redaction_updates_lengths(spark, edge_dir):  # noqa: F811
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in cp.secret_scan(spark, docs, edge_dir).collect()}
    assert rows[9]["text"].count("[SECRET]") == 3 and rows[9]["n_chars"] == len(rows[9]["text"]) and rows[3]["text"] is None
    assert rows[1]["n_chars"] == 10


def test_columns_of_any_name_and_kind(spark, edge_dir):  # noqa: F811
    """Dots, maps, and names that operators use themselves come through."""
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet").select(*COLUMNS)
    extra = docs.withColumns({
        "a.b": F.lit("dot"), "m": F.create_map(F.lit("k"), F.col("doc_id")), "row": F.lit(1), "found": F.lit(2), "a": F.lit(3), "b": F.struct(F.lit(4).alias("x.y")),
        "c0": F.lit(5), "verdict": F.lit(6), "planned": F.lit(7), "copy": F.lit(8), "size": F.lit(9),
    })
    plain = docs
    for name, stage in cp.STAGES[1:-1]:
        extra, plain = cp.materialize(stage(spark, extra, edge_dir), "t"), cp.materialize(stage(spark, plain, edge_dir), "t")
        assert extra.columns[:5] == COLUMNS and len(extra.columns) == 16, name
        assert _rows(extra) == _rows(plain)
        assert all(r["a.b"] == "dot" and r["m"] == {"k": r["doc_id"]} and r["b"]["x.y"] == 4 for r in extra.collect())
    first = cp.STAGES[0][1](spark, extra, edge_dir)
    assert first.columns == extra.columns and first.count() == cp.STAGES[0][1](spark, plain, edge_dir).count()
    out = cp.STAGES[-1][1](spark, extra, edge_dir)
    assert out.where("not round_trip").count() == 0 and out.count() == plain.count()
