"""Every contract query on awkward rows, against SQL or brute force."""

import random

import pytest
from tokenizers import Tokenizer

from llm_tables import (  # noqa: F401 - two of them are fixtures
    CONVERSATIONS, DOCS, PAGES, VECTORS, base_secrets, by_duckdb, by_spark, components_by_pairs, edge_dir, empty_dir, sha, simhash_by_hand,
)
from marquee.llm import queries as q


@pytest.mark.parametrize("name", ["op1_licenses", "op2_chat", "op4_quality", "op8_mixing", "op9_topk"])
def test_query_equals_its_sql(spark, edge_dir, name):
    assert by_spark(q.QUERIES[name](spark, edge_dir)) == by_duckdb(edge_dir, q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    rows = q.QUERIES[name](spark, empty_dir).collect()
    if name == "op2_chat":
        assert [r["conv_id"] for r in rows] == [-1]
    elif name == "op3_token_counts":
        assert {r["total_docs"] for r in rows} == {0} and {r["truncated_total"] for r in rows} == {0}
    else:
        assert rows == []


def test_licenses(spark, edge_dir):
    rows = {r["doc_id"]: r for r in q.op1_licenses(spark, edge_dir).collect()}
    assert (rows[3]["n_words"], rows[3]["n_base"], rows[3]["first_word"], rows[3]["labels"], rows[3]["score"]) == (0, 0, None, "", 0.0)
    six = rows[6]
    assert six["base_labels"] == "apache-2,cc-by-nc,mit" and six["n_base"] == 4 and (six["first_word"], six["last_word"]) == (3, 17)
    assert rows[7]["labels"] == "gpl-2" and rows[7]["n_base"] == 0 and rows[7]["score"] == 1.0
    assert rows[None]["base_labels"] == "mit"


def test_conversation_probe_reads_back(spark, edge_dir):
    rows = {r["conv_id"]: r for r in q.op2_chat(spark, edge_dir).collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    assert rows[-1]["turns_sha256"] == sha(f"user\n{said}\nassistant\n{said}\n") and rows[-1]["loss_sha256"] == sha(said)
    assert rows[-1]["loss_chars"] == len(said) and rows[-1]["n_turns"] == 2
    assert rows[None]["n_attachments"] == 2 and rows[None]["expanded_tokens"] == 576 + 750
    assert rows[4]["loss_chars"] == 250_000 and len(rows) == len({c[0] for c in CONVERSATIONS}) + 1


def test_secrets(spark, edge_dir):
    rows = q.op5_secrets(spark, edge_dir).collect()
    assert len(rows) == len(DOCS)
    texts = {d[0]: d[1] or "" for d in DOCS}
    for r in rows:
        found = base_secrets(texts[r["doc_id"]])
        assert r["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in found)), r
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(f[2] == k for f in found) for k in ("assign", "access", "hex")]
        listed = r["spans"].split(",") if r["spans"] else []
        assert [s for s in listed if not s.startswith("random")] == [f"{k}:{a}:{b}" for a, _, k, b in found]
        assert r["n_random"] == (r["doc_id"] == 11), r


def test_bpe_equals_the_library(spark, edge_dir):
    library = Tokenizer.from_file(q.TOKENIZER)
    texts = {d[0]: d[1] or "" for d in DOCS}
    rows = q.op7_bpe(spark, edge_dir).collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(back))


def test_token_counts(spark, edge_dir):
    library = Tokenizer.from_file(q.TOKENIZER)
    lengths = sorted(len(library.encode(d[1] or "", add_special_tokens=False).ids) for d in DOCS)
    rows = {r["context_limit"]: r for r in q.op3_token_counts(spark, edge_dir).collect()}
    assert set(lengths) | {512, 131072} <= set(rows)
    for limit, r in rows.items():
        assert r["truncated_total"] == sum(min(x, limit) for x in lengths) and r["total_tokens"] == sum(lengths)
        assert r["docs_within"] == sum(x <= limit for x in lengths) and r["docs_over"] == sum(x > limit for x in lengths)
    median = [limit for limit, r in rows.items() if "0.5" in r["quantiles"].split(",")]
    assert median == [lengths[(len(lengths) + 1) // 2 - 1]]


def test_simhash(spark, edge_dir):
    rows = q.op10_simhash(spark, edge_dir).collect()
    prints = [simhash_by_hand(d[1]) for d in DOCS]
    roots = components_by_pairs(prints, 4)
    smallest = {}
    for d, root in zip(DOCS, roots):
        if d[0] is not None:
            smallest[root] = min(d[0], smallest.get(root, d[0]))
    want = sorted((str(d[0]), format(p, "016x"), str(smallest.get(root))) for d, p, root in zip(DOCS, prints, roots))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows) == want


def test_html(spark, edge_dir):
    rows = q.op6_html(spark, edge_dir).collect()
    assert len(rows) == len(PAGES)
    texts = {}
    for r in rows:
        texts.setdefault(r["page_id"], r["text"])
        assert r["n_chars"] == len(r["text"])
    for i in range(12):  # the box that all pages of the host share goes, their shared passage stays
        assert texts[i] == f"Title & more {i}\nBold {i}\nShared passage of all pages.\nText with space {i} &am"
    assert texts[13] == texts[0]
    assert (texts[20], texts[21], texts[22], texts[None]) == ("no host", "", "", "plain < text <b>")
    assert texts[23] == "one\nx\ny" and texts[24] == "deep" and len(texts[25]) == len("long text ") * 30_000 - 1


def test_top_k_by_brute_force(spark, edge_dir):
    import math

    good = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in ((i, _as_float32(v)) for i, v in VECTORS) if v and i is not None]
    rows = {}
    for r in q.op9_topk(spark, edge_dir).orderBy("query_id", "rank").collect():
        rows.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for qid in {i for i, _ in good if i % 100 == 0}:
        mine = min(v for i, v in good if i == qid)
        scored = [(-sum(a * b for a, b in zip(mine, v)), i) for i, v in good if i != qid and len(v) == len(mine)]
        assert rows.get(qid, []) == [(i, -s) for s, i in sorted(scored)[:10]]


def _as_float32(v):
    import numpy as np

    if not v or any(x is None for x in v) or not np.isfinite(v).all():
        return None
    return np.array(v, np.float32).tolist()


def test_mix_reaches_targets(spark, edge_dir):
    rows = q.op8_mixing(spark, "/root/testdata/sf0.01").collect()
    docs = {}
    for r in rows:
        docs.setdefault(r["source_size"], []).append(r)
        assert r["taken"] <= 2 * r["size"]
    for of_source in docs.values():
        taken, target = sum(r["taken"] for r in of_source), of_source[0]["target"]
        assert abs(taken - target) <= max(r["size"] for r in of_source)
    total = sum(r["size"] for r in rows)
    assert sum(of[0]["target"] for of in docs.values()) == pytest.approx(1.5 * total, rel=1e-9)
    again = {(r["doc_id"], r["taken"]) for r in q.op8_mixing(spark, "/root/testdata/sf0.01").collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


def test_encoder_on_random_texts():
    from marquee.llm.bpe import decoder, encoder

    library, own, back = Tokenizer.from_file(q.TOKENIZER), encoder(q.TOKENIZER), decoder(q.TOKENIZER)
    pieces = ["a", "b", "'s", "'ll", "'", " ", "  ", "\n", "\n\n", "\t", "é", "ß", "１", "²", "!", "?", "<|endoftext|>", "<|", "|>", " ",
              " ", "　", "\x85", "中", "😀", "THE", "the", "0", "12", "_", "\x1c", "\x00", "ǆ", "ٱ", "्", "'t", "'re", "Q", "\x0b", "\x0c", "\x1f"]
    rnd = random.Random(3)
    for _ in range(5000):
        text = "".join(rnd.choices(pieces, k=rnd.randint(0, 25)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text.encode()).tolist() == ids and own.count(text.encode()) == len(ids)
        assert back.decode(ids) == library.decode(ids, skip_special_tokens=False)
