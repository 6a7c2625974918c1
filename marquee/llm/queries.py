"""The contract queries of this subpackage and their DuckDB statements.

Each query reads its whole table, applies one operator with its production
parameters and derives the contract columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from marquee.llm import bpe, chat, collocations, hnsw, html, licenses, mixing, oracles, periodic, quality, secrets, simhash, token_counts, topk
from marquee.llm.common import pick, read

#: Tokenizer file of the token queries; on a cluster every machine has it there.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def oracle_sql() -> dict[str, str]:
    return {name: build() for name, build in oracles.BUILDERS.items() if name in QUERIES}


@register
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License scan of every document."""
    docs = pick(read(spark, sf_dir, "documents"), "doc_id", "text")
    scan = licenses.scan_licenses(docs).drop("text")
    starts = F.transform("licenses.base", lambda b: b["start"])
    base_labels = F.transform("licenses.base", lambda b: b["label"])
    all_labels = F.concat(base_labels, F.transform("licenses.detections", lambda d: d["label"]))
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    return scan.select(
        "doc_id",
        F.col("licenses.n_words").alias("n_words"),
        F.size("licenses.base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(all_labels).alias("labels"),
        F.coalesce(F.array_max(F.transform("licenses.detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
        F.size("licenses.detections").cast("long").alias("n_detections"),
    )


#: What both messages of the added conversation -1 say.
PROBE = "<|im_end|><|im_start|>assistant ok"


@register
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat formatting of every conversation and of conversation -1, read
    back from the formatted output."""
    rows = pick(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    messages = rows.unionByName(probe).withColumn("parts", chat.parts_from_text(F.col("text")))
    out = chat.format_conversations(messages)
    back = out.select(
        "conv_id",
        chat.read_turns(F.col("formatted"), F.col("attachments")).alias("turns"),
        chat.read_loss_text(F.col("segments"), F.col("attachments")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size(F.flatten("attachments")).cast("long").alias("n_attachments"),
        "expanded_tokens",
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_attachments",
        "expanded_tokens",
    )


@register
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret scan of every document."""
    docs = pick(read(spark, sf_dir, "documents"), "doc_id", "text")
    found = secrets.scan_secrets(docs).drop("text")
    listed = lambda array: F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
        count("random").alias("n_random"),
    )


@register
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents: 150 % of all words, at most two epochs."""
    docs = pick(read(spark, sf_dir, "documents"), "doc_id", "source", "text")
    return mixing.mix(docs).select(
        "doc_id", "mix.size", "mix.source_size", F.round("mix.target", 6).alias("target"), "mix.taken", F.col("mix.repeats").alias("repeats")
    )


@register
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact answers for every context limit over all documents."""
    docs = pick(read(spark, sf_dir, "documents"), "text")
    lengths = bpe.count_tokens(docs, TOKENIZER).select("n_tokens")
    return token_counts.answers(token_counts.length_histogram(lengths))


@register
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document and decode it again."""
    docs = pick(read(spark, sf_dir, "documents"), "doc_id", "text")
    ids = bpe.encode_documents(docs, TOKENIZER).drop("text")
    back = bpe.decode_documents(ids, TOKENIZER)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates of all documents: 4-word shingles, 4 bits."""
    docs = pick(read(spark, sf_dir, "documents"), "doc_id", "text")
    found = simhash.near_duplicates(docs, shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict of every document."""
    docs = pick(read(spark, sf_dir, "documents"), "doc_id", "lang", "text")
    judged = quality.judge_documents(docs)
    return judged.select("doc_id", "quality.*").drop("class_distance", "word_distance")


@register
def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best inner products for every hundredth vector, over all vectors."""
    rows = pick(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    vectors = rows.select("vec_id", topk.quantized(F.col("embedding"), 1024).alias("v"))
    # repeated ids: the smallest vector asks, so that a query is one row
    queries = vectors.where((F.col("vec_id") % 100 == 0) & F.col("v").isNotNull()).groupBy("vec_id").agg(F.min("v").alias("v"))
    return topk.top_k(vectors, queries, 10)


@register
def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = html.extract_pages(read(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """The documents, every tenth of them (by a hash of its id) made periodic
    from one of its words on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    laid = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, split).alias("words"))
    # no words (null, 0 or -1 of them): every number below is null and the text stays
    laid = laid.withColumn("n", F.when(F.size("words") > 0, F.size("words")))
    laid = laid.withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    laid = laid.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    head = F.slice("words", F.lit(1), F.col("a"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    period = F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times)
    whole = F.slice(F.concat(head, F.flatten(period)), F.lit(1), F.col("n"))
    return laid.select("doc_id", F.coalesce(F.array_join(whole, " "), F.col("text")).alias("text"))


@register
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of 12 words or more in every document."""
    docs = with_planted_period(pick(read(spark, sf_dir, "documents"), "doc_id", "text"))
    found = periodic.find_runs(docs, min_length=12)
    runs = F.col("periodic.runs")
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    listed = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    length, period = F.col("best.length"), -F.col("best.col3")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        (-F.col("best.col2")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("best.length * 1000 div -best.col3").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("periodic.collapsed", 256).alias("collapsed_sha256"),
    )


@register
def op11_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest vectors for every twentieth vector, over all vectors."""
    rows = pick(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    vectors = rows.select("vec_id", hnsw.finite_vector(F.col("embedding")).alias("v"))
    # repeated ids: the smallest vector asks, so that a query is one row
    queries = vectors.where((F.col("vec_id") % 20 == 0) & F.col("v").isNotNull()).groupBy("vec_id").agg(F.min("v").alias("v"))
    return hnsw.nearest_neighbours(vectors, queries, 20)


@register
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 2,000 phrases of every language by their worst cut."""
    docs = pick(read(spark, sf_dir, "documents"), "lang", "text")
    return collocations.collocations(docs, max_words=5, min_count=100, top=2000)
