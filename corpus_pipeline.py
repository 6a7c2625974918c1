"""Corpus pipeline: from raw documents to encoded training text.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. ``run`` writes each result as Parquet in the shared
folder and hands the reread table to the next stage, so a lost executor costs
a part of one stage at most. All stages but the last return the columns of
``documents``; extra columns are carried along.

Rows are judged whatever else they hold: null texts count as empty, null ids
and sources are values like any other, repeated rows are copies of each other
(one stays), an empty table passes through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import bpe, mixing, quality, secrets, simhash
from marquee.llm.common import carried, cells, pick, unpacked
from marquee.session import materialize

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SHINGLE, MAX_BITS = 4, 4


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality.judge_documents(carried(docs, "lang", "text"), into="verdict")
    return unpacked(judged.where("verdict.kept"), docs.columns, "lang", "text")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component.

    The one with the smallest id stays (null ids come last); of several rows
    with that id the one with the smallest row hash, and of identical rows
    one. Only ids and hashes are grouped; the texts move once, for the join
    with what stays.
    """
    whole = carried(docs, "doc_id", "text")
    # maps cannot be hashed; their JSON can
    values = [F.to_json(F.struct(c)) if "map<" in t else c for c, (_, t) in zip(cells(docs.columns, ("doc_id", "text")), docs.dtypes)]
    # 128 bits name a row, so that null ids and repeated ids need no care
    whole = whole.withColumns({"a": F.xxhash64(*values), "b": F.xxhash64(F.lit(1), *values)})
    rows = whole.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "a", "b").alias("doc_id"), "text")
    # the smallest row of a component is its name
    found = simhash.near_duplicates(rows, shingle=SHINGLE, radius=MAX_BITS)
    stays = found.select("component_id.a", "component_id.b").distinct()
    return unpacked(whole.join(stays, ["a", "b"], "left_semi").dropDuplicates(["a", "b"]), docs.columns, "doc_id", "text")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark; ``n_chars`` follows."""
    scanned = secrets.scan_secrets(carried(docs, "text", "n_chars"), into="found")
    hit = F.size("found") > 0
    scanned = scanned.withColumn("text", F.when(hit, secrets.redact(F.col("text"), F.col("found"))).otherwise(F.col("text")))
    length = F.length("text").cast(scanned.schema["n_chars"].dataType)
    scanned = scanned.withColumn("n_chars", F.when(hit, length).otherwise(F.col("n_chars")))
    return unpacked(scanned, docs.columns, "text", "n_chars")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated (or left out) as the mix of sources wants."""
    mixed = mixing.mix(carried(docs, "doc_id", "source", "text"), into="planned")
    taken = mixed.where("planned.repeats > 0")
    return unpacked(taken.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("planned.repeats")))), docs.columns, "doc_id", "source", "text")


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with whether they decode to its text."""
    encoded = bpe.encode_checked(pick(docs, "doc_id", "lang", "source", "text"), TOKENIZER)
    ids = F.col("encoded.ids")
    return encoded.select("doc_id", "lang", "source", ids.alias("ids"), F.size(ids).cast("long").alias("n_tokens"), F.col("encoded.same").alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_dedup),
    ("secret scans", secret_scan),
    ("mixing sources", source_mix),
    ("BPE encoding", bpe_encode),
]

#: Fingerprints and byte-pair merges have no SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "corpus-stage")
    return docs
