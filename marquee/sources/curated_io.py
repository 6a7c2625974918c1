"""Curated catalogue files: CSV with list-literal cells, and typed Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from marquee.functions.listcodec import encode_list
from marquee.operators.curate import CURATED_COLUMNS
from marquee.operators.index import PLACE
from marquee.sources.split_csv import read_csv


def to_csv_frame(curated: DataFrame) -> DataFrame:
    """Array columns → Python list-literal text; column order kept."""
    cols = []
    for f in curated.schema.fields:
        if isinstance(f.dataType, ArrayType):
            cols.append(encode_list(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return curated.select(*cols)


def write_curated_csv(curated: DataFrame, path: str) -> str:
    """CSV with header; fields quoted when needed (RFC-4180 doubling)."""
    (
        to_csv_frame(curated)
        .write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", "")
        .csv(path)
    )
    return path


def read_curated_csv(spark: SparkSession, path: str) -> DataFrame:
    """Curated CSV as text rows (lists stay list-literal text). Cells may hold
    line breaks; a large file is still read by many tasks. Where a row has no
    id (one look at the id column decides), a last column, ``PLACE``, says
    where each row stands; row numbers go by it."""
    names = spark.read.options(header=True, quote='"', escape='"', multiLine=True, inferSchema=False).csv(path).columns
    rows = read_csv(spark, path, names, place=PLACE)
    named = "tconst" in names and rows.where("tconst is null or tconst = ''").isEmpty()
    return rows.drop(PLACE) if named else rows


def write_curated_parquet(curated: DataFrame, path: str) -> str:
    curated.select(*[c for c in CURATED_COLUMNS if c in curated.columns]).write.mode("overwrite").parquet(path)
    return path


def read_curated_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
