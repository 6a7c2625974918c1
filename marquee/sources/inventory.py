"""Source inventory, size cap, fingerprint and staleness (no network).

All are DataFrame jobs over Spark's ``binaryFile`` listing: the listing
reads only file metadata unless ``content`` is selected (column pruning);
the fingerprint streams the content through the executors (see digest).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.sources.digest import file_digests
from marquee.sources.raw import SOURCE_FILES

# Fixed values of the source set.
DEFAULT_BASE_URL = "https://datasets.imdbws.com"
DEFAULT_MAX_FILE_BYTES = 2048 * 1024 * 1024
GZ_SUFFIX = ".gz"


def manifest(spark: SparkSession, base_url: str = DEFAULT_BASE_URL, in_dir: str = ".") -> DataFrame:
    """One row per required source file: name, download URL, destination."""
    rows = [(kind, name + GZ_SUFFIX) for kind, name in SOURCE_FILES.items()]
    m = spark.createDataFrame(rows, "kind string, file_name string")
    return m.select(
        "kind",
        "file_name",
        F.concat(F.lit(base_url.rstrip("/")), F.lit("/"), F.col("file_name")).alias("url"),
        F.concat(F.lit(in_dir.rstrip("/")), F.lit("/"), F.col("file_name")).alias("destination"),
    )


def listing(spark: SparkSession, in_dir: str) -> DataFrame:
    """``(entry_name, length, modification_time, files)`` per top-level entry
    of a folder: a plain file, or a folder of part files (summed)."""
    base = in_dir.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    local = base.split("://", 1)[-1]
    local = local[5:] if local.startswith("file:") else local
    rel = F.regexp_extract(F.col("path"), r"^.*?" + _escape(local) + r"/([^/]+)", 1)
    return (
        files.select(rel.alias("entry_name"), "length", F.col("modificationTime").alias("modification_time"))
        .where(F.col("entry_name") != "")
        .groupBy("entry_name")
        .agg(F.sum("length").alias("length"), F.max("modification_time").alias("modification_time"), F.count(F.lit(1)).alias("files"))
    )


def _escape(text: str) -> str:
    import re

    return re.escape(text)


def source_inventory(spark: SparkSession, in_dir: str, force: bool = False, base_url: str = DEFAULT_BASE_URL) -> DataFrame:
    """Manifest left-joined with the listing: ``action`` is ``skip`` for a
    present file (``name.tsv.gz`` or ``name.tsv``, file or folder),
    ``download`` for a missing one, ``refresh`` when forced."""
    m = manifest(spark, base_url, in_dir)
    present = listing(spark, in_dir).select(
        F.regexp_replace("entry_name", r"\.gz$", "").alias("base_name"), "length", "modification_time"
    )
    present = present.groupBy("base_name").agg(F.sum("length").alias("length"), F.max("modification_time").alias("modification_time"))
    j = m.withColumn("base_name", F.regexp_replace("file_name", r"\.gz$", "")).join(present, "base_name", "left")
    action = (
        F.when(F.lit(force), F.lit("refresh"))
        .when(F.col("length").isNotNull(), F.lit("skip"))
        .otherwise(F.lit("download"))
    )
    return j.select("kind", "file_name", "url", "destination", "length", "modification_time", action.alias("action"))


def inventory_totals(inventory: DataFrame) -> DataFrame:
    """One row: files present, files missing and total bytes present."""
    return inventory.agg(
        F.count_if(F.col("length").isNotNull()).alias("files_present"),
        F.count_if(F.col("length").isNull()).alias("files_missing"),
        F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("total_bytes"),
    )


def size_violations(inventory: DataFrame, max_file_bytes: int = DEFAULT_MAX_FILE_BYTES) -> DataFrame:
    """Files above the cap (the job fails closed on any row here)."""
    return inventory.where(F.col("length") > F.lit(int(max_file_bytes))).select(
        "file_name", "length", F.lit(int(max_file_bytes)).alias("max_file_bytes")
    )


def check_size_cap(inventory: DataFrame, max_file_bytes: int = DEFAULT_MAX_FILE_BYTES) -> None:
    """Fail closed: raise when any of the required files exceeds the cap (the
    comparison runs as a job; at most the manifest's names are returned)."""
    over = size_violations(inventory, max_file_bytes)
    n = over.count()
    if n:
        names = [r["file_name"] for r in over.select("file_name").orderBy("file_name").collect()]
        raise ValueError(f"{n} source file(s) exceed {max_file_bytes} bytes: {', '.join(names)}")


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """``(source_path, source_size, source_mtime, source_sha256)`` per file
    under ``path`` (a file or a folder of part files), streamed in constant
    memory whatever its size."""
    return file_digests(spark, path)


def staleness(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Per file: ``stale`` when any key differs or the file is new/removed."""
    keys = ["source_size", "source_mtime", "source_sha256"]
    c = current.select("source_path", *[F.col(k).alias("c_" + k) for k in keys])
    s = stored.select("source_path", *[F.col(k).alias("s_" + k) for k in keys])
    j = c.join(s, "source_path", "full_outer")
    same = F.lit(True)
    for k in keys:
        same = same & F.col("c_" + k).eqNullSafe(F.col("s_" + k))
    status = (
        F.when(F.col("s_source_size").isNull() & F.col("s_source_sha256").isNull(), F.lit("new"))
        .when(F.col("c_source_size").isNull() & F.col("c_source_sha256").isNull(), F.lit("removed"))
        .when(same, F.lit("fresh"))
        .otherwise(F.lit("changed"))
    )
    return j.select("source_path", status.alias("status"), (~same).alias("stale"))


def is_stale(current: DataFrame, stored: DataFrame) -> bool:
    """True when any file is new, removed or changed (one boolean to the
    driver; the comparison itself runs as a job)."""
    return bool(staleness(current, stored).agg(F.coalesce(F.max(F.col("stale").cast("int")), F.lit(1))).first()[0])
