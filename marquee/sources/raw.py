"""Raw tab-separated source files (five-file set) → typed DataFrames.

Read with quoting off (a leading ``"`` in a title is data, not a quote, and
``None``/``NA`` titles stay text); every column arrives as text, is selected
by name (the CSV parser prunes the rest), the missing marker ``\\N`` becomes
null and numbers are ``try_cast`` (a bad number becomes null instead of
failing the job).
Plain ``.tsv`` files split across tasks; ``.tsv.gz`` is one split per file,
so the reader repartitions after the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.scalars import MISSING_MARKER

# Fixed values of the raw source set: file names and the columns used.
SOURCE_FILES = {
    "titles": "title.basics.tsv",
    "crew": "title.crew.tsv",
    "ratings": "title.ratings.tsv",
    "principals": "title.principals.tsv",
    "names": "name.basics.tsv",
}
SOURCE_COLUMNS = {
    "titles": {"tconst": "string", "titleType": "string", "primaryTitle": "string", "genres": "string"},
    "crew": {"tconst": "string", "directors": "string"},
    "ratings": {"tconst": "string", "averageRating": "double", "numVotes": "bigint"},
    "principals": {"tconst": "string", "ordering": "bigint", "nconst": "string", "category": "string"},
    "names": {"nconst": "string", "primaryName": "string"},
}
# Kept as raw text (the missing marker is interpreted by the list splitters).
_KEEP_MARKER = {("titles", "genres"), ("crew", "directors")}


def tsv_reader(spark: SparkSession, null_marker: bool = True):
    r = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("escape", "")
    r = r.option("inferSchema", False).option("mode", "PERMISSIVE")
    if null_marker:
        r = r.option("nullValue", MISSING_MARKER)
    return r


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system that Spark reads it from."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def resolve_source_path(spark: SparkSession, in_dir: str, file_name: str) -> str:
    """``name.tsv`` inside ``in_dir`` or, where only that is there, the
    published ``name.tsv.gz``."""
    plain = f"{in_dir.rstrip('/')}/{file_name}"
    return plain + ".gz" if not path_exists(spark, plain) and path_exists(spark, plain + ".gz") else plain


def read_source(spark: SparkSession, path: str, kind: str, min_partitions: int | None = None) -> DataFrame:
    """One raw file as the typed frame of ``kind`` (one scan, columns pruned).

    The missing marker becomes null, except in the list-valued text columns
    (genres, directors), where the list splitter interprets it. A gzip file
    is read by one task, so its rows are dealt out after the scan
    (``min_partitions``, else the session's shuffle partitions).
    """
    raw = tsv_reader(spark, null_marker=False).csv(path)
    cols = []
    for c, t in SOURCE_COLUMNS[kind].items():
        v = F.col(c) if (kind, c) in _KEEP_MARKER else F.nullif(F.col(c), F.lit(MISSING_MARKER))
        cols.append((v.try_cast(t) if t != "string" else v).alias(c))
    df = raw.select(*cols)
    if path.endswith(".gz"):
        df = df.repartition(min_partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df


def load_sources(spark: SparkSession, in_dir: str, min_partitions: int | None = None) -> dict[str, DataFrame]:
    """The five source tables of a folder, keyed like :data:`SOURCE_FILES`."""
    return {
        kind: read_source(spark, resolve_source_path(spark, in_dir, name), kind, min_partitions)
        for kind, name in SOURCE_FILES.items()
    }


def write_sources(frames: dict[str, DataFrame], out_dir: str) -> dict[str, str]:
    """Write frames as tab-separated folders named like the source files
    (nulls as the missing marker). Returns kind → path."""
    paths = {}
    for kind, df in frames.items():
        path = f"{out_dir.rstrip('/')}/{SOURCE_FILES[kind]}"
        cols = list(SOURCE_COLUMNS[kind])
        (
            df.select(*[F.col(c).cast("string").alias(c) for c in cols])
            .write.mode("overwrite")
            .option("sep", "\t")
            .option("header", True)
            .option("quote", "")
            .option("escape", "")
            .option("nullValue", MISSING_MARKER)
            .option("emptyValue", "")
            .csv(path)
        )
        paths[kind] = path
    return paths
