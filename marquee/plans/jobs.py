"""File-to-file jobs chaining the operators."""

from __future__ import annotations

import logging
import uuid
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators.curate import DEFAULT_MIN_VOTES, DEFAULT_VOTE_QUANTILE, curate_sources
from marquee.operators.index import PLACE, TITLE_COLUMNS
from marquee.plans.store import build_store
from marquee.session import scratch_path, write_table
from marquee.sources.curated_io import read_curated_csv, write_curated_csv, write_curated_parquet
from marquee.sources.inventory import fingerprint, is_stale
from marquee.sources.raw import load_sources


logger = logging.getLogger(__name__)


def retained_message(vote_quantile: float | None, min_votes: int | None) -> str:
    """Run message naming the retained share (``(1 - quantile) * 100`` %)."""
    if vote_quantile is None:
        return f"curate: keeping all movies (minimum votes: {min_votes})"
    share = round((1 - vote_quantile) * 100)
    return f"curate: keeping the top {share}% of movies by vote count (minimum votes: {min_votes})"


@dataclass
class CurateResult:
    csv_path: str
    parquet_path: str | None
    curated: DataFrame


def curate_files(
    spark: SparkSession,
    in_dir: str,
    output_prefix: str,
    vote_quantile: float | None = DEFAULT_VOTE_QUANTILE,
    min_votes: int | None = DEFAULT_MIN_VOTES,
    write_typed: bool = True,
    min_partitions: int | None = None,
) -> CurateResult:
    """Raw source folder → ``{prefix}.csv`` (list-literal cells) and, when
    ``write_typed``, ``{prefix}.parquet``; both are folders of part files.

    The curated frame feeds two writes, so it is persisted once
    (memory and disk; a lost block is recomputed from the lineage).
    """
    logger.info(retained_message(vote_quantile, min_votes))
    src = load_sources(spark, in_dir, min_partitions)
    curated = curate_sources(src, vote_quantile=vote_quantile, min_votes=min_votes, sort=True)
    curated = curated.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        csv_path = write_curated_csv(curated, f"{output_prefix}.csv")
        pq_path = write_curated_parquet(curated, f"{output_prefix}.parquet") if write_typed else None
    finally:
        curated.unpersist()
    out = spark.read.parquet(pq_path) if pq_path else read_curated_csv(spark, csv_path).drop(PLACE)
    return CurateResult(csv_path, pq_path, out)


def build_store_if_stale(spark: SparkSession, dataset_path: str, store_path: str) -> tuple[DataFrame, DataFrame, bool]:
    """Reuse the store at ``store_path`` unless the dataset's fingerprint
    (path, size, mtime, SHA-256 per file) differs from the stored one.

    A build goes into a folder of its own, and ``source_snapshots``, written
    last, names it together with the fingerprint taken before the build: a
    build that is refused or breaks off leaves the earlier store in place.
    Returns ``(titles, title_terms, rebuilt)``.
    """
    base = store_path.rstrip("/")
    stored_path = f"{base}/source_snapshots"
    current = write_table(fingerprint(spark, dataset_path), scratch_path(spark, "fingerprint"))
    try:
        stored = spark.read.parquet(stored_path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = None  # no store yet
    stale = stored is None or is_stale(current, stored)
    if stale:
        build = f"build-{uuid.uuid4().hex[:12]}"
        catalog = read_curated_csv(spark, dataset_path) if not dataset_path.rstrip("/").endswith(".parquet") else spark.read.parquet(dataset_path)
        build_store(catalog, f"{base}/{build}")
        current.withColumn("build", F.lit(build)).write.mode("overwrite").parquet(stored_path)
    else:
        build = stored.first()["build"]
    titles = spark.read.parquet(f"{base}/{build}/titles").select(*TITLE_COLUMNS)
    terms = spark.read.parquet(f"{base}/{build}/title_terms")
    return titles, terms, stale
