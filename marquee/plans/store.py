"""The recommendation store: titles + term index written as Parquet tables.

Writing the index once (as the reference builds its store once per source)
cuts the lineage: every recommendation plan then starts from two small
Parquet scans instead of re-deriving the catalogue, and a lost executor
re-reads files rather than recomputing the curation. The default location
is a fresh folder under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from marquee.operators.index import TITLE_COLUMNS, check_rows, index_tables, store_rows
from marquee.session import scratch_path, write_table


def build_store(catalog: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Index ``catalog`` and persist ``titles`` and ``title_terms``.

    The (possibly expensive) catalogue plan runs once, for the titles table;
    the checks and the terms read that table. A catalogue with violations is
    refused with ``ValueError``: no row is dropped silently. ``title_terms``
    is range-partitioned and sorted by term, so that each file holds its own
    stretch of terms and a lookup skips the others.
    """
    spark = catalog.sparkSession
    base = path or scratch_path(spark, "store")
    rows = write_table(store_rows(catalog), f"{base}/titles")
    check_rows(rows)
    _, terms = index_tables(rows)
    terms_t = write_table(terms.repartitionByRange("term"), f"{base}/title_terms", sort_within=["term"])
    return rows.select(*TITLE_COLUMNS), terms_t
