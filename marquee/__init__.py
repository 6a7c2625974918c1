"""marquee: catalogue curation and content-based recommendation on Spark.

Every public operator takes and returns Spark DataFrames. The planning is left
to Catalyst and adaptive execution; nothing in the core collects rows to the
driver.

Sub-packages
------------
functions   Column-level helpers (scores, id splitting, term normalisation,
            list-literal codec, tokenisation, trigrams, vector math).
sources     Readers/writers: raw TSV sources, curated CSV/Parquet, evaluation
            cases (JSON), source inventory / fingerprint / staleness, and the
            bindings of the driver's test tables to the catalogue schemas.
operators   The jobs: curation, term index, overlap and cosine recommenders,
            evaluation, fuzzy title search, vector top-k, text features,
            upserts, credits and provenance.
plans       File-to-file jobs that chain operators (curate files, build the
            index when the source changed, run an evaluation).
"""

from marquee.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
