"""Jobs that log themselves: source snapshots in, rows out, real counts.

``run_job`` writes a job's result and gathers, while the write runs, how many
rows came from each source and how many went out (``DataFrame.observe``: no
second pass, no count job). It returns the run log rows of the contract:
``etl_runs`` (one row, also for a job that failed, with its error) and
``etl_run_sources`` (one row per source, with its role).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: Kinds of runs and final states (fixed values of the contract).
RUN_TYPES = ("imdb_load", "tmdb_enrichment", "csv_backfill", "sqlite_backfill", "text_feature_build", "embedding_backfill")
SUCCEEDED, FAILED = "succeeded", "failed"

RUNS = (
    "etl_run_id bigint, run_type string, status string, started_at timestamp, finished_at timestamp, code_version string, loader_name string, "
    "parameters string, records_read bigint, records_written bigint, error_message string"
)
RUN_SOURCES = "etl_run_id bigint, source_snapshot_id bigint, role string, records_read bigint"
MAX_ERROR = 2000


@dataclass(frozen=True)
class Source:
    """What a job reads: its rows and the id of the snapshot they are from."""

    rows: DataFrame
    snapshot_id: int | None = None


@dataclass(frozen=True)
class Run:
    """Log rows of one run; ``output`` reads what it wrote (None: failed)."""

    runs: DataFrame
    sources: DataFrame
    output: DataFrame | None
    status: str


def _observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def run_job(
    run_id: int,
    run_type: str,
    sources: Mapping[str, Source],
    build: Callable[[dict[str, DataFrame]], DataFrame],
    path: str,
    code_version: str | None = None,
    loader_name: str | None = None,
    parameters: Mapping | None = None,
    check: Callable[[DataFrame], DataFrame] | None = None,
) -> Run:
    """Write ``build(rows by role)`` as Parquet to ``path`` and log the run.

    ``records_read`` of a source is the number of its rows that reached the
    job (filters that are pushed into a scan come before, whatever the job
    does comes after), null for a source that the job never used;
    ``records_written`` counts the written rows. ``check`` may return rows
    that break a rule: any such row fails the run, as an exception does. A
    failed run has its error, null counts and no output, and is *returned*,
    so that its log rows can be stored; a wrong ``run_type`` raises.
    """
    if run_type not in RUN_TYPES:
        raise ValueError(f"run_type must be one of {', '.join(RUN_TYPES)}")
    if not sources:
        raise ValueError("a run has one source at least")
    spark = next(iter(sources.values())).rows.sparkSession
    started = datetime.now(timezone.utc)
    observed = {role: _observed(source.rows, f"run {run_id} reads {role}") for role, source in sources.items()}
    error, output, counts, written = None, None, {role: None for role in sources}, None
    try:
        built = build({role: rows for role, (rows, _) in observed.items()})
        out, seen = _observed(built, f"run {run_id} writes")
        out.write.mode("overwrite").parquet(path)
        written = seen.get["rows"]
        used = _used(built, observed)
        counts = {role: one.get["rows"] if role in used else None for role, (_, one) in observed.items()}
        output = spark.read.parquet(path)
        if check is not None and (broken := check(output).limit(1).count()):
            raise ValueError(f"{broken} or more rows break a rule of the run")
    except Exception as exc:  # noqa: BLE001 - a failed run is a logged run
        error, output, written, counts = f"{type(exc).__name__}: {exc}"[:MAX_ERROR], None, None, {role: None for role in sources}
    status = FAILED if error else SUCCEEDED
    known = [n for n in counts.values() if n is not None]
    row = (
        int(run_id), run_type, status, started, datetime.now(timezone.utc), code_version, loader_name,
        json.dumps(dict(parameters or {}), sort_keys=True), sum(known) if known else None, written, error,
    )
    bridge = [(int(run_id), source.snapshot_id, role, counts[role]) for role, source in sources.items()]
    return Run(spark.createDataFrame([row], RUNS), spark.createDataFrame(bridge, RUN_SOURCES), output, status)


def _used(built: DataFrame, observed: dict[str, tuple[DataFrame, Observation]]) -> set[str]:
    """Roles whose rows are part of the job's plan: only these are observed."""
    plan = built._jdf.queryExecution().optimizedPlan().toString()
    return {role for role, (_, seen) in observed.items() if f"CollectMetrics {seen._name}," in plan}


__all__ = ["FAILED", "RUN_TYPES", "SUCCEEDED", "Run", "Source", "run_job"]
