"""Upserts, source snapshots, run log and row provenance (second tier).

Plain Parquet has no MERGE: an upsert is a union of the stored history and
the incoming rows followed by one aggregate per entity key (latest row by
load order wins). The aggregate is partial-aggregated map-side, so an entity
key holding a large share of the rows does not land in a single task.
Identifiers that the contract gives as database sequences are derived
deterministically from the natural keys (``xxhash64``) instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_TEXT = "\\N"
FIELD_SEP = "\u001f"


def upsert_latest(
    history: DataFrame | None,
    incoming: DataFrame,
    key: list[str],
    order: list[str],
    run_col: str | None = None,
) -> DataFrame:
    """One row per ``key``: the values of the latest row by ``order``, plus
    ``first_seen``/``last_seen`` (of ``run_col`` or the first order column)
    and ``versions`` (rows seen for the key). All rows are ``active``.
    """
    rows = incoming if history is None else history.unionByName(incoming, allowMissingColumns=True)
    values = [c for c in rows.columns if c not in key]
    seen = F.col(run_col or order[0])
    latest = F.max_by(F.struct(*[F.col(c) for c in values]), F.struct(*[F.col(c) for c in order]))
    agg = rows.groupBy(*key).agg(
        latest.alias("_latest"),
        F.min(seen).alias("first_seen"),
        F.max(seen).alias("last_seen"),
        F.count(F.lit(1)).alias("versions"),
    )
    return agg.select(*key, "_latest.*", "first_seen", "last_seen", "versions", F.lit(True).alias("active"))


#: Columns that a merge of full snapshots keeps beside key and values.
STATE_COLUMNS = ["active", "first_seen", "last_seen", "changed_in", "inactive_since", "merged_load"]


def merge_snapshot(state: DataFrame | None, snapshot: DataFrame, key: list[str], load: int) -> DataFrame:
    """The serving rows after a *full* snapshot of load number ``load``.

    Keys of the snapshot are active with its values; keys that it lacks keep
    their last values and become inactive (they were deleted upstream), and
    come back active if a later snapshot has them again. Beside key and values
    the result has ``active``, ``first_seen``, ``last_seen`` (loads),
    ``changed_in`` (the load that last changed a value or the activity),
    ``inactive_since`` (null while active) and ``merged_load``.

    Loads are ordered by their numbers, not by arrival: a snapshot that is not
    newer than every load merged so far changes nothing, so a late or repeated
    load is harmless. Of several rows with one key the smallest row by its
    values counts. An empty snapshot of a newer load makes all rows inactive.
    """
    values = [c for c in snapshot.columns if c not in key]
    load_col = F.lit(int(load)).cast("bigint")
    row = F.struct(*[F.col(c) for c in values]) if values else F.struct(F.lit(1).alias("_"))
    new = snapshot.groupBy(*key).agg(F.min(row).alias("new"))
    if state is None:
        old = None
        newest = F.lit(None).cast("bigint")
    else:
        extra = F.struct(*STATE_COLUMNS).alias("was")
        old = state.select(*key, (F.struct(*values) if values else F.struct(F.lit(1).alias("_"))).alias("old"), extra)
        newest = state.agg(F.max("merged_load").alias("m")).scalar()
    fresh = F.coalesce(load_col > newest, F.lit(True))  # no state yet: any load is fresh
    new = new.where(fresh)
    if old is None:
        return new.select(
            *key, *[F.col(f"new.{c}").alias(c) for c in values], F.lit(True).alias("active"), load_col.alias("first_seen"), load_col.alias("last_seen"),
            load_col.alias("changed_in"), F.lit(None).cast("bigint").alias("inactive_since"), load_col.alias("merged_load"),
        )
    # union and one aggregate: null keys meet, and no key's rows land unaggregated in one task
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = old.select(*key, "old", "was", none(new, "new")).unionByName(new.select(*key, none(old, "old"), none(old, "was"), "new"))
    met = both.groupBy(*key).agg(F.max("old").alias("old"), F.max("was").alias("was"), F.max("new").alias("new"))
    here, known = F.col("new").isNotNull(), F.col("was").isNotNull()
    gone = ~here & F.coalesce(fresh, F.lit(True))
    same = known & F.col("new").eqNullSafe(F.col("old")) & F.col("was.active")
    shown = lambda c: F.when(here, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
    return met.select(
        *key,
        *[shown(c) for c in values],
        F.when(here, True).when(gone, False).otherwise(F.col("was.active")).alias("active"),
        F.coalesce(F.col("was.first_seen"), load_col).alias("first_seen"),
        F.when(here, load_col).otherwise(F.col("was.last_seen")).alias("last_seen"),
        F.when(here & same, F.col("was.changed_in")).when(here, load_col).when(gone & F.col("was.active"), load_col).otherwise(F.col("was.changed_in")).alias("changed_in"),
        F.when(here, F.lit(None)).when(gone, F.coalesce(F.col("was.inactive_since"), load_col)).otherwise(F.col("was.inactive_since")).cast("bigint").alias("inactive_since"),
        F.when(fresh, load_col).otherwise(F.col("was.merged_load")).alias("merged_load"),
    )


def deterministic_id(*cols: str | Column) -> Column:
    """Stable 64-bit id from natural-key columns (nulls hash as a marker)."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(NULL_TEXT)) for c in cols]
    return F.xxhash64(*parts)


def row_hash(cols: list[str | Column]) -> Column:
    """SHA-256 of the fields joined by the unit separator (nulls as ``\\N``)."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(NULL_TEXT)) for c in cols]
    return F.sha2(F.concat_ws(FIELD_SEP, *parts), 256)


def register_snapshots(fingerprints: DataFrame, source_name: str, snapshot_name: str, snapshot_date: str) -> DataFrame:
    """``source_snapshots`` rows from file fingerprints; the natural key
    ``(source_name, snapshot_name, snapshot_date, content_sha256)`` is unique
    with nulls comparing equal (``dropDuplicates`` treats nulls as equal)."""
    snaps = fingerprints.select(
        F.lit(source_name).alias("source_name"),
        F.lit(snapshot_name).alias("snapshot_name"),
        F.to_date(F.lit(snapshot_date)).alias("snapshot_date"),
        F.col("source_sha256").alias("content_sha256"),
        F.col("source_size").alias("byte_size"),
        F.col("source_path").alias("source_path"),
    ).dropDuplicates(["source_name", "snapshot_name", "snapshot_date", "content_sha256"])
    return snaps.withColumn(
        "source_snapshot_id", deterministic_id("source_name", "snapshot_name", "snapshot_date", "content_sha256")
    )


def run_log(
    snapshots: DataFrame, run_id: int, run_type: str, records_read: Column | int | None = None, records_written: Column | int | None = None
) -> tuple[DataFrame, DataFrame]:
    """``etl_runs`` (one row) and the ``etl_run_sources`` bridge rows."""
    spark = snapshots.sparkSession
    run = spark.range(1).select(
        F.lit(int(run_id)).cast("bigint").alias("etl_run_id"),
        F.lit(run_type).alias("run_type"),
        F.current_timestamp().alias("started_at"),
        F.lit(records_read).cast("bigint").alias("records_read"),
        F.lit(records_written).cast("bigint").alias("records_written"),
    )
    bridge = snapshots.select(
        F.lit(int(run_id)).cast("bigint").alias("etl_run_id"), "source_snapshot_id", F.lit("input").alias("role")
    )
    return run, bridge


def row_provenance(rows: DataFrame, table_name: str, key: list[str], fields: list[str], snapshot_id: Column | int, run_id: int) -> DataFrame:
    """``row_provenance`` rows: entity key, source row hash, snapshot, run."""
    sid = snapshot_id if isinstance(snapshot_id, Column) else F.lit(int(snapshot_id)).cast("bigint")
    return rows.select(
        F.lit(table_name).alias("table_name"),
        F.concat_ws(FIELD_SEP, *[F.coalesce(F.col(k).cast("string"), F.lit(NULL_TEXT)) for k in key]).alias("entity_key"),
        row_hash(fields).alias("source_row_sha256"),
        sid.alias("source_snapshot_id"),
        F.lit(int(run_id)).cast("bigint").alias("etl_run_id"),
    )


def resolve_external_ids(rows: DataFrame, bridge: DataFrame) -> DataFrame:
    """Attach ``tconst`` to ``(source_name, source_id)`` rows; unresolved
    rows keep a null ``tconst`` and ``resolved = false``."""
    j = rows.join(bridge.select("source_name", "source_id", "tconst"), ["source_name", "source_id"], "left")
    return j.withColumn("resolved", F.col("tconst").isNotNull())


def external_id_violations(bridge: DataFrame) -> DataFrame:
    """Bridge rows breaking uniqueness in either direction."""
    a = bridge.groupBy("source_name", "source_id").agg(F.count_distinct("tconst").alias("n")).where("n > 1").select(
        F.lit("source_id_maps_to_many").alias("problem"), "source_name", F.col("source_id").alias("value"), "n"
    )
    b = bridge.groupBy("source_name", "tconst").agg(F.count_distinct("source_id").alias("n")).where("n > 1").select(
        F.lit("tconst_has_many_ids").alias("problem"), "source_name", F.col("tconst").alias("value"), "n"
    )
    return a.unionByName(b)


def run_trace(run_id: int, bridge: DataFrame, snapshots: DataFrame, provenance: DataFrame) -> DataFrame:
    """Snapshots used by a run and the rows it touched."""
    r = bridge.where(F.col("etl_run_id") == int(run_id)).join(snapshots, "source_snapshot_id")
    p = provenance.where(F.col("etl_run_id") == int(run_id))
    return r.join(p.drop("etl_run_id"), "source_snapshot_id").select(
        "etl_run_id", "source_snapshot_id", "source_name", "snapshot_name", "table_name", "entity_key", "source_row_sha256"
    )
