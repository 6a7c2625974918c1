"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. ANSI stays on (Spark 4 default) and the code
# uses try_* functions where a null is the wanted outcome.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "marquee",
    extra_conf: dict[str, str] | None = None,
    driver_memory: str | None = None,
) -> SparkSession:
    """Return (or create) a session with the settings the operators expect.

    On a cluster call it without ``master`` so the submitter decides; tests
    and the benchmark pass ``local[N]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if driver_memory:
        # only effective when this call starts the JVM (local runs)
        builder = builder.config("spark.driver.memory", driver_memory)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra_conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_FALLBACK: dict[str, str] = {}
_SCRATCH: dict[str, list[str]] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (distributed) folder there; it is used as is.
    Where it is unset, a local master (tests) gets a fresh local folder, once
    per application; on any other master this raises, because executors do
    not see each other's disks.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = sc.applicationId
        if app not in _LOCAL_FALLBACK:
            _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="marquee-ckpt-")
        configured = _LOCAL_FALLBACK[app]
        try:
            spark.conf.set("spark.checkpoint.dir", configured)
        except Exception:  # noqa: BLE001 - core confs may be read-only at runtime
            pass
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def write_table(df: DataFrame, path: str, sort_within: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet at ``path`` and return the scan of it."""
    out = df.sortWithinPartitions(*sort_within) if sort_within else df
    out.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh folder under the shared checkpoint folder and read it
    back: a lineage cut that survives executor loss, and a single
    evaluation of an expensive plan that several branches reuse."""
    return write_table(df, scratch_path(df.sparkSession, name))


def clean_scratch(spark: SparkSession) -> None:
    """Remove the scratch folders of this application (call it when no
    result that reads them is needed any more)."""
    jvm, sc = spark._jvm, spark.sparkContext
    for path in _SCRATCH.pop(sc.applicationId, []):
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


__all__ = [
    "get_session",
    "checkpoint_dir",
    "scratch_path",
    "clean_scratch",
    "write_table",
    "materialize",
    "DEFAULT_CONF",
]
