"""SHA-256 of files of any size, in constant memory.

A digest needs a file's bytes in order, so a file is one task's work; it need
not be one row, nor in memory. Files are read as bytes between line feeds,
split like any text, packed into chunk rows of about ``CHUNK_BYTES`` with
their place, and each file's chunks are streamed in order (sorted, spilling to
disk) through a running digest whose state is all that a task holds.

What a line reader does not show is known from the file's length: whether the
last line ends with a line feed, and a byte order mark at the start, which the
reader skips. Files that the reader would unpack (by their extension) are
digested from their packed bytes as single rows, 2 GB at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
#: Extensions that readers unpack (fixed values).
PACKED = r"\.(gz|bz2|deflate|snappy|lz4|zst|zstd|xz)$"
MARK = b"\xef\xbb\xbf"


class RunningDigest:
    """SHA-256 of a file told line stretch by line stretch, without its last
    line feed and without a byte order mark until the end."""

    def __init__(self):
        self.plain, self.marked = hashlib.sha256(), hashlib.sha256(MARK)
        self.bytes = 0
        self.begun = False

    def update(self, stretch: bytes) -> None:
        """Lines joined by line feeds, without the last line's own."""
        for part in (b"\n", stretch) if self.begun else (stretch,):
            self.plain.update(part)
            self.marked.update(part)
            self.bytes += len(part)
        self.begun = True

    def hexdigest(self, size: int) -> str:
        left = size - self.bytes
        if left not in (0, 1, 3, 4):
            raise ValueError(f"a file of {size} bytes changed while it was read ({self.bytes} bytes seen)")
        digest = self.marked if left >= 3 else self.plain
        if left in (1, 4):
            digest.update(b"\n")
        return digest.hexdigest()


def _streamed(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256) of the files that are not packed."""
    meta = F.col("_metadata")
    text = spark.read.option("lineSep", "\n").text(path).where(~meta["file_path"].rlike(PACKED))
    lines = text.select(meta["file_path"].alias("file"), meta["file_size"].alias("size"), meta["file_block_start"].alias("block"), F.col("value").cast("binary").alias("value"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        key, n, total = None, 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": key[0], "size": key[1], "block": key[2], "n": n, "lines": b"\n".join(held)}], schema=schema)

        schema = pa.schema([("file", pa.string()), ("size", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("lines", pa.binary())])
        for batch in batches:
            for *place, value in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (place != key or total >= CHUNK_BYTES):
                    yield row()
                    n, total, held = (n + 1 if place == key else 0), 0, []
                key = place
                held.append(value)
                total += len(value) + 1
        if held:
            yield row()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, size, state = None, 0, RunningDigest()
        done = lambda: pa.RecordBatch.from_pylist([{"file": file, "sha256": state.hexdigest(size)}])
        for batch in batches:
            for name, length, lines_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4)):
                if name != file:
                    if file is not None:
                        yield done()
                    file, size, state = name, length, RunningDigest()
                state.update(lines_.as_py())
        if file is not None:
            yield done()

    chunks = lines.mapInArrow(pack, "file string, size bigint, block bigint, n bigint, lines binary")
    return chunks.repartition("file").sortWithinPartitions("file", "block", "n").mapInArrow(run, "file string, sha256 string")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, source_size, source_mtime, source_sha256) of every file
    under ``path`` (a file, a folder of part files, or a glob). Spark lists no
    empty files, so these have no row."""
    found = spark.read.format("binaryFile").load(path)
    listed = found.select(
        F.col("_metadata.file_path").alias("file"), F.col("path").alias("source_path"), F.col("length").alias("source_size"),
        F.col("modificationTime").alias("source_mtime"),
    )
    packed = found.where(F.col("_metadata.file_path").rlike(PACKED)).select(F.col("_metadata.file_path").alias("file"), F.sha2("content", 256).alias("sha256"))
    digests = _streamed(spark, path).unionByName(packed)
    out = listed.join(digests, "file", "left")
    # a file without any line is a lone mark
    sha = F.coalesce("sha256", F.when(F.col("source_size") == len(MARK), hashlib.sha256(MARK).hexdigest()))
    return out.select("source_path", "source_size", "source_mtime", sha.alias("source_sha256"))


__all__ = ["RunningDigest", "file_digests"]
