"""Quoted CSV of any size, read by many tasks.

A quoted cell may hold line breaks, so a task that starts in the middle of a
file cannot tell whether its first line starts a record. ``multiLine`` reading
avoids the question by giving each file to one task. Here files are read as
lines, split as Spark splits any text, and the question is answered by parity:
a line starts a record exactly if the number of quotes before it in its file
is even.

1. Every task counts the quotes of its splits and notes, for an even and for an
   odd number of quotes before the split, where the last record starts: one
   row per split.
2. A running sum over a file's splits (one small row each) says which of the
   two holds, and which record a split's first lines go on with.
3. Lines that are whole records, nearly all, go straight to the CSV parser.
   Only lines of records with line breaks are grouped, by file and record.

The quote character must not stand inside unquoted cells (RFC 4180); it is
doubled inside quoted ones. Line breaks inside cells are kept as they are. One
carriage return before the end of a record belongs to the line end. Empty
lines between records are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.session import materialize

#: Splits that are sent to all tasks as a table; beyond it a join is shuffled.
BROADCAST_SPLITS = 200_000
_KEYS = "file string, block bigint"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (start of the split) and raw bytes of every line."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


class _Walk:
    """State of the split that a task is reading: lines so far, parity of
    their quotes, and the last record start under both assumptions."""

    def __init__(self, quote: str):
        self.quote = quote
        self.at: tuple | None = None

    def pieces(self, batch: pa.RecordBatch) -> Iterator[tuple[tuple, bool, slice, tuple[np.ndarray, ...]]]:
        """Per stretch of lines of one split: (file, block), whether it is the
        split's first, the rows, and (number, quotes before, quotes after, last
        start if the split starts even, if odd) of each line; parities only."""
        files = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        blocks = batch.column(1).to_numpy()
        quotes = pc.count_substring(batch.column(2), self.quote).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero((np.diff(files, prepend=-1) != 0) | (np.diff(blocks, prepend=-1) != 0)).tolist()
        for start, end in zip(new, [*new[1:], batch.num_rows]):
            key = (batch.column(0)[start].as_py(), int(blocks[start]))
            first = key != self.at
            if first:
                self.at, self.n, self.parity, self.last = key, 0, 0, [-1, -1]
            after = (self.parity + np.cumsum(quotes[start:end])) % 2
            before = np.concatenate([[self.parity], after[:-1]])
            number = self.n + np.arange(end - start)
            last = [np.maximum(np.maximum.accumulate(np.where(before == p, number, -1)), self.last[p]) for p in (0, 1)]
            self.n, self.parity, self.last = self.n + end - start, int(after[-1]), [int(x[-1]) for x in last]
            yield key, first, slice(start, end), (number, before, after, *last)


def _split_table(lines: DataFrame, quote: str) -> DataFrame:
    """One row per split: file, block, whether quotes are open where it starts
    (``odd``) and the record (``carried``) that its first lines may belong to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, rows = _Walk(quote), {}
        for batch in batches:
            for key, _, _, (_, _, after, even, odd) in walk.pieces(batch):
                rows[key] = {"file": key[0], "block": key[1], "quotes": int(after[-1]), "even": int(even[-1]), "odd": int(odd[-1])}
        if rows:
            yield pa.RecordBatch.from_pylist(list(rows.values()))

    ends = lines.mapInArrow(work, f"{_KEYS}, quotes bigint, even bigint, odd bigint")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = ends.withColumn("opened", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    last = F.when(F.col("opened"), F.col("odd")).otherwise(F.col("even"))
    own = opened.withColumn("own", F.when(last >= 0, F.struct("block", last.alias("line"))))
    return own.select("file", "block", F.col("opened").alias("odd"), F.last("own", ignorenulls=True).over(earlier).alias("carried"))


def csv_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(file, block, line, record): every record of the CSV files at ``path``
    as text without its line end; (block, line) is the place in its file."""
    lines = _lines(spark, path)
    splits = materialize(_split_table(lines, quote), "csv-splits")
    if splits.count() <= BROADCAST_SPLITS:
        splits = F.broadcast(splits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk(quote)
        for batch in batches:
            parts = [found for _, _, _, found in walk.pieces(batch)]
            if parts:
                columns = [pa.array(np.concatenate(x)) for x in zip(*parts)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["file", "block", "value", "line", "before", "after", "even", "odd"])

    walked = lines.mapInArrow(work, f"{_KEYS}, value binary, line bigint, before bigint, after bigint, even bigint, odd bigint")
    s = splits.select("file", "block", F.col("odd").alias("opened"), "carried")
    known = walked.join(s, ["file", "block"])
    last = F.when(F.col("opened"), F.col("odd")).otherwise(F.col("even"))
    of = F.when(last >= 0, F.struct("block", last.alias("line"))).otherwise(F.col("carried"))
    opened = F.col("opened").cast("long")
    starts = (F.col("before") + opened) % 2 == 0
    ends = (F.col("after") + opened) % 2 == 0
    known = known.withColumn("whole", starts & ends).withColumn("of", of)
    single = known.where("whole").select("file", "block", "line", F.col("value").cast("string").alias("record"))
    many = known.where("not whole").groupBy("file", "of").agg(F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["value"].cast("string")), "\n")
    several = many.select("file", "of.block", "of.line", text.alias("record"))
    trimmed = F.expr("if(endswith(record, '\\r'), left(record, length(record) - 1), record)")
    return single.unionByName(several).withColumn("record", trimmed).where("record <> ''")


def read_csv(spark: SparkSession, path: str, columns: list[str], header: bool = True, quote: str = '"', place: str | None = None) -> DataFrame:
    """The cells of quoted CSV files as text columns; with ``header`` the first
    record of every file is left out. A missing cell is null, as is an empty
    unquoted one. ``place`` names one more column: struct (file, block, line),
    in the order of the records."""
    records = csv_records(spark, path, quote)
    if header:
        first = (F.col("block") == 0) & (F.col("line") == 0)
        records = records.where(~first)
    ddl = ", ".join("`" + c.replace("`", "``") + "` string" for c in columns)
    cells = F.from_csv("record", ddl, {"quote": quote, "escape": quote})
    parsed = records.select(cells.alias("cells"), F.struct("file", "block", "line").alias("place"))
    shown = [F.col("cells.`" + c.replace("`", "``") + "`").alias(c) for c in columns]
    return parsed.select(*shown, *([F.col("place").alias(place)] if place else []))


__all__ = ["csv_records", "read_csv"]
