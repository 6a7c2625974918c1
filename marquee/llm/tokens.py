"""Words of Arrow text columns as integer arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def byte_map(lower: bool = False) -> np.ndarray:
    """The identity on bytes, or ASCII lower-casing."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[0x41:0x5B] += 0x20
    return table


def byte_set(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null texts are empty."""
    filled = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Longest stretches of bytes outside ``separators`` (a set of ASCII
    bytes), no stretch crossing from text to text.

    Returns the words of all texts in order, the place of each word's first
    byte, and for every text the number of its first word (one more entry at
    the end).
    """
    inside = ~separators[data]
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][np.diff(offsets) > 0]] = False
    starts = np.flatnonzero(inside & ~before)
    kept = data[inside]
    at = np.empty(len(starts) + 1, np.int32)
    at[:-1] = (np.cumsum(inside, dtype=np.int64)[starts] - 1) if len(starts) else 0
    at[-1] = len(kept)
    flat = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(kept)])
    return flat, starts, np.searchsorted(starts, offsets)


def numbered(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Every word as the number of its first equal, and the distinct words."""
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``size`` bytes in one text column."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(lengths, dtype=np.int64) - lengths) // size
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for start, end in zip(edges[:-1], edges[1:]):
        if end > start:
            yield batch.slice(start, end - start)
