"""Byte-level BPE by forced boundaries.

A merge can only join two bytes that stand side by side inside some token of
the vocabulary. Where a text has a byte pair that occurs inside no token, no
token spans it: the cut is certain before any merge is tried. Texts are cut at
such pairs (almost every word boundary is one), the fragments are encoded
independently, and their ids are concatenated.

The tokenizer first splits a text by a pattern, so a cut must also leave that
split unchanged. It does where the left character is printable ASCII (not
white space, whose grouping looks at what follows) and neither side is an
apostrophe (contractions): a run of letters, digits or signs that is cut just
goes on as a run of the same kind. Strings of special tokens are set apart
before anything else, as the tokenizer does.

Equal fragments have equal ids, so each task keeps a bounded table of them.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from marquee.llm.common import carried, cells, unused

#: The split of byte-level tokenizers (fixed value of the format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that every library puts into the same classes of that split.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ɏ]*")
#: Bytes of fragments, ids and table entries that a task remembers; then it
#: starts anew.
CACHE_BYTES, ENTRY_BYTES = 16_000_000, 180
#: Bytes of text that are encoded before results are handed on.
CHUNK_BYTES = 2_000_000


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in a byte-level vocabulary:
    printable bytes for themselves, the others in order from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Decoder:
    """The bytes of every id of a tokenizer file: all that decoding needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        plain = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in special.values()}
        self.bytes_of = plain | {i: s for s, i in special.items()}

    def raw(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.raw(ids).decode("utf-8", "replace")


class ForcedBoundaryEncoder:
    """Encoder for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError(f"{path}: a plain byte-level BPE tokenizer is needed")
        if spec["pre_tokenizer"]["add_prefix_space"] or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError(f"{path}: prefix space or no split pattern is not supported")
        special = spec["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in special):
            raise ValueError(f"{path}: stripping special tokens are not supported")
        self.path = path
        self.special = {t["content"].encode(): t["id"] for t in special}
        self.apart = re.compile(b"(" + b"|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + b")") if special else None
        alphabet = byte_alphabet()
        vocabulary = spec["model"]["vocab"]
        tokens = {i: bytes(alphabet[c] for c in t) for t, i in vocabulary.items() if i not in self.special.values()}
        self.cuts = self._cut_table(tokens.values())
        self.ranks = self._by_rank(spec, tokens)
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    @cached_property
    def tokenizer(self):
        """The library's tokenizer; large, and needed by few fragments."""
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    @staticmethod
    def _cut_table(tokens) -> np.ndarray:
        """For every byte pair, whether it is a usable forced boundary."""
        inside = np.zeros(65536, bool)
        joined = np.frombuffer(b"".join(tokens), np.uint8).astype(np.int32)
        lengths = np.fromiter(map(len, tokens), np.int64)
        pairs = (joined[:-1] << 8) | joined[1:]
        ends = np.cumsum(lengths)[:-1] - 1
        inside[np.delete(pairs, ends)] = True
        left, right = np.zeros(256, bool), np.ones(256, bool)
        left[0x21:0x7F] = True
        right[0x80:0xC0] = False  # never inside a character
        left[0x27] = right[0x27] = False
        return ~inside & (left[:, None] & right[None, :]).reshape(-1)

    @staticmethod
    def _by_rank(spec: dict, tokens: dict[int, bytes]):
        """The same merges in a faster library, if ids are in merge order."""
        import tiktoken

        vocabulary = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ids = [vocabulary[a + b] for a, b in merges]
        if ids != sorted(ids) or (ids and ids[0] < 256):
            return None
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks={b: i for i, b in tokens.items()}, special_tokens={})

    def fragments(self, raw: bytes) -> list[bytes]:
        """The raw text cut at its forced boundaries."""
        data = np.frombuffer(raw, np.uint8)
        pairs = (data[:-1].astype(np.uint16) << 8) | data[1:]
        at = (np.flatnonzero(self.cuts[pairs]) + 1).tolist()
        return [raw[a:b] for a, b in zip([0, *at], [*at, len(raw)])] if raw else []

    def _learn(self, fragment: bytes) -> bytes:
        text = fragment.decode()
        if self.ranks is not None and (fragment.isascii() or _PLAIN.fullmatch(text)):
            ids = self.ranks.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        packed = array("i", ids).tobytes()
        if len(fragment) <= 64:
            self.held += len(fragment) + len(packed) + ENTRY_BYTES
            if self.held > CACHE_BYTES:
                self.known, self.held = {}, 0
            self.known[fragment] = packed
        return packed

    def _packed(self, raw: bytes) -> list[bytes]:
        learn = self._learn
        out = []
        for piece in self.apart.split(raw) if self.apart else [raw]:
            if piece in self.special:
                out.append(array("i", [self.special[piece]]).tobytes())
            else:
                out += [self.known.get(f) or learn(f) for f in self.fragments(piece)]
        return out

    def encode(self, raw: bytes) -> np.ndarray:
        """Ids of a text given as UTF-8."""
        return np.frombuffer(b"".join(self._packed(raw)), np.int32)

    def count(self, raw: bytes) -> int:
        return sum(map(len, self._packed(raw))) // 4


@lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBoundaryEncoder:
    return ForcedBoundaryEncoder(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def chunks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about CHUNK_BYTES in one column."""
    array = batch.column(column)
    sizes = pc.list_value_length(array) if pa.types.is_list(array.type) else pc.binary_length(array)
    start = total = 0
    for i, size in enumerate(sizes.to_pylist()):
        total += size or 0
        if total >= CHUNK_BYTES:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _id_lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    values = np.concatenate(ids) if ids else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))


def _with_column(df: DataFrame, text: str, into: str, kind: str, make) -> DataFrame:
    """Add a column that ``make`` computes from Arrow chunks of ``text``."""
    place = df.columns.index(text)
    into = unused(df, into)
    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"`{into}` {kind}").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, place):
                yield pa.RecordBatch.from_arrays([*part.columns, make(part.column(place))], [*part.schema.names, into])

    return df.mapInArrow(work, schema)


def raw_texts(array: pa.Array) -> Iterator[bytes]:
    for value in array.cast(pa.binary()) if not pa.types.is_binary(array.type) else array:
        yield value.as_py() or b""


def encode_documents(df: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Add array<int> ``into``: the ids of every whole text (null: none, as
    for the empty text). Any other columns are carried along."""

    def make(column: pa.Array) -> pa.Array:
        return _id_lists([encoder(path).encode(raw) for raw in raw_texts(column)])

    return _with_column(df, text, into, "array<int>", make)


def encode_checked(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The columns of ``df`` but ``text``, as they are, then struct
    ``encoded``: ``ids`` of every whole text (null: empty) and ``same``,
    whether these ids decode to the text. One worker encodes and decodes, and
    only one text at a time exists twice.
    """
    plain = carried(df, text).select("row", F.col(text).alias("text"))
    kind = StructType([StructField("ids", ArrayType(IntegerType())), StructField("same", BooleanType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, back = encoder(path), decoder(path)
        for batch in batches:
            for part in chunks(batch, 1):
                ids, same = [], []
                for raw in raw_texts(part.column(1)):
                    ids.append(own.encode(raw))
                    same.append(back.raw(ids[-1].tolist()) == raw)
                found = pa.StructArray.from_arrays([_id_lists(ids), pa.array(same, pa.bool_())], names=["ids", "same"])
                yield pa.RecordBatch.from_arrays([part.column(0), found], ["row", "encoded"])

    out = plain.mapInArrow(work, StructType([plain.schema["row"], StructField("encoded", kind)]))
    place = df.columns.index(text)
    shown = [value.alias(c) for i, (value, c) in enumerate(zip(cells(df.columns, ()), df.columns)) if i != place]
    return out.select(*shown, F.col("encoded").alias(unused(df, "encoded")))


def decode_documents(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add string ``into``: the text that the ids stand for (null: empty)."""

    def make(column: pa.Array) -> pa.Array:
        return pa.array([decoder(path).decode(x.as_py() or []) for x in column], pa.string())

    return _with_column(df, ids, into, "string", make)


def count_tokens(df: DataFrame, path: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """Add bigint ``into``: encoded length of every whole text (null: 0)."""

    def make(column: pa.Array) -> pa.Array:
        return pa.array([encoder(path).count(raw) for raw in raw_texts(column)], pa.int64())

    return _with_column(df, text, into, "bigint", make)


__all__ = ["Decoder", "ForcedBoundaryEncoder", "encode_documents", "encode_checked", "decode_documents", "count_tokens", "decoder", "encoder"]
