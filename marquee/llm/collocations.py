"""Phrase collocations by prefix-free parsing.

1. *Parsing.* A text is a sequence of symbols: its words, one break symbol
   between pieces, and a tail of ``max_words - 1`` breaks. Wherever the hash of
   a window of ``max_words - 1`` symbols is 0 modulo ``TRIGGER`` a chunk ends
   with that window and the next one starts with it, so chunks overlap by one
   window and equal passages are cut alike whatever stands around them. Spark
   counts the distinct chunks per language: the dictionary, with parse
   frequencies.
2. *Counting.* N-grams are counted inside the distinct chunks, weighted by
   their frequencies. An n-gram belongs to the chunk that holds its first word
   outside the closing window; it then lies in that chunk as a whole, and what
   starts in the closing window is left to the next chunk: overlaps count once.
3. Rare n-grams are kept out of the shuffle by two sieves, one over pairs of
   words, one over triples whose pairs passed: exact sums of hash buckets,
   where a bucket below ``min_count`` proves that no n-gram in it is frequent.
   Buckets only ever let too much through; the counts that follow are exact by
   the n-grams' own words. A sieve has at most 2**``SIEVE_BITS`` bits and so
   has its broadcast. On corpora of many times more words than bits it lets
   more through, and the shuffle of counts nears one row per distinct n-gram
   and task.
4. Scores need the counts of both sides of each cut; a candidate looks up all
   its parts by a join whose table side is spread over ``SALTS`` copies, since
   one common word can be a part of many candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import pick
from marquee.llm.tokens import byte_map, byte_set, numbered, raw, slices, words
from marquee.session import materialize

#: Bytes that end a piece, and those that separate words (fixed values).
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
SPACES = b"\x20\x09"
BREAK = "\n"  # the break symbol inside a chunk; no word holds it
TRIGGER = 32
SIEVE_BITS = 28
PARTS = 256  # ranges of buckets that are summed apart
SALTS = 16
SLICE_BYTES = 8_000_000

_LOWER, _ENDS = byte_map(lower=True), byte_set(BREAKS)
_APART, _SPACE = byte_set(BREAKS + SPACES), byte_set(b"\x20")


def symbol_hashes(distinct: pa.Array) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))


def joined(gram: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from that of its first words and its last symbol."""
    out = (gram ^ symbol) * np.uint64(0x9FB21C651E98DF25)
    return out ^ (out >> np.uint64(29))


def ahead(x: np.ndarray, by: int) -> np.ndarray:
    """``x`` read ``by`` places later (its last entries repeat)."""
    if not by or not len(x):
        return x
    return np.concatenate([x[by:], np.full(min(by, len(x)), x[-1])])


def _strings(symbols: pa.Array, lists: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Space-joined symbols; the lists stand one after the other."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), symbols.take(pa.array(lists))), " ")


def parse(texts: pa.Array, langs: pa.Array, window: int) -> pa.Table:
    """Chunks of the texts: (lang, chunk, weight), distinct."""
    data, offsets = raw(texts)
    data = _LOWER[data]
    flat, starts, first = words(data, offsets, _APART)
    ids, distinct = numbered(flat)
    stop = len(distinct)
    hashes = np.append(symbol_hashes(distinct), np.uint64(0x5851F42D4C957F2D))
    symbols = pa.concat_arrays([distinct, pa.array([BREAK], pa.string())])
    # a break goes before every word, except a text's first, that follows an end of a piece
    ends = np.cumsum(_ENDS[data], dtype=np.int64)[starts] if len(starts) else np.empty(0, np.int64)
    broken = np.zeros(len(ids), np.int64)
    broken[1:] = ends[1:] != ends[:-1]
    filled = np.flatnonzero(np.diff(first))  # texts with words
    broken[first[filled]] = 0
    before = np.cumsum(broken)
    text = np.repeat(np.arange(len(filled)), np.diff(first)[filled])
    place = np.arange(len(ids)) + before + window * text
    total = len(ids) + int(broken.sum()) + window * len(filled)
    sequence = np.full(total, stop, np.int64)
    sequence[place] = ids
    begin = place[first[filled]] if len(filled) else np.empty(0, np.int64)
    end = np.append(begin[1:], total)[: len(begin)]
    # windows that trigger a cut: inside one text, neither its first nor its closing one
    code = hashes[sequence]
    mixed = np.zeros(total, np.uint64)
    for k in range(window):
        mixed = joined(mixed, ahead(code, k))
    owner = np.repeat(np.arange(len(begin)), end - begin)
    at = np.arange(total)
    cut = (mixed % np.uint64(TRIGGER) == 0) & (at + window < end[owner])
    cut[begin] = True
    start = np.flatnonzero(cut)
    stop_at = np.append(start[1:], total) + window
    last = end[owner[start]]
    stop_at = np.minimum(stop_at, last)[: len(start)]
    lengths = stop_at - start
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(start, lengths)
    chunks = _strings(symbols, sequence[inside], lengths)
    spoken = langs.take(pa.array(filled[owner[start]]))
    return pa.table({"lang": spoken, "chunk": chunks}).group_by(["lang", "chunk"]).aggregate([([], "count_all")])


def chunk_dictionary(docs: DataFrame, window: int) -> DataFrame:
    """(lang, chunk, weight): distinct chunks of the texts of (lang, text)
    with the number of times that they occur in the parse."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                found = parse(part.column(1), part.column(0), window)
                yield from pa.table({"lang": found["lang"], "chunk": found["chunk"], "weight": found["count_all"]}).to_batches()

    parsed = docs.select("lang", "text").mapInArrow(work, "lang string, chunk string, weight bigint")
    return parsed.groupBy("lang", "chunk").agg(F.sum("weight").alias("weight"))


class Grams:
    """N-grams of a slice of the dictionary, by the place of their first word.

    ``sieves[t]``: (bits, bit set) of the n-grams of t + 2 words."""

    def __init__(self, batch: pa.RecordBatch, window: int, sieves: list[tuple[int, np.ndarray]]):
        data, offsets = raw(batch.column(1))
        flat, _, first = words(data, offsets, _SPACE)
        self.ids, self.distinct = numbered(flat)
        chunk = np.repeat(np.arange(batch.num_rows), np.diff(first))
        langs = batch.column(0).dictionary_encode()
        self.langs = langs.dictionary
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[chunk].astype(np.int64)
        self.weight = batch.column(2).to_numpy(zero_copy_only=False)[chunk]
        self.own = np.arange(len(self.ids)) + window < first[chunk + 1]
        word = ~pc.equal(self.distinct, BREAK).to_numpy(zero_copy_only=False)[self.ids]
        self.code = symbol_hashes(self.distinct)[self.ids]
        self.sieves = sieves
        self._hash = [symbol_hashes(self.langs)[self.lang]]
        self._fits = [word, word]

    def hashes(self, size: int) -> np.ndarray:
        while len(self._hash) <= size:
            self._hash.append(joined(self._hash[-1], ahead(self.code, len(self._hash) - 1)))
        return self._hash[size]

    def passing(self, size: int) -> np.ndarray:
        """Whether the n-gram of ``size`` words at each place can be frequent:
        whole words, its parts pass, and so does its bucket."""
        while len(self._fits) <= size:
            n, shorter = len(self._fits), self._fits[-1]
            fits = shorter & ahead(shorter, 1)
            if n - 2 < len(self.sieves):
                bits, full = self.sieves[n - 2]
                places = np.flatnonzero(fits)
                at = (self.hashes(n)[places] >> np.uint64(64 - bits)).astype(np.int64)
                fits[places] = full[at >> 3] >> (at & 7).astype(np.uint8) & 1
            self._fits.append(fits)
        return self._fits[size]

    def bucket_sums(self, size: int, bits: int, most: int) -> Iterator[dict]:
        """Weights by bucket of the n-grams that can be frequent, by ranges;
        sums above ``most`` are as good as ``most``."""
        chosen = self.passing(size) & self.own
        at = (self.hashes(size)[chosen] >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(at)
        at, weight = at[order], self.weight[chosen][order]
        if not len(at):
            return
        edge = np.flatnonzero(np.diff(at, prepend=-1))
        bucket, total = at[edge], np.minimum(np.add.reduceat(weight, edge), most).astype("<u4")
        per = (1 << bits) // PARTS
        where = np.searchsorted(bucket, np.arange(PARTS + 1) * per)
        for part in np.flatnonzero(np.diff(where)).tolist():
            mine = slice(where[part], where[part + 1])
            yield {"part": part, "at": (bucket[mine] - part * per).astype("<u4").tobytes(), "total": total[mine].tobytes()}

    def counts(self, max_words: int) -> Iterator[pa.RecordBatch]:
        """(lang, phrase, f) of all words, of every n-gram that can be
        frequent, and of the empty phrase, which stands for all words."""
        code, many = self.lang, len(self.distinct) + 1
        for size in range(max_words + 1):
            chosen = np.flatnonzero(self.passing(size) & self.own)
            if not len(chosen):
                return
            _, rep, group = np.unique(code[chosen], return_index=True, return_inverse=True)
            total = np.bincount(group, weights=self.weight[chosen]).astype(np.int64)  # exact below 2**53
            at = chosen[rep]
            lists = self.ids[(at[:, None] + np.arange(size)[None, :]).reshape(-1)]
            phrases = _strings(self.distinct, lists, np.full(len(at), size))
            yield pa.RecordBatch.from_arrays([self.langs.take(pa.array(self.lang[at])), phrases, pa.array(total)], ["lang", "phrase", "f"])
            # an n-gram's number and its next word name the n-gram one word longer
            whole = np.flatnonzero(self.passing(size))
            _, number = np.unique(code[whole], return_inverse=True)
            code = np.zeros(len(self.ids), np.int64)
            code[whole] = number * many + ahead(self.ids, size)[whole]


def full_buckets(chunks: DataFrame, size: int, window: int, sieves: list, bits: int, min_count: int) -> tuple[int, object]:
    """Buckets of n-grams of ``size`` words whose weights reach ``min_count``,
    as a broadcast bit set of 2**bits bits."""
    spark = chunks.sparkSession

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("at", pa.binary()), ("total", pa.binary())])
        opened = [(b, s.value) for b, s in sieves]
        for batch in batches:
            for piece in slices(batch, 1, SLICE_BYTES):
                rows = list(Grams(piece, window, opened).bucket_sums(size, bits, min_count))
                for i in range(0, len(rows), 32):
                    yield pa.RecordBatch.from_pylist(rows[i : i + 32], schema=schema)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                total = held.setdefault(row["part"], np.zeros((1 << bits) // PARTS, np.uint32))
                at = np.frombuffer(row["at"], "<u4")
                total[at] = np.minimum(total[at] + np.frombuffer(row["total"], "<u4"), min_count)
        for part, total in held.items():
            yield pa.RecordBatch.from_pylist([{"part": part, "bits": np.packbits(total >= min_count, bitorder="little").tobytes()}])

    summed = chunks.mapInArrow(sums, "part int, at binary, total binary")
    rows = summed.repartition("part").mapInArrow(full, "part bigint, bits binary").collect()  # 2**bits bits at most
    out = np.zeros((1 << bits) // 8, np.uint8)
    per = len(out) // PARTS
    for row in rows:
        out[row["part"] * per : (row["part"] + 1) * per] = np.frombuffer(row["bits"], np.uint8)
    return bits, spark.sparkContext.broadcast(out)


def phrase_counts(docs: DataFrame, max_words: int, min_count: int, sieve_bits: int | None = None) -> DataFrame:
    """(lang, phrase, f): exact counts of all phrases of 1 to ``max_words``
    words that occur ``min_count`` times or more in their language, and under
    the empty phrase the number of all words."""
    window = max(max_words - 1, 1)
    chunks = materialize(chunk_dictionary(docs, window), "chunks")
    size = chunks.agg(F.sum(F.octet_length("chunk"))).first()[0] or 0
    # about two buckets for a place; never more than 2**SIEVE_BITS
    bits = sieve_bits or min(max(int(size // 3).bit_length(), 12), SIEVE_BITS)
    if not 11 <= bits <= SIEVE_BITS:
        raise ValueError(f"a sieve has 11 to {SIEVE_BITS} bits in its bucket numbers")
    sieves: list = []
    for words_each in (2, 3)[: max(max_words - 1, 0)]:
        sieves.append(full_buckets(chunks, words_each, window, sieves, bits, min_count))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = [(b, s.value) for b, s in sieves]
        for batch in batches:
            for piece in slices(batch, 1, SLICE_BYTES):
                yield from Grams(piece, window, opened).counts(max_words)

    counted = chunks.mapInArrow(work, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return materialize(counted.where((F.col("f") >= min_count) | (F.col("phrase") == "")), "phrases")


def collocations(docs: DataFrame, max_words: int = 5, min_count: int = 100, absorbed: int = 100, top: int = 2000, sieve_bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases per language.

    ``docs`` has lang and text; a null language is ``und``, a null text is
    empty. Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line
    ends, and pieces into words at spaces and tabs. A phrase of 2 to
    ``max_words`` words with a >= ``min_count`` occurrences (overlapping ones
    count) scores floor(1000 a n / (l r)) at its worst cut, where l and r count
    the cut's sides and n the language's words; of equally bad cuts the first.
    Phrases inside a longer one that has ``absorbed`` percent of their
    occurrences are left out. Ranks go by score, then a, then phrase. Repeated
    rows count each; an empty table, or one without frequent phrases, gives no
    rows. Other columns are ignored.
    """
    chosen = pick(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counts = phrase_counts(chosen, max_words, min_count, sieve_bits)
    split = counts.where(F.col("phrase").contains(" ")).select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    size = F.size("words")
    cuts = F.sequence(F.lit(1), size - 1)
    left = lambda k: F.array_join(F.slice("words", F.lit(1), k), " ")
    right = lambda k: F.array_join(F.slice("words", k + 1, size - k), " ")

    parts = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(cuts, left), F.transform(cuts, right)))
    asked = split.select("lang", "phrase", "a", F.explode(parts).alias("part")).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    table = counts.select("lang", F.col("phrase").alias("part"), "f", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    known = asked.join(table, ["lang", "part", "salt"]).groupBy("lang", "phrase", "a").agg(F.map_from_entries(F.collect_list(F.struct("part", "f"))).alias("f_of"))
    known = known.withColumn("words", F.split("phrase", " "))

    wide = lambda c: c.cast("decimal(15,0)")  # noqa: E731 - 4 + 15 + 15 digits are exact in 38

    def cut(k):
        ab = F.struct(F.col("f_of")[left(k)].alias("l"), F.col("f_of")[right(k)].alias("r"))
        return F.struct(k.alias("k"), ab.alias("f"))

    scored = known.withColumn("cuts", F.transform(cuts, cut)).withColumn("n", F.col("f_of")[""])
    scored = scored.select("lang", "phrase", "a", "n", F.explode("cuts").alias("cut"))
    scored = scored.select("lang", "phrase", "a", "n", "cut.k", "cut.f.l", "cut.f.r")
    over, under = F.lit(1000).cast("decimal(4,0)") * wide(F.col("a")) * wide(F.col("n")), wide(F.col("l")) * wide(F.col("r"))
    scored = scored.withColumns({"over": over, "under": under}).withColumn("score", F.expr("over div under"))
    worst = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda w: F.transform(F.sequence(F.lit(1), size - w + 1), lambda i: F.array_join(F.slice("words", i, w), " "))))
    held = split.where(size > 2).select("lang", F.col("a").alias("f"), F.explode(F.array_distinct(spans)).alias("phrase"))
    held = held.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = worst.join(held, ["lang", "phrase"], "left").where(F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * absorbed))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


__all__ = ["chunk_dictionary", "collocations", "phrase_counts"]
