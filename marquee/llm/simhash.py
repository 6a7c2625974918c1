"""SimHash near-duplicates with bit-sliced comparison.

1. Fingerprints: words, shingles, XXH64 of every shingle, and a majority vote
   per bit, over Arrow batches (all shingles of a batch are hashed at once).
2. Equal fingerprints become one node (partial aggregation first, so a hot
   text is one row from each task).
3. Candidates: the 64 bits are cut into ``blocks``; two fingerprints within
   ``radius`` agree on at least ``blocks - radius`` of them, so every choice
   of that many blocks is a table keyed by their bits. Only keys that occur
   twice go on. A key with more than ``CHUNK`` fingerprints is dealt out in
   chunks, each pair of chunks being one group: larger, never dropped.
4. Within a group fingerprints are held as vertical bit planes. A batch of
   them is compared with all others at once: a plane's differences are added
   by carry-save logic into bitwise counters, and a query leaves the pass
   when all its counters exceed the radius. Each group returns one link per
   member to the smallest member it reaches, not its pairs.
5. Links become components by alternating large-star and small-star rounds on
   tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.bpe import chunks, raw_texts
from marquee.llm.common import pick
from marquee.session import materialize

BLOCKS = 6
#: Fingerprints that are compared in one group: 4 MB of bit planes.
CHUNK = 32_768
#: Fingerprints compared with a group at a time.
QUERIES = 256
#: Groups up to this size are compared together with others.
SMALL = 64
#: Shingles, or pairs of small groups, whose bits are laid out at a time.
RUN = 16_384
SEED = 42
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
))  # fixed values of XXH64


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotate(acc + lane * _P2, 31) * _P1


def xxh64(buffer: bytes, start: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many slices of one buffer (public algorithm, vectorized).

    The buffer must go on for 8 bytes after the last slice."""
    padded = np.frombuffer(buffer, np.uint8)  # ends in 8 bytes that no slice holds
    words = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(padded) - 7,), (1,))
    at, left, seed = start.astype(np.int64), length.astype(np.int64), np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(at), seed + _P5, np.uint64)
        long = np.flatnonzero(left >= 32)
        if len(long):
            acc = [np.full(len(long), x, np.uint64) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
            pos, stripes, live = at[long].copy(), left[long] // 32, np.arange(len(long))
            while len(live):
                for i in range(4):
                    acc[i][live] = _round(acc[i][live], words[pos[live] + 8 * i])
                pos[live] += 32
                stripes[live] -= 1
                live = live[stripes[live] > 0]
            merged = _rotate(acc[0], 1) + _rotate(acc[1], 7) + _rotate(acc[2], 12) + _rotate(acc[3], 18)
            for a in acc:
                merged = (merged ^ _round(np.zeros_like(a), a)) * _P1 + _P4
            h[long] = merged
            at = at + left // 32 * 32
        h = h + length.astype(np.uint64)
        left = left % 32
        for _ in range(3):  # up to three words of 8 bytes remain
            live = np.flatnonzero(left >= 8)
            if not len(live):
                break
            lane = words[at[live]]
            h[live] = _rotate(h[live] ^ _round(np.zeros_like(lane), lane), 27) * _P1 + _P4
            at[live] += 8
            left[live] -= 8
        live = np.flatnonzero(left >= 4)
        lane = words[at[live]] & np.uint64(0xFFFFFFFF)
        h[live] = _rotate(h[live] ^ (lane * _P1), 23) * _P2 + _P3
        at[live] += 4
        left[live] -= 4
        for _ in range(3):
            live = np.flatnonzero(left > 0)
            if not len(live):
                break
            byte = padded[at[live]].astype(np.uint64)
            h[live] = _rotate(h[live] ^ (byte * _P5), 11) * _P1
            at[live] += 1
            left[live] -= 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def _bits_of(values: np.ndarray) -> np.ndarray:
    """One row of 64 zeros and ones for every value, highest bit first."""
    return np.unpackbits(np.ascontiguousarray(values, ">u8").view(np.uint8).reshape(-1, 8), axis=1)


def _vertical(values: np.ndarray) -> np.ndarray:
    """Bit planes: row j holds bit j of all values, packed into words."""
    tall = np.zeros((64, -(-len(values) // 64) * 64), np.uint8)
    tall[:, : len(values)] = _bits_of(values).T
    return np.packbits(tall, axis=1).view(np.uint64)


def fingerprints_of(texts: list[bytes], shingle: int) -> np.ndarray:
    """Unsigned 64-bit SimHash of every text."""
    words = [raw.lower().split() for raw in texts]
    joined = [b" ".join(w) for w in words if w]
    n = np.fromiter((len(w) for w in words if w), np.int64, len(joined))
    out = np.zeros(len(texts), np.uint64)
    if not len(joined):
        return out
    buffer = b" ".join(joined)
    gaps = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(buffer)]])
    per_text = np.maximum(n - shingle + 1, 1)
    first_word, first_shingle = np.cumsum(n) - n, np.cumsum(per_text) - per_text
    word = np.arange(per_text.sum()) + np.repeat(first_word - first_shingle, per_text)
    last = word + np.repeat(np.minimum(n, shingle), per_text) - 1
    begin = starts[word]
    width = ends[last] - begin
    padded = buffer + bytes(8)
    hashes = np.concatenate([xxh64(padded, begin[a:a + RUN], width[a:a + RUN]) for a in range(0, len(begin), RUN)])
    votes = np.zeros((len(joined), 64), np.int64)
    edges, done = np.concatenate([first_shingle, [len(hashes)]]), 0
    while done < len(joined):  # the bits of about RUN shingles at a time
        upto = max(done + 1, int(np.searchsorted(edges, edges[done] + RUN, "right")) - 1)
        if upto - done > 1:
            votes[done:upto] = np.add.reduceat(_bits_of(hashes[edges[done]:edges[upto]]), edges[done:upto] - edges[done], axis=0, dtype=np.int64)
        else:
            for run in range(int(edges[done]), int(edges[upto]), RUN):
                votes[done] += _bits_of(hashes[run:min(run + RUN, int(edges[upto]))]).sum(axis=0, dtype=np.int64)
        done = upto
    majority = votes * 2 > per_text[:, None]
    out[[i for i, w in enumerate(words) if w]] = np.packbits(majority, axis=1).view(">u8").reshape(-1)
    return out


def fingerprints(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): SimHash as bigint (its 64 bits), null text as empty.

    Texts are lower-cased in A-Z; a text of fewer words than a shingle is one
    shingle; one without words has fingerprint 0.
    """
    slim = pick(df, doc_id, text).toDF("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                fp = fingerprints_of(list(raw_texts(part.column(1))), shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return slim.mapInArrow(work, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp bigint")


_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Bitwise: counter > radius, comparing digits from the highest."""
    more = np.zeros_like(count[0])
    same = ~more
    for d in reversed(range(len(count))):
        if radius >> d & 1:
            same = same & count[d]
        else:
            more = more | (same & count[d])
            same = same & ~count[d]
    return more


def _within(differences, over: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit-sliced distances of rows of columns: (rows left, not exceeded).

    ``differences(j, live)`` gives for the rows ``live`` the plane of bits in
    which position j differs. Carry-save steps add it to bitwise counters;
    ``over`` is sticky, and rows of which all columns have exceeded the
    radius are abandoned.
    """
    live = np.arange(len(over))
    count = [np.zeros_like(over) for _ in range(radius.bit_length())]
    for j in range(64):
        carry = differences(j, live)
        for d in range(len(count)):
            count[d], carry = count[d] ^ carry, count[d] & carry
        over = over | carry | _above(count, radius)
        if j % 4 == 3:
            busy = (over != _ALL).any(axis=1)
            if not busy.all():
                live, over, count = live[busy], over[busy], [c[busy] for c in count]
                if not len(live):
                    break
    return live, ~over


def near(queries: np.ndarray, members: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, member) at most ``radius`` bits apart, by query."""
    planes, masks = _vertical(members), _bits_of(queries).astype(bool)
    beyond = np.ones(planes.shape[1] * 64, np.uint8)
    beyond[: len(members)] = 0
    over = np.repeat(np.packbits(beyond).view(np.uint64)[None, :], len(queries), axis=0)
    live, left = _within(lambda j, rows: planes[j][None, :] ^ np.where(masks[rows, j], _ALL, np.uint64(0))[:, None], over, radius)
    row, member = np.nonzero(np.unpackbits(left.view(np.uint8), axis=1))
    return live[row], member


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Whether a[i] and b[i] are at most ``radius`` bits apart, for all i; a
    row of the comparison is a block of 4,096 pairs."""
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), RUN):
        part = a[at:at + RUN] ^ b[at:at + RUN]
        padded = np.full(-(-len(part) // 4096) * 4096, _ALL)
        padded[: len(part)] = part
        planes = _vertical(padded).reshape(64, -1, 64)
        live, left = _within(lambda j, rows: planes[j][rows], np.zeros(planes.shape[1:], np.uint64), radius)
        near_here = np.zeros(planes.shape[1:], np.uint64)
        near_here[live] = left
        out[at:at + RUN] = np.unpackbits(near_here.reshape(-1).view(np.uint8))[: len(part)].astype(bool)
    return out


def _join(parent: np.ndarray, a: int, b: int) -> int:
    """Unite two trees; the smaller root stays."""
    roots = []
    for x in (a, b):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        roots.append(int(x))
    a, b = min(roots), max(roots)
    parent[b] = a
    return a


def _labels(parent: np.ndarray) -> np.ndarray:
    while True:
        higher = parent[parent]
        if (higher == parent).all():
            return higher
        parent = higher


def link_group(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member it reaches) for members that have a link.

    Members wait in ``rest`` until reached. Each is a query once, against all
    that wait and those reached from elsewhere: a dense group is reached as a
    whole after a few queries and then has nothing left to compare with; in a
    sparse one each query is abandoned early.
    """
    parent = np.arange(len(fps))
    front, rest = parent[:0], parent.copy()
    while len(front) or len(rest):
        if not len(front):
            front, rest = rest[:QUERIES], rest[QUERIES:]
        label = _labels(parent)
        front = front[np.argsort(label[front], kind="stable")]
        batch, front = front[:QUERIES], front[QUERIES:]
        if (label[batch] == label[batch[0]]).all():
            others = front[label[front] != label[batch[0]]]
        else:
            others = np.concatenate([batch, front])
        pool = np.concatenate([others, rest])
        if not len(pool):
            continue
        row, col = near(fps[batch], fps[pool], radius)
        edges = np.searchsorted(row, np.arange(len(batch) + 1))
        for i in np.unique(row).tolist():
            for x in np.unique(label[pool[col[edges[i]:edges[i + 1]]]]).tolist():
                _join(parent, int(batch[i]), x)
        reached = np.zeros(len(pool), bool)
        reached[col] = True
        reached = reached[len(others):]
        front, rest = np.concatenate([front, rest[reached]]), rest[~reached]
    label = _labels(parent)
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def link_groups(groups: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """``link_group`` of many groups of distinct fingerprints."""
    u, v = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    by_size: dict[int, list[np.ndarray]] = {}
    for g in groups:
        if len(g) > SMALL:
            for side, found in zip((u, v), link_group(g, radius)):
                side.append(found)
        elif len(g) > 1:
            by_size.setdefault(len(g), []).append(g)
    for size, alike in by_size.items():
        stacked = np.stack(alike)
        i, j = np.triu_indices(size, 1)
        linked = near_pairs(stacked[:, i].reshape(-1), stacked[:, j].reshape(-1), radius).reshape(len(alike), -1)
        for g in np.flatnonzero(linked.any(axis=1)).tolist():
            parent = np.arange(size)
            for k in np.flatnonzero(linked[g]).tolist():
                _join(parent, i[k], j[k])
            label = _labels(parent)
            moved = np.flatnonzero(label != np.arange(size))
            u.append(stacked[g][moved])
            v.append(stacked[g][label[moved]])
    return np.concatenate(u), np.concatenate(v)


def _bits(fp: Column, high: int, low: int) -> Column:
    """Bits ``high``-1 down to ``low`` of a bigint."""
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long"))


def _keys(radius: int, blocks: int) -> list[Column]:
    """One key per table: the bits of a choice of blocks, side by side."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for chosen in combinations(range(blocks), blocks - radius):
        key = F.lit(0).cast("long")
        for b in chosen:
            width = edges[b + 1] - edges[b]
            key = F.shiftleft(key, width).bitwiseOR(_bits(F.col("fp"), edges[b + 1], edges[b]))
        keys.append(key)
    return keys


def links(nodes: DataFrame, radius: int, blocks: int = BLOCKS) -> DataFrame:
    """(u, v), v < u: enough links between fingerprints at most ``radius``
    bits apart that whatever is connected stays connected.

    ``nodes``: distinct (fp).
    """
    if not 0 < radius < blocks:
        raise ValueError("radius must be positive and below the number of blocks")
    keyed = nodes.select("fp", F.posexplode(F.array(*_keys(radius, blocks))).alias("tab", "key"))
    shared = keyed.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunk = lambda n: F.ceil(n / F.lit(CHUNK)).cast("int")
    met = keyed.join(shared, ["tab", "key"]).withColumn("c", F.pmod(F.xxhash64("fp"), chunk(F.col("n"))).cast("int"))
    # chunk c meets every chunk: group (smaller, larger) holds both
    dealt = met.withColumn("o", F.explode(F.sequence(F.lit(0), chunk(F.col("n")) - 1))).select(
        "tab", "key", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), "fp"
    )
    group = ["tab", "key", "a", "b"]

    def solve(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, fps = (np.concatenate(x) for x in zip(*held))
        change = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
        found = [x.view(np.int64) for x in link_groups(np.split(fps, change), radius)]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(*found)), pa.array(np.minimum(*found))], ["u", "v"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of a group that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            fps = batch.column(4).to_numpy().view(np.uint64)
            if held and (held[0][0][0] != ids[0]).any():
                yield solve(held)
                held = []
            last = int(np.flatnonzero((ids != ids[-1]).any(axis=1)).max(initial=-1)) + 1
            if last:
                yield solve([*held, (ids[:last], fps[:last])])
                held = []
            held.append((ids[last:], fps[last:]))
        if held:
            yield solve(held)

    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(work, "u bigint, v bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of (u, v), v < u; root: smallest node.

    Large-star links the larger neighbours of a node to its smallest one,
    small-star the others; both keep what is connected, and only stars are
    left when neither changes anything. Each round is written to the shared
    folder, and minima are partial sums before any shuffle.
    """
    def fixed(df: DataFrame) -> tuple[DataFrame, tuple]:
        table = materialize(df, "links")
        row = table.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        return table, tuple(row)

    now, state = fixed(edges)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = state
        now, state = fixed(small.unionByName(smallest.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, radius: int = 4, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest doc_id that a
    chain of fingerprints at most ``radius`` bits apart reaches.

    Rows with equal fingerprints are linked, texts without words (null ones
    too) among them. Null ids are nobody's smallest id: a component of only
    such rows has a null id. Repeated rows give repeated rows.
    """
    marked = materialize(fingerprints(df, text, doc_id, shingle), "simhash")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    member = components(links(nodes.select("fp"), radius, blocks))
    rooted = nodes.join(member, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")
