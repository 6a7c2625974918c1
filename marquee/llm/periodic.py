"""Periodic runs of words by maximal pairs of a bottom-up LCP-interval tree.

A run is a stretch of words with smallest period q, at least twice as long as
q, which no neighbouring word extends. Equal stretches of l words at places
i < j that agree neither in the word before nor in the word after are a
maximal pair. Where its distance d = j - i is at most l, the two stretches
touch or overlap, and words i to j + l - 1 have period d and are maximal with
it: such a pair needs no extension, it *is* a run.

The suffixes of a text are sorted by doubling (each round orders by twice as
many words and goes on with the suffixes that are still tied), and the ranks
of the rounds give the longest common prefixes (LCP) of neighbours. The tree
of LCP intervals is walked bottom-up; an interval's members are kept as their
left-word classes, interleaved in one list in order of place, and when a child
is merged the pairs between child and interval are looked for.

Only neighbours in that list can be runs. Let u be the interval's l words and
i < j two of its members, j - i <= l. Members in between repeat u at equal
distances, so they have the left word of j, and an in-between member k has the
right word of i. Thus (i, j) is no maximal pair at this interval unless i and
k came in the same child, and then (i, k), a smaller period of the same
stretch, was seen there. What neighbours yield is exactly the runs with their
smallest periods, once each. Runs of fewer than ``min_length`` words have
l < min_length / 2 at some distance only if they are too short, so intervals
of fewer than min_length / 2 words are never built.

A text is one task's work by nature: the cost is n log n in its n words,
memory some tens of bytes a word.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from marquee.llm.common import carried, cells, unused
from marquee.llm.tokens import byte_set, numbered, raw, slices, words

#: White space between words: space and the ASCII controls 09-0D (fixed values).
SPACES = byte_set(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Bytes of text that are sorted together.
SLICE_BYTES = 2_000_000
RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])
FOUND = StructType([StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType()), StructField("n_words", LongType())])


def repeated(ids: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the texts in which some ``width`` words stand twice (or
    seem to, by a 64-bit hash: texts are only ever skipped rightly)."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    gram = text[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(width):
        gram = (gram ^ mixed[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
        gram ^= gram >> np.uint64(29)
    whole = np.flatnonzero(text[:n] == text[width - 1 :])
    gram = gram[whole]
    order = np.argsort(gram)
    ranked = gram[order]
    twice = np.flatnonzero(ranked[1:] == ranked[:-1])
    return np.unique(text[whole[order[twice]]])


def suffix_ranks(ids: np.ndarray, text: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, text by text,
    until none are tied. Equal ranks: the same words, all inside the text.

    ``text``: number of each word's text; ``last``: place after its end.
    """
    n = len(ids)
    key = text.astype(np.int64) * (int(ids.max(initial=0)) + 1) + ids
    rank = np.empty(n, np.int32)
    tied = np.arange(n)
    levels, width = [], 0
    while len(tied):
        if width:
            after = tied + width
            second = np.where(after < last[tied], rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
            key = rank[tied].astype(np.int64) * (n + 1) + second
            base = rank[tied]
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.empty(len(order), bool)
        new[:1] = True
        new[1:] = ranked[1:] != ranked[:-1]
        group = np.flatnonzero(new)
        member = np.cumsum(new) - 1
        place = group[member]  # where each one's group starts
        if width:
            # a group's rank: that of the group it came from, plus those before it there
            old = base[order]
            fresh = np.empty(len(order), bool)
            fresh[:1] = True
            fresh[1:] = old[1:] != old[:-1]
            origin = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            rank[tied[order]] = old + (place - origin).astype(np.int32)
        else:
            rank[order] = place
        levels.append(rank.copy())
        sizes = np.diff(np.append(group, len(order)))
        tied = tied[order[sizes[member] > 1]]
        width = width * 2 or 1
    return levels


def neighbour_lcp(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Words that the suffixes at ``a`` and ``b`` (of one text) begin with alike."""
    n, alike = len(last), np.zeros(len(a), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        x, y = a + alike, b + alike
        ok = (x < last[a]) & (y < last[b])
        rank = levels[t]
        ok &= rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]
        alike[ok] += 1 << t
    return alike


class IntervalWalk:
    """Bottom-up walk over the LCP intervals of suffixes in sorted order,
    gathering (start, length, period) of runs."""

    def __init__(self, left: dict[int, int], min_length: int):
        self.left, self.min_length = left, min_length
        self.runs: list[tuple[int, int, int]] = []

    def _pair(self, i: int, j: int, depth: int) -> None:
        d = j - i
        if d <= depth and depth + d >= self.min_length and self.left[i] != self.left[j]:
            self.runs.append((i, depth + d, d))

    def _merge(self, members: list[int], child: list[int], depth: int) -> list[int]:
        """Members of an interval of ``depth`` words with one more child."""
        if len(child) > len(members):
            members, child = child, members
        low, previous = 0, -1
        for t, x in enumerate(child):
            low = bisect_left(members, x, low)
            if low and members[low - 1] > previous:
                self._pair(members[low - 1], x, depth)
            if low < len(members) and (t + 1 == len(child) or child[t + 1] > members[low]):
                self._pair(x, members[low], depth)
            previous = x
        if len(child) * 8 < len(members):
            for x in child:
                insort(members, x)
            return members
        return sorted(members + child)

    def walk(self, places: list[int], lcp: list[int]) -> None:
        """One tree: ``lcp[k]`` lies between ``places[k]`` and ``places[k + 1]``."""
        depths: list[int] = []
        nodes: list[list[int]] = []
        subtree = [places[0]]
        for place, depth in zip(places[1:], lcp):
            while depths and depths[-1] > depth:
                subtree = self._merge(nodes.pop(), subtree, depths.pop())
            if depths and depths[-1] == depth:
                nodes[-1] = self._merge(nodes[-1], subtree, depth)
            else:
                depths.append(depth)
                nodes.append(subtree)
            subtree = [place]
        while depths:
            subtree = self._merge(nodes.pop(), subtree, depths.pop())


def runs_of(ids: np.ndarray, first: np.ndarray, min_length: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of all texts, starts counted over
    the joined words ``ids``; text t has words first[t] to first[t + 1] - 1."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    last = first[text + 1]
    least = max(1, -(-min_length // 2))  # a run's l is its length - q, at least half of it
    levels = suffix_ranks(ids, text, last)
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1], order[1:]
    lcp = np.zeros(len(a), np.int64)
    near = np.flatnonzero(text[a] == text[b])
    lcp[near] = neighbour_lcp(levels, a[near], b[near], last)
    del levels
    deep = lcp >= least
    if not deep.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[False], deep, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]  # trees: suffixes starts to ends, inclusive
    # a tree whose members stand farther apart than its longest prefix has no run
    sizes = ends - starts + 1
    tree = np.repeat(np.arange(len(starts)), sizes)
    offset = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    member = np.arange(len(tree)) - offset[tree] + starts[tree]
    places = order[member]
    by_place = places[np.lexsort((places, tree))]
    gaps = np.diff(by_place, append=by_place[-1:])
    gaps[np.append(offset[1:], len(tree)) - 1] = np.iinfo(np.int64).max
    closest = np.minimum.reduceat(gaps, offset)
    longest = np.maximum.reduceat(np.append(lcp, 0)[member] * (member < ends[tree]), offset)
    before = np.where(places > first[text[places]], ids[np.maximum(places - 1, 0)], -1)
    found: list[tuple[int, int, int]] = []
    for t in np.flatnonzero(closest <= longest).tolist():
        inside = slice(int(offset[t]), int(offset[t] + sizes[t]))
        where = places[inside].tolist()
        walk = IntervalWalk(dict(zip(where, before[inside].tolist())), min_length)
        walk.walk(where, lcp[starts[t] : ends[t]].tolist())
        found += walk.runs
    return found


def _with_runs(texts: pa.Array, min_length: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Runs, collapsed text and number of words of every text."""
    data, offsets = raw(texts)
    flat, _, first = words(data, offsets, SPACES)
    ids, _ = numbered(flat)
    count = len(texts)
    per_text: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    keep = np.ones(len(ids) + 1, bool)
    chosen = repeated(ids, first, max(1, -(-min_length // 2)))
    if len(chosen):
        sizes = np.diff(first)[chosen]
        inner = np.concatenate([[0], np.cumsum(sizes)])
        which = np.repeat(np.arange(len(chosen)), sizes)
        joined = ids[np.arange(inner[-1]) - inner[which] + first[chosen][which]]
        cover = np.zeros(len(ids) + 1, np.int64)
        for start, length, period in runs_of(joined, inner, min_length):
            k = int(np.searchsorted(inner, start, side="right")) - 1
            t = int(chosen[k])
            at = start - int(inner[k])
            per_text[t].append((at, length, period))
            cover[first[t] + at + period] += 1
            cover[first[t] + at + length] -= 1
        keep = np.cumsum(cover) == 0
    for found in per_text:
        found.sort(key=lambda r: (r[0], r[2]))
    kept = np.flatnonzero(keep[: len(ids)])
    bounds = np.searchsorted(kept, first).astype(np.int32)
    chosen_words = flat if len(kept) == len(flat) else flat.take(pa.array(kept))
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), chosen_words), " ")
    flat_runs = np.array([r for found in per_text for r in found], np.int64).reshape(-1, 3)
    run_bounds = np.concatenate([[0], np.cumsum([len(f) for f in per_text])]).astype(np.int32)
    struct = pa.StructArray.from_arrays([pa.array(flat_runs[:, c]) for c in range(3)], names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(run_bounds, pa.int32()), struct), collapsed, pa.array(np.diff(first).astype(np.int64))


def find_runs(docs: DataFrame, text: str = "text", min_length: int = 12) -> DataFrame:
    """The rows with a struct column ``periodic`` in place of ``text``.

    ``periodic.runs``: array of (start, length, period) of all runs of at
    least ``min_length`` words, by start, then period; ``periodic.collapsed``:
    the words that no run repeats after its first period, joined by one space;
    ``periodic.n_words``. Words are the stretches between ASCII white space.

    A null, empty or blank text has no words, no runs and an empty collapsed
    text. Rows are independent: repeated rows and null ids are rows like any
    other, an empty table gives an empty one. Other columns stay as they are;
    the new one takes a longer name if ``periodic`` is taken.
    """
    if min_length < 2:
        raise ValueError("a run has two words at least")
    plain = carried(docs, text).select("row", F.col(text).alias("text"))
    schema = StructType([plain.schema["row"], StructField("found", FOUND)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                columns = _with_runs(part.column(1), min_length)
                found = pa.StructArray.from_arrays(columns, names=["runs", "collapsed", "n_words"])
                yield pa.RecordBatch.from_arrays([part.column(0), found], ["row", "found"])

    out = plain.mapInArrow(work, schema)
    others = [c for i, c in enumerate(docs.columns) if i != docs.columns.index(text)]
    shown = [value for i, value in enumerate(cells(docs.columns, ())) if i != docs.columns.index(text)]
    return out.select(*[v.alias(c) for v, c in zip(shown, others)], F.col("found").alias(unused(docs, "periodic")))


__all__ = ["find_runs", "runs_of"]
