"""Periodic runs of words, as maximal pairs of an LCP-interval tree.

A run is a stretch of a text's words with smallest period q (words q apart are identical) and
length >= max(6, 4 * q) that no neighbouring word extends keeping q.  It is the maximal pair of the
positions i and i + q that match over length - q words, so pairs whose distance is at most a third
of their match, over 5 words and more, are the runs; nothing is extended afterwards.

Per chunk of whole texts, in a task:

1. The suffixes that share their first ``LEAST`` words with another one of the same text are
   sorted by prefix doubling (all others lie in intervals too shallow for a run), and the common
   prefixes of neighbours are read off the ranks of the rounds.
2. The LCP-interval tree is built bottom-up on a stack, over those groups whose longest prefix is at
   least three times their closest distance.  An interval holds its positions in order, each with
   the class of the word on its left.  A child is merged into its parent small into large; a
   position meets its neighbours from the other side, and is paired with those of another class
   within the distance.  Of a run's period, the two positions always are neighbours: one between
   them would give the match a shorter period.
3. Pairs of one stretch (multiples of its period) leave the least period.

Work is about n log n a text, no pair list grows with the square of a repeat.

Defined cases: null, empty and blank texts have no words and no runs; null and repeated ids and repeated
rows are texts like any other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import words

#: The least match of a run's pair: 6 words with period 1, 8 with period 2.
LEAST = 5
#: Words of the texts that are sorted together; a longer text is a chunk of its own.
CHUNK = 300_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)

RUNS = "array<struct<start:long,length:long,period:long>>"


def _repeated(w: np.ndarray, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Those of ``starts`` whose ``LEAST`` words may occur again in their text (hashes decide, so none is lost)."""
    h = text[starts].astype(np.uint64) * _ODD[LEAST]
    for k in range(LEAST):
        h += (w[starts + k].astype(np.uint64) + np.uint64(1)) * _ODD[k]
    h = (h ^ (h >> np.uint64(29))) * _ODD[0]
    bits = max(10, (8 * len(starts)).bit_length())
    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
    again = np.bincount(slot, minlength=1 << bits)[slot] > 1
    return starts[again]


def _sorted_groups(w: np.ndarray, text: np.ndarray, some: np.ndarray):
    """``some`` and the positions ``LEAST`` further in order of (text, first words), with the rank of each."""
    marked = np.zeros(len(w), bool)
    marked[some] = True
    marked[some + LEAST] = True
    at = np.flatnonzero(marked)
    width = int(w.max()) + 1
    keys, size = [text[at].astype(np.int64)], int(text[-1]) + 1
    for k in range(LEAST):
        if size * width < 1 << 62:
            keys[-1] = keys[-1] * width + w[at + k]
            size *= width
        else:
            keys.append(w[at + k].astype(np.int64))
            size = width
    order = np.lexsort(keys[::-1])
    first = np.zeros(len(at), bool)
    first[:1] = True
    for key in keys:
        key = key[order]
        first[1:] |= key[1:] != key[:-1]
    return at, order, first


def suffixes(w: np.ndarray, text: np.ndarray, some: np.ndarray):
    """Positions in suffix order and their common prefix with the one before, 0 where under ``LEAST``.

    ``w`` holds word numbers from 1 on, with ``LEAST`` zeros after every text, ``text`` the text of each place.
    """
    at, order, first = _sorted_groups(w, text, some)
    index = np.full(len(w), -1, np.int32)
    index[at] = np.arange(len(at), dtype=np.int32)
    slot = np.arange(len(at))
    heads = np.flatnonzero(first)
    rank = np.empty(len(at), np.int32)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, len(at))))
    new_group, same = first.copy(), np.flatnonzero(~first)
    levels, h = [(LEAST, rank.copy())], LEAST
    while len(same):
        active = np.zeros(len(at), bool)
        active[same] = True
        active[same - 1] = True
        active = slot[active]
        mine = order[active]
        after = rank[index[at[mine] + h]]
        turn = np.lexsort((after, rank[mine]))
        mine, after, before = mine[turn], after[turn], rank[mine[turn]]
        order[active] = mine
        differs = np.ones(len(mine), bool)
        differs[1:] = (before[1:] != before[:-1]) | (after[1:] != after[:-1])
        heads = np.flatnonzero(differs)
        rank[mine] = np.repeat(active[heads], np.diff(np.append(heads, len(mine))))
        new_group[active] = differs
        same = np.flatnonzero(~new_group)
        h *= 2
        levels.append((h, rank.copy()))
    pairs = np.flatnonzero(~first)
    a, b = at[order[pairs - 1]], at[order[pairs]]
    shared = np.zeros(len(pairs), np.int64)
    for h, r in reversed(levels):
        step = np.where(r[index[a]] == r[index[b]], h, 0)
        a, b, shared = a + step, b + step, shared + step
    going = np.ones(len(pairs), bool)
    for _ in range(LEAST - 1):
        going &= w[a] == w[b]
        a, b, shared = a + going, b + going, shared + going
    lcp = np.zeros(len(at), np.int64)
    lcp[pairs] = shared
    return at[order], lcp, first


class Interval:
    """The positions below an LCP interval, in order."""

    __slots__ = ("lcp", "positions")

    def __init__(self, lcp: int, positions: list[int]):
        self.lcp, self.positions = lcp, positions

    def add(self, child: list[int], left: list[int], out: list[tuple[int, int, int]]) -> None:
        """Merge a child's positions in; pairs (position, distance, match) across go to ``out``."""
        large, small, lcp = self.positions, child, self.lcp
        if len(large) < len(small):
            large, small = small, large
        most, end = lcp // 3, len(large)
        for x in small:
            k = bisect_left(large, x)
            if k and x - large[k - 1] <= most and left[x] != left[large[k - 1]]:
                out.append((large[k - 1], x - large[k - 1], lcp))
            if k < end and large[k] - x <= most and left[x] != left[large[k]]:
                out.append((x, large[k] - x, lcp))
        if len(small) < 9:
            for x in small:
                insort(large, x)
        else:
            large.extend(small)
            large.sort()
        self.positions = large


def maximal_pairs(suffix: list[int], lcp: list[int], left: list[int]) -> list[tuple[int, int, int]]:
    """(position, distance, match) of maximal pairs of neighbours whose distance is at most a third of the match."""
    out, stack, child = [], [], [suffix[0]]
    for at, shared in zip(suffix[1:], lcp[1:]):
        while stack and stack[-1].lcp > shared:
            node = stack.pop()
            node.add(child, left, out)
            child = node.positions
        if stack and stack[-1].lcp == shared:
            stack[-1].add(child, left, out)
        else:
            stack.append(Interval(shared, child))
        child = [at]
    while stack:
        node = stack.pop()
        node.add(child, left, out)
        child = node.positions
    return out


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text (a list of words), by start, then period."""
    numbers = defaultdict(count(1).__next__)
    sizes = np.array([len(t) for t in texts], np.int64)
    found = [{} for _ in texts]
    if not sizes.sum():
        return [[] for _ in texts]
    base = LEAST + np.concatenate([[0], np.cumsum(sizes + LEAST)[:-1]])
    w = np.zeros(int(LEAST + (sizes + LEAST).sum()), np.int64)
    for t, b, n in zip(texts, base, sizes):
        w[b:b + n] = np.fromiter(map(numbers.__getitem__, t), np.int64, n)
    text = np.repeat(np.arange(len(texts)), sizes + LEAST)
    text = np.concatenate([np.zeros(LEAST, np.int64), text])
    starts = np.flatnonzero(w[:-(LEAST - 1)])
    starts = starts[w[starts + LEAST - 1] > 0]
    some = _repeated(w, text, starts)
    if not len(some):
        return [[] for _ in texts]
    suffix, lcp, first = suffixes(w, text, some)
    heads = np.flatnonzero(first)
    group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(suffix))))
    order = np.lexsort((suffix, group))
    gaps = np.full(len(suffix), len(w), np.int64)
    gaps[1:] = np.where(first[1:], len(w), np.diff(suffix[order]))
    deep = 3 * np.minimum.reduceat(gaps, heads) <= np.maximum.reduceat(lcp, heads)
    ends = np.append(heads, len(suffix))[1:]
    left = None
    for a, b in zip(heads[deep].tolist(), ends[deep].tolist()):
        if left is None:
            left = [0, *w[:-1].tolist()]
        for i, q, match in maximal_pairs(suffix[a:b].tolist(), lcp[a:b].tolist(), left):
            of = found[text[i]]
            place = (i - int(base[text[i]]), match + q)
            of[place] = min(q, of.get(place, q))
    return [sorted((start, length, q) for (start, length), q in of.items()) for of in found]


def _kept(text: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period."""
    if not runs:
        return b" ".join(text)
    keep = bytearray(b"\1") * len(text)
    for start, length, period in runs:
        keep[start + period:start + length] = bytes(length - period)
    return b" ".join(compress(text, keep))


def find_runs(docs: DataFrame) -> DataFrame:
    """Per document (``doc_id``, ``text``): doc_id, n_words, runs (by start, then period) and the collapsed text."""
    schema = f"doc_id long, n_words long, runs {RUNS}, collapsed binary"
    fields = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def collapse(ids, texts):
        runs = runs_of(texts)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(map(len, texts), pa.int64()),
             pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], pa.list_(fields)),
             pa.array(map(_kept, texts, runs), pa.binary())],
            names=["doc_id", "n_words", "runs", "collapsed"])

    def work(batches):
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(batch.column(0), batch.column(1)):
                split = (text.as_py() or "").encode().split()
                if texts and size + len(split) > CHUNK:
                    yield collapse(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc.as_py())
                texts.append(split)
                size += len(split)
            if texts:
                yield collapse(ids, texts)

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)
            .withColumn("collapsed", F.col("collapsed").cast("string")))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, with the words of about a tenth of the texts made periodic from a place on.

    h = crc32(doc_id), g = h // 10: where h % 10 = 0, words from a = g % n on repeat the p = 1 + (n - a) // (3 + g % 8)
    words there.  Rows without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .withColumn("h", h).withColumn("ws", F.when(F.expr("h % 10 = 0"), words(F.col("text")))))
    rows = rows.withColumns({"n": F.size("ws"), "g": F.expr("h div 10")})
    rows = rows.withColumn("a", F.expr("if(n > 0, int(g % n), 0)"))
    rows = rows.withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    periodic = F.expr("concat_ws(' ', slice(ws, 1, a), slice(flatten(array_repeat(slice(ws, a + 1, p), "
                      "int((n - a) div p) + 1)), 1, n - a))")
    return rows.select("doc_id", F.when(F.expr("ws is not null and n > 0"), periodic).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the run with the greatest length / period, and hashes of what :func:`find_runs` returns."""
    best = F.expr("array_max(transform(runs, r -> struct(double(r.length) / r.period as exponent, -r.start as start, "
                  "-r.period as period, r.length as length)))")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
