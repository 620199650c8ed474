"""Substring deduplication over super-k-mers.

Every window of ``k`` consecutive words goes to the bucket of its minimiser, the least
hash among the ``m``-word grams inside it.  Consecutive windows mostly share the
minimiser, so a whole run of them travels as one packed string of words.  In a bucket
only minimisers met at least twice can hold equal windows; the windows under those are
counted exactly by sorting (ranks of doubling length over exact word numbers, no
hashes), and each window equal to an earlier one is reported.

* A run equal to another run of the same task is reported where it is found and not
  sent, so a passage that a third of all documents share reaches its bucket once per
  task.
* The number of buckets follows the bytes of text, so a bucket is a bounded task at any
  size.
* "Earlier" is a smaller ``doc_id``, or the same document and an earlier start.

Defined cases: null and empty texts have no words; a null ``doc_id`` counts as the largest
long; rows with the same ``doc_id`` and different texts are each judged on their own
positions, identical rows get the same result and do not remove each other; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 20
M = 4
#: Bytes of text a bucket stands for on average.
BUCKET_BYTES = 8 << 20
#: Words that a task handles at a time.
CHUNK_WORDS = 600_000
REMEMBER = 400_000
NULL_ID = (1 << 63) - 1
RANGES = "doc long, mark int, first long, last long"


class _Hashes(dict):
    """64-bit hash of each word, remembered."""

    def __missing__(self, word):
        import xxhash
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_KNOWN = _Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def minima(hashes: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the gram at each word, and the least of the grams of the window that starts there."""
    n = len(hashes) - m + 1
    grams = np.zeros(n, np.uint64)
    for j in range(m):
        grams = grams * np.uint64(0xD6E8FEB86659FD93) + hashes[j:j + n]
    own = mixed(grams)
    low, width = own, 1
    while width < k - m + 1:
        step = min(width, k - m + 1 - width)
        low = np.minimum(low[:len(low) - step], low[step:])
        width += step
    return own, low


def runs(split: list[list[bytes]], k: int, m: int):
    """Runs of windows that share a minimiser: (document, first word, windows, minimiser), and the words."""
    words = [w for ws in split for w in ws]
    if len(_KNOWN) > REMEMBER:
        _KNOWN.clear()
    if len(words) < k:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), words, none
    hashes = np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))
    own, low = minima(hashes, k, m)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(split)), sizes)[:len(low)]
    at = np.arange(len(low))
    valid = at + k <= ends[doc]
    first = valid.copy()
    # a run holds one occurrence of its minimiser (the leftmost), so no two of its windows are equal
    first[1:] &= ~valid[:-1] | (low[1:] != low[:-1]) | (own[:len(low) - 1] == low[:-1])
    starts = np.flatnonzero(first)
    # a run ends where the next one starts, or at the last window of its document
    counts = np.minimum(np.append(starts[1:], len(low)), ends[doc[starts]] - k + 1) - starts
    return doc[starts], starts, counts, low[starts], words, ends - sizes


def _pack(buckets, low, doc, mark, start, count, strings, repeats):
    """One compressed payload per bucket: columns of numbers, the runs' strings, and known repeats."""
    import zstandard
    zip_ = zstandard.ZstdCompressor(level=9)
    order = np.argsort(buckets, kind="stable")
    edges = np.flatnonzero(np.diff(buckets[order])) + 1
    for part in np.split(order, edges):
        if len(part):
            b = int(buckets[part[0]])
            dup = repeats.pop(b, np.zeros((0, 4), np.int64))
            yield b, zip_.compress(_payload(low[part], doc[part], mark[part], start[part], count[part],
                                            [strings[i] for i in part.tolist()], dup))
    none = np.zeros(0, np.int64)
    for b, dup in repeats.items():
        yield b, zip_.compress(_payload(none.astype(np.uint64), none, none, none, none, [], dup))


def _payload(low, doc, mark, start, count, strings, dup) -> bytes:
    # half of the minimiser's bits are enough to sort apart what is not alike; ids as steps pack better
    return b"".join([struct.pack("<qq", len(low), len(dup)), (low >> np.uint64(32)).astype("<u4").tobytes(),
                     np.diff(doc, prepend=0).astype("<i8").tobytes(), mark.astype("<i4").tobytes(),
                     start.astype("<i4").tobytes(), count.astype("<i4").tobytes(),
                     np.ascontiguousarray(dup, "<i8").tobytes(), b"\n".join(strings)])


def _unpack(data: bytes):
    n, d = struct.unpack_from("<qq", data)
    at, out = 16, []
    for kind, width in (("<u4", 4), ("<i8", 8), ("<i4", 4), ("<i4", 4), ("<i4", 4)):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * width
    out[1] = np.cumsum(out[1])
    dup = np.frombuffer(data, "<i8", 4 * d, at).reshape(d, 4)
    return (*out, dup, data[at + 32 * d:].split(b"\n") if n else [])


def packed_runs(docs: DataFrame, buckets: int, k: int = K, m: int = M) -> DataFrame:
    """(bucket, payload) of all runs of all documents (columns doc, mark, text)."""

    def send(ids, marks, split):
        doc, start, count, low, words, base = runs(split, k, m)
        if not len(doc):
            return
        lens = np.fromiter(map(len, words), np.int64, len(words))
        text = b" ".join(words)
        begin = np.cumsum(lens + 1) - lens - 1
        last = start + count + k - 2
        a, z = begin[start].tolist(), (begin[last] + lens[last]).tolist()
        strings = [text[i:j] for i, j in zip(a, z)]
        ids, marks = ids[doc], marks[doc]
        start = start - base[doc]
        bucket = (low % np.uint64(buckets)).astype(np.int64)
        # equal runs: the earliest travels, the others are known repeats (or the same row again)
        _, group, times = np.unique(low, return_inverse=True, return_counts=True)
        many = np.flatnonzero(times[group] > 1)
        many = many[np.lexsort((start[many], ids[many]))]
        keep, seen, repeats = np.ones(len(low), bool), {}, {}
        for i in many.tolist():
            j = seen.setdefault(strings[i], i)
            if j != i:
                keep[i] = False
                if ids[i] != ids[j] or start[i] != start[j]:
                    repeats.setdefault(int(bucket[i]), []).append(
                        (ids[i], marks[i], start[i], start[i] + count[i] - 1))
                elif marks[i] != marks[j]:
                    keep[i] = True
        repeats = {b: np.array(x, np.int64) for b, x in repeats.items()}
        left = np.flatnonzero(keep)
        out = list(_pack(bucket[left], low[left], ids[left], marks[left], start[left], count[left],
                         [strings[i] for i in left.tolist()], repeats))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()),
                                          pa.array([p for _, p in out], pa.binary())],
                                         names=["bucket", "payload"])

    def work(batches):
        ids, marks, split, held = [], [], [], 0
        for batch in batches:
            for i, (doc, mark) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                ws = (batch.column(2)[i].as_py() or "").encode().split()
                if len(ws) < k:
                    continue
                ids.append(doc)
                marks.append(mark)
                split.append(ws)
                held += len(ws)
                if held > CHUNK_WORDS:
                    yield from send(np.array(ids, np.int64), np.array(marks, np.int64), split)
                    ids, marks, split, held = [], [], [], 0
        yield from send(np.array(ids, np.int64), np.array(marks, np.int64), split)

    return docs.mapInArrow(work, "bucket long, payload binary")


def window_ranks(numbers: np.ndarray, k: int) -> np.ndarray:
    """A rank for each start such that two ranks are equal just if the k numbers from there are."""
    need, width, rank, held = k, 1, numbers, {}
    while True:
        held[width] = rank
        if 2 * width > k:
            break
        rank = _paired(rank[:len(rank) - width], rank[width:])
        width *= 2
    out, done = None, 0
    for width in sorted(held, reverse=True):
        if need & width:
            part = held[width][done:]
            n = len(numbers) - done - width + 1
            out = part[:n] if out is None else _paired(out[:n], part[:n])
            done += width
    return out


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (np.int64(b.max()) + 1 if len(b) else 1) + b, return_inverse=True)[1].astype(np.int64)


def repeats_of(doc, mark, start, count, strings, k: int) -> np.ndarray:
    """Rows (doc, mark, first, last) of runs of windows that equal an earlier window of these runs."""
    number: dict[bytes, int] = {}
    sizes = count.astype(np.int64) + k - 1
    ids = np.fromiter((number.setdefault(w, len(number)) for s in strings for w in s.split(b" ")),
                      np.int64, int(sizes.sum()))
    rank = window_ranks(ids, k)
    ends = np.cumsum(sizes)
    run = np.repeat(np.arange(len(sizes)), count)
    offset = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    at = (ends - sizes)[run] + offset
    rank, d, p = rank[at], doc[run], start[run].astype(np.int64) + offset
    order = np.lexsort((p, d, rank))
    r, d2, p2 = rank[order], d[order], p[order]
    new = np.append(True, r[1:] != r[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = np.zeros(len(order), bool)
    later[order] = (d2 != d2[lead]) | (p2 != p2[lead])
    hit = np.flatnonzero(later)
    if not len(hit):
        return np.zeros((0, 4), np.int64)
    cut = np.flatnonzero((np.diff(hit) != 1) | (run[hit[1:]] != run[hit[:-1]])) + 1
    a, z = hit[np.append(0, cut)], hit[np.append(cut, len(hit)) - 1]
    return np.stack([d[a], mark[run[a]].astype(np.int64), p[a], p[z]], 1)


def repeated_windows(packed: DataFrame, k: int = K) -> DataFrame:
    """Ranges of window starts that equal an earlier window, by document."""

    def batch(rows):
        rows = np.asarray(rows, np.int64).reshape(-1, 4)
        return pa.table({"doc": rows[:, 0], "mark": rows[:, 1].astype(np.int32), "first": rows[:, 2],
                         "last": rows[:, 3]})

    def count(payloads):
        import zstandard
        unzip = zstandard.ZstdDecompressor()
        parts = [_unpack(unzip.decompress(p)) for p in payloads.column("payload").to_pylist()]
        out = [p[5] for p in parts]
        low, doc, mark, start, n = (np.concatenate([p[i] for p in parts]) for i in range(5))
        where = np.concatenate([np.stack([np.full(len(p[0]), i), np.arange(len(p[0]))], 1)
                                for i, p in enumerate(parts)])
        if len(low):
            _, group, times = np.unique(low, return_inverse=True, return_counts=True)
            many = np.flatnonzero(times[group] > 1)
            many = many[np.argsort(group[many], kind="stable")]
            if len(many):
                # whole minimisers together, about CHUNK_WORDS words at a time
                sizes = np.cumsum(n[many].astype(np.int64) + k - 1)
                new = np.append(True, np.diff(group[many]) != 0)
                head = np.flatnonzero(new)
                chunk = (sizes[head] // CHUNK_WORDS)[np.cumsum(new) - 1]
                for part in np.split(many, np.flatnonzero(np.diff(chunk)) + 1):
                    strings = [parts[a][6][b] for a, b in where[part].tolist()]
                    out.append(repeats_of(doc[part], mark[part], start[part], n[part], strings, k))
        return batch(np.concatenate(out))

    return packed.groupBy("bucket").applyInArrow(count, RANGES)


def remove_repeats(docs: DataFrame, k: int = K, m: int = M, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each document without its words in repeated windows.

    ``kept`` holds the words that stay, joined by one space.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"),
                        (F.xxhash64("text") % (1 << 31)).cast("int").alias("mark"),
                        F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packed = packed_runs(texts.select("doc", "mark", "text"), max(1, -(-total // bucket_bytes)), k, m)
    spans = repeated_windows(packed, k).groupBy("doc", "mark").agg(
        F.collect_list(F.struct("first", "last")).alias("spans"))
    joined = texts.join(spans, ["doc", "mark"], "left").select("doc_id", "text", "spans")

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512).to_pylist()
                out = [[], [], [], []]
                for row in rows:
                    ws = (row["text"] or "").encode().split()
                    n = len(ws)
                    if row["spans"]:
                        change = np.zeros(n + 1, np.int64)
                        np.add.at(change, [s["first"] for s in row["spans"]], 1)
                        np.add.at(change, [s["last"] + k for s in row["spans"]], -1)
                        ws = [w for w, c in zip(ws, np.cumsum(change).tolist()) if not c]
                    for x, y in zip(out, (row["doc_id"], n, n - len(ws), b" ".join(ws).decode())):
                        x.append(y)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                     pa.array(out[3], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
