"""Near-duplicate classes by improved consistent weighted sampling (ICWS).

1. Weights.  A document is the weighted set of its five-word shingles: how often a shingle
   occurs, times an inverse document frequency.  The frequency of a shingle
   itself would push down just the text that copies share, so it is taken from the words:
   1 + the mean over its words of ln((1 + N) / (1 + df)) / ln(1 + N).  Document
   frequencies cover all documents, in a table of ``DF_BUCKETS`` hashed counts (a fixed size).
2. Samples.  ICWS draws ``BANDS * ROWS`` shingles per document so that two documents draw
   the same with the probability of their weighted Jaccard similarity.
3. Bands.  Texts that agree on all samples of a band meet in a bucket.  A first pass takes copies
   together cheaply: each text is paired with the first one of its bucket and the ones just before it (pairs grow with the
   texts, not with their square; buckets are dealt to ``SALT`` parts, whose first texts then meet), and of
   these pairs the one with a text's least partner is verified.
4. Verification.  A pair counts if its weighted Jaccard similarity, computed from the whole
   texts, is at least ``THRESHOLD``.  A partner's text
   travels once per pair and the shared one once per ``GROUP`` pairs.
5. The rest, without a cap.  In every bucket that still holds two classes, all pairs of texts of different classes
   are looked at (:func:`settled`), each in the first band it shares.  A pair can only reach the threshold if it
   shares one of the rarest shingles that make up 1 - ``THRESHOLD`` of each text's weight, so texts of
   one template, whose shared part is common in the bucket, are not compared one by one.  Only links that
   join two classes leave a task.  Buckets of over ``BLOCK`` bytes of text are cut into parts, and each pair of
   parts is a task's work; this costs a copy of the bucket per part, for buckets of several classes only.
6. Classes are the connected components of the verified pairs; equal texts are one vertex.

At similarity 0.8 a pair misses all bands with probability (1 - 0.8^3)^12 = 0.0002.

Defined cases: a text of one to four words is one shingle; texts without words (and null) are
equal to each other only if the text is equal (null counts as ''); a null ``doc_id`` counts as
the largest long when the class id, the least ``doc_id`` of the class, is found; repeated rows
share their class; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import fresh, pin

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 3
DF_BUCKETS = 1 << 18
SALT = 32
BEFORE = 2
GROUP = 256
BLOCK = 8 << 20
#: Pairs that agree on a smaller share of the samples are not computed: at similarity 0.8,
#: 36 samples fall below with probability under 0.00001.
LEAST_AGREE = 0.5
NULL_ID = (1 << 63) - 1
CHUNK_WORDS = 50_000
REMEMBER = 120_000


class _Hashes(dict):
    def __missing__(self, word):
        import xxhash
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_KNOWN = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gamma_table(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x)."""
    p, low, high = (np.arange(n) + 0.5) / n, np.zeros(n), np.full(n, 40.0)
    for _ in range(60):
        x = (low + high) / 2
        under = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(under, x, low), np.where(under, high, x)
    return (low + high) / 2


def word_hashes(split: list[list[bytes]]) -> np.ndarray:
    if len(_KNOWN) > REMEMBER:
        _KNOWN.clear()
    flat = [w for ws in split for w in ws]
    return np.fromiter(map(_KNOWN.__getitem__, flat), np.uint64, len(flat))


def weighted_sets(split: list[list[bytes]], idf: np.ndarray):
    """The distinct shingles of each text: (text number, shingle hash, weight), sorted."""
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    short = (sizes > 0) & (sizes < SHINGLE)
    if short.any():  # pad to one shingle
        split = [ws + [b""] * (SHINGLE - len(ws)) if s else ws for ws, s in zip(split, short.tolist())]
        sizes = np.where(short, SHINGLE, sizes)
    h = word_hashes(split)
    n = max(0, len(h) - SHINGLE + 1)
    word_idf = idf[(h & np.uint64(DF_BUCKETS - 1)).astype(np.int64)]
    s, w = np.zeros(n, np.uint64), np.zeros(n)
    for j in range(SHINGLE):
        s = mix(s * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n])
        w += word_idf[j:j + n]
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(split)), sizes)[:n]
    there = np.arange(n) + SHINGLE <= ends[doc]
    doc, s, w = doc[there], s[there], 1 + w[there] / SHINGLE
    order = np.lexsort((s, doc))
    doc, s, w = doc[order], s[order], w[order]
    first = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (doc[1:] != doc[:-1]))) if len(s) else order
    times = np.diff(np.append(first, len(s)))
    return doc[first], s[first], w[first] * times


def samples(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, draws: int, tables) -> np.ndarray:
    """(texts with shingles, draws): the identity of each consistent weighted sample."""
    gamma, log_gamma = tables
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    log_weight = np.log(weight).astype(np.float32)
    out = np.empty((len(starts), draws), np.float32)
    for k in range(draws):
        x = mix(shingle + np.uint64((k + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1))
        r = gamma[(x & np.uint64(0xFFFF)).astype(np.int64)]
        beta = (x >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(log_weight / r + beta)
        log_a = log_gamma[(x >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int64)] - r * (t - beta) - r
        out[:, k] = np.minimum.reduceat(log_a, starts)
    return out


def _chunks(batches, text: int):
    """(rows before the text as lists, words) of about CHUNK_WORDS words."""
    out, held = [[] for _ in range(text + 1)], 0
    for batch in batches:
        for i in range(batch.num_rows):
            for j in range(text):
                out[j].append(batch.column(j)[i].as_py())
            out[-1].append((batch.column(text)[i].as_py() or "").encode().split())
            held += len(out[-1][-1])
            if held > CHUNK_WORDS:
                yield out
                out, held = [[] for _ in range(text + 1)], 0
    if out[0] or out[-1]:
        yield out


def word_idf(docs: DataFrame) -> np.ndarray:
    """idf of each bucket of words, scaled to 0 ... 1, over all documents."""
    part = 1 << 12

    def count(batches):
        df, n = np.zeros(DF_BUCKETS, np.int64), 0
        for (split,) in _chunks(batches, 0):
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            doc = np.repeat(np.arange(len(split)), sizes)
            at = np.unique(doc * DF_BUCKETS + (word_hashes(split) & np.uint64(DF_BUCKETS - 1)).astype(np.int64))
            df += np.bincount(at % DF_BUCKETS, minlength=DF_BUCKETS)
            n += len(split)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, DF_BUCKETS // part), pa.int64()),
                 pa.array([np.array([n], "<i8").tobytes(),
                           *(x.astype("<i8").tobytes() for x in df.reshape(-1, part))], pa.binary())],
                names=["slice", "df"])

    def add(key, rows):
        total = sum(np.frombuffer(x, "<i8") for x in rows["df"].to_pylist())
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()),
                         "df": pa.array([total.astype("<i8").tobytes()], pa.binary())})

    kind = "slice long, df binary"
    rows = docs.select("text").mapInArrow(count, kind).groupBy("slice").applyInArrow(add, kind).collect()
    found = {r["slice"]: np.frombuffer(r["df"], "<i8") for r in rows}
    n = int(found[-1][0]) if found else 0
    df = np.concatenate([found[i] for i in range(DF_BUCKETS // part)]) if found else np.zeros(DF_BUCKETS)
    return np.log((1 + n) / (1 + df)) / np.log(2 + n)


def signatures(texts: DataFrame, idf) -> DataFrame:
    """(doc, vertex, samples) of every row; a text without words has no samples."""
    draws = BANDS * ROWS

    def work(batches):
        gamma = _gamma_table()
        tables = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
        for docs, vertices, split in _chunks(batches, 2):
            out: list = [None] * len(docs)
            doc, shingle, weight = weighted_sets(split, idf.value)
            if len(doc):
                drawn = samples(doc, shingle, weight, draws, tables)
                for i, row in zip(np.unique(doc).tolist(), drawn):
                    out[i] = row.astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(vertices, pa.binary()), pa.array(out, pa.binary())],
                names=["doc", "vertex", "samples"])

    return texts.select("doc", "vertex", "text").mapInArrow(work, "doc long, vertex binary, samples binary")


def _near(keys: DataFrame, by: list[str], before: int) -> DataFrame:
    """Pairs (a, b) within groups sorted by vertex: each text with the group's first and the ones before it."""
    spread = keys.repartition(*by).sortWithinPartitions(*by, "vertex")
    n = len(by)

    def pair(batches):
        group, first, held = None, None, []
        for batch in batches:
            out = []
            cols = [c.to_pylist() for c in batch.columns]
            for row in zip(*cols):
                if row[:n] != group:
                    group, first, held = row[:n], row, []
                else:
                    for other in ([first] if first not in held else []) + held:
                        out.append((other[n], row[n], other[n + 1], row[n + 1]))
                held = [*held, row][-before:]
            if out:
                a = np.frombuffer(b"".join(x[2] for x in out), np.uint8).reshape(len(out), -1)
                b = np.frombuffer(b"".join(x[3] for x in out), np.uint8).reshape(len(out), -1)
                out = [x for x, agree in zip(out, (a == b).mean(1).tolist()) if agree >= LEAST_AGREE]
            yield pa.RecordBatch.from_arrays([pa.array([min(x[:2]) for x in out], pa.binary()),
                                              pa.array([max(x[:2]) for x in out], pa.binary())],
                                             names=["a", "b"])

    return spread.mapInArrow(pair, "a binary, b binary")


def buckets(texts: DataFrame) -> DataFrame:
    """(key, band, vertex, mark, salt): the texts of each bucket; a byte of ``mark`` stands for each sample."""

    def bands(batches):
        import xxhash
        for batch in batches:
            keys, numbers, vertices, marks = [], [], [], []
            for vertex, drawn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bits = np.frombuffer(drawn, "<u4")
                mark = mix(bits.astype(np.uint64)).astype(np.uint8).tobytes()
                for b in range(BANDS):
                    keys.append(xxhash.xxh3_64_intdigest(drawn[4 * ROWS * b:4 * ROWS * (b + 1)], b) - (1 << 63))
                    numbers.append(b)
                    vertices.append(vertex)
                    marks.append(mark)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(numbers, pa.int32()),
                                              pa.array(vertices, pa.binary()), pa.array(marks, pa.binary())],
                                             names=["key", "band", "vertex", "mark"])

    keyed = texts.filter("samples is not null").select("vertex", "samples").mapInArrow(
        bands, "key long, band int, vertex binary, mark binary")
    return keyed.withColumn("salt", F.pmod(F.xxhash64("vertex"), F.lit(SALT)))


def candidates(salted: DataFrame) -> DataFrame:
    """Distinct pairs of neighbours in a bucket that agree on enough samples."""
    inside = _near(salted.select("key", "salt", "vertex", "mark"), ["key", "salt"], BEFORE)
    firsts = salted.groupBy("key", "salt").agg(F.min(F.struct("vertex", "mark")).alias("x")).select(
        "key", "x.vertex", "x.mark")
    return inside.unionAll(_near(firsts, ["key"], BEFORE)).distinct()


def verified(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """The pairs whose weighted Jaccard similarity is at least THRESHOLD, from the whole texts."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    dealt = pairs.join(sizes, "a").withColumn("g", F.pmod(F.xxhash64("b"), F.col("groups")))
    shared = dealt.select("a", "g").distinct().join(texts.withColumnRenamed("vertex", "a"), "a").select(
        "a", "g", F.lit(None).cast("binary").alias("b"), "text")
    others = dealt.select("a", "g", "b").join(texts.withColumnRenamed("vertex", "b"), "b").select(
        "a", "g", "b", "text")
    rows = shared.unionAll(others).repartition("a", "g").sortWithinPartitions("a", "g", F.col("b").asc_nulls_first())

    def check(batches):
        mine = None
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                split = [(t or "").encode().split() for t in part.column(3).to_pylist()]
                doc, shingle, weight = weighted_sets(split, idf.value)
                cut = np.searchsorted(doc, np.arange(len(split) + 1))
                for i, (a, b) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist())):
                    s, w = shingle[cut[i]:cut[i + 1]], weight[cut[i]:cut[i + 1]]
                    if b is None:
                        mine = s, w
                        continue
                    _, x, y = np.intersect1d(mine[0], s, assume_unique=True, return_indices=True)
                    both = float(np.minimum(mine[1][x], w[y]).sum())
                    if both >= THRESHOLD * (float(mine[1].sum() + w.sum()) - both) - 1e-9:
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()),
                                              pa.array([x[1] for x in out], pa.binary())], names=["a", "b"])

    return rows.mapInArrow(check, "a binary, b binary")


def _linked(sets, comp: np.ndarray, side: np.ndarray, drawn: np.ndarray, band: int) -> list[tuple[int, int]]:
    """Pairs of texts that reach the threshold and join two classes, over all pairs of one block.

    ``sets`` holds each text's (shingles, weights), ``comp`` its class, ``side`` its part (-1: all pairs count, else
    only those of different parts), ``drawn`` its samples.  Pairs that share a band before ``band`` are left to that.
    """
    sizes = np.array([len(s) for s, _ in sets])
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sets)), sizes)
    weight = np.concatenate([w for _, w in sets])
    _, ids, times = np.unique(np.concatenate([s for s, _ in sets]), return_inverse=True, return_counts=True)
    total = np.bincount(doc, weight, len(sets))
    # the rarest shingles first; those from which on the rest of the text still weighs enough
    order = np.lexsort((ids, times[ids], doc))
    before = np.cumsum(weight[order]) - weight[order]
    after = total[doc[order]] - (before - before[starts][doc[order]])
    head = order[(after >= THRESHOLD * total[doc[order]] - 1e-6) & (times[ids[order]] > 1)]
    head = head[np.lexsort((doc[head], ids[head]))]
    begin = np.searchsorted(ids[head], ids[head])
    mine = np.argsort(doc[head], kind="stable")
    cut = np.searchsorted(doc[head][mine], np.arange(len(sets) + 1))
    holders, bands = doc[head], drawn.reshape(len(sets), BANDS, ROWS)
    seen, own, out = np.zeros(len(sets), bool), np.zeros(len(times)), []
    for d in range(1, len(sets)):
        seen[:d] = False
        for at in mine[cut[d]:cut[d + 1]].tolist():
            seen[holders[begin[at]:at]] = True
        near = np.flatnonzero(seen[:d])
        near = near[(comp[near] != comp[d]) & ((side[near] != side[d]) | (side[near] < 0))]
        near = near[np.minimum(total[near], total[d]) >= THRESHOLD * np.maximum(total[near], total[d]) - 1e-6]
        near = near[(bands[near] == bands[d]).all(2).argmax(1) == band]
        if not len(near):
            continue
        place = slice(starts[d], starts[d] + sizes[d])
        own[ids[place]] = weight[place]
        for c0 in range(0, len(near), 256):
            some = near[c0:c0 + 256]
            some = some[comp[some] != comp[d]]
            if not len(some):
                continue
            ends = np.cumsum(sizes[some])
            at = np.arange(ends[-1]) + np.repeat(starts[some] - (ends - sizes[some]), sizes[some])
            both = np.add.reduceat(np.minimum(own[ids[at]], weight[at]), ends - sizes[some])
            for c in some[both >= THRESHOLD * (total[some] + total[d] - both) - 1e-9].tolist():
                if comp[c] != comp[d]:
                    out.append((c, d))
                    comp[comp == comp[c]] = comp[d]
        own[ids[place]] = 0
    return out


def settled(salted: DataFrame, labels: DataFrame, bodies: DataFrame, idf) -> DataFrame:
    """Links (a, b) that join classes, over all pairs of every bucket that holds more than one class."""
    rows = salted.join(several(salted), "key", "left_semi").join(labels, "vertex", "left").select(
        "key", "band", "vertex", F.coalesce("label", "vertex").alias("label"))
    rows = rows.join(bodies.select("vertex", F.octet_length("text").alias("n")), "vertex")
    # of buckets with the same texts, that of the first band
    mixed = (rows.groupBy("key", "band").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.sum("n") / BLOCK).alias("parts"),
        F.count("*").alias("c"), F.bit_xor(F.xxhash64("vertex")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "vertex")).alias("y"))
        .filter("low < high").groupBy("c", "x", "y").agg(F.min(F.struct("band", "key", "parts")).alias("m"))
        .select("m.key", F.greatest("m.parts", F.lit(1)).alias("parts")))
    part = F.pmod(F.xxhash64("vertex"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    dealt = rows.join(mixed, "key").select("key", "band", "vertex", "label", part.alias("part"), other).select(
        "key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "band", "part", "vertex",
        "label")
    work = dealt.join(bodies, "vertex").select("key", "p", "q", "band", "part", "vertex", "samples", "label", "text")

    def links(held):
        if len({x[4] for x in held}) < 2:
            return []
        names = {x[4]: i for i, x in enumerate(held)}
        _, p, q = held[0][0]
        pairs = _linked([x[5] for x in held], np.array([names[x[4]] for x in held]),
                        np.array([x[1] if p != q else -1 for x in held]),
                        np.frombuffer(b"".join(x[3] for x in held), "<u4").reshape(len(held), -1), held[0][6])
        return [tuple(sorted((held[i][2], held[j][2]))) for i, j in pairs]

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()),
                                           pa.array([x[1] for x in out], pa.binary())], names=["a", "b"])

    def check(batches):
        held: list = []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                key, p, q, band, part, vertex, drawn, label, text = [c.to_pylist() for c in batch.slice(at, 64).columns]
                split = [(t or "").encode().split() for t in text]
                doc, shingle, weight = weighted_sets(split, idf.value)
                cut = np.searchsorted(doc, np.arange(len(split) + 1))
                for i in range(len(split)):
                    group = key[i], p[i], q[i]
                    if held and held[0][0] != group:
                        yield batch_of(links(held))
                        held = []
                    own = shingle[cut[i]:cut[i + 1]].copy(), weight[cut[i]:cut[i + 1]].copy()
                    held.append((group, part[i], vertex[i], drawn[i], label[i], own, band[i]))
        yield batch_of(links(held))

    return work.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(check, "a binary, b binary")


def several(salted: DataFrame) -> DataFrame:
    """The keys of buckets with at least two texts."""
    return salted.groupBy("key").agg(F.min("vertex").alias("low"), F.max("vertex").alias("high")).filter(
        "low < high").select("key")


def components(links: DataFrame) -> DataFrame:
    """(vertex, label): the least vertex that each linked vertex reaches.

    Each round takes the least label among the neighbours, then the label's own label, so that
    long chains shorten by jumps.
    """
    both = pin(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "icws_links")
    labels = pin(both.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("x"))
                 .select("vertex", F.least("vertex", "x").alias("label")), "icws_labels")
    while True:
        known = labels.select(F.col("vertex").alias("b"), "label")
        least = both.join(known, "b").groupBy(F.col("a").alias("vertex")).agg(F.min("label").alias("near"))
        step = labels.join(least, "vertex").select("vertex", F.least("label", "near").alias("mid"),
                                                   F.col("label").alias("old"))
        jump = labels.select(F.col("vertex").alias("mid"), F.col("label").alias("far"))
        new = pin(step.join(jump, "mid").select("vertex", F.least("mid", "far").alias("label"), "old"), "icws_labels")
        if new.filter(F.col("label") != F.col("old")).isEmpty():
            return new.select("vertex", "label")
        labels = new.select("vertex", "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, vertex, label, class_id, class_size): the class of every row of ``docs``.

    ``vertex`` is the MD5 digest of the text, ``label`` the least vertex of the class; rows with equal ``doc_id`` and ``vertex`` are the same.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("vertex", F.unhex(F.md5("text")))
    idf = spark.sparkContext.broadcast(word_idf(texts))
    drawn = pin(signatures(texts, idf), "icws_samples")
    vertices = drawn.groupBy("vertex").agg(F.min("doc").alias("doc"), F.first("samples").alias("samples"))
    salted = pin(buckets(vertices), "icws_buckets")
    pairs = pin(candidates(salted), "icws_pairs")
    ends = salted.join(several(salted), "key", "left_semi").select("vertex").distinct()
    need = drawn.join(ends, "vertex", "left_semi").groupBy("vertex").agg(
        F.min("doc").alias("doc"), F.first("samples").alias("samples"))
    bodies = pin(texts.join(need, ["vertex", "doc"]).select("vertex", "text", "samples").dropDuplicates(["vertex"]),
                 "icws_texts")
    least = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = pin(verified(least, bodies, idf), "icws_verified")
    labels = components(links)
    more = pin(settled(salted, labels, bodies, idf), "icws_verified")
    if not more.isEmpty():
        labels = components(links.unionAll(more))
    member = drawn.select("doc", "vertex").join(labels, "vertex", "left").select(
        "doc", "vertex", F.coalesce("label", "vertex").alias("label"))
    classes = member.groupBy("label").agg(F.min("doc").alias("class_id"), F.count("*").alias("class_size"))
    return member.join(classes, "label").select(
        F.when(F.col("doc") < NULL_ID, F.col("doc")).alias("doc_id"), "vertex", "label", "class_id", "class_size")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row with the least doc_id (null
    counts as the largest), and of rows alike in id and text any one."""
    found = near_duplicates(docs)
    least = found.groupBy("label").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), "vertex")).alias("x"))
    doc, vertex = fresh(docs, "_doc"), fresh(docs, "_vertex")
    stay = least.select(F.col("x.doc").alias(doc), F.col("x.vertex").alias(vertex))
    keyed = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn(
        vertex, F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    return keyed.join(stay, [doc, vertex], "left_semi").dropDuplicates([doc, vertex]).select(*docs.columns)
