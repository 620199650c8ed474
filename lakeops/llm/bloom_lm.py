"""Language-model scores from a log-frequency Bloom filter, kept in slices that follow the input.

Gathering.  A task cuts its documents into chunks of whole texts and sends each chunk's distinct words and
word pairs to slices of the hash space, with their counts over the training texts among them.  The number of slices follows the
size of the input, so a slice stays a bounded task.  A slice adds the counts up exactly and
builds its filter: an n-gram with count c enters as (n-gram, 1) ... (n-gram, q(c)), q(c) = 1 + floor(log2 c), so
rare n-grams cost few bits.  The filter is as large as its entries need (``BITS_PER_ENTRY`` for each); no n-gram is left out.

Probing.  q is read back by probing (n-gram, 1), (n-gram, 2), ... until one is missing; the count is
taken as the mean of the counts with that q.  A filter of all n-grams grows with the input and so is not broadcast: the
chunks' n-grams, which are at the slice already, are probed there, and the answers go back to the chunk.

Scoring.  A second pass over the documents cuts the same chunks and takes their answers.  With V words, N tokens
and pseudo count s:  P(w) = (c(w) + 1) / (N + V + 1),  P(w | v) = (min(c(vw), c(v)) + s * P(w)) / (c(v) + s); the
end of a text is a token and the history of the first word.  The exact base score takes the words' exact
counts, which travel beside the answers (words are sent as they are, pairs by a 64-bit hash).

The passes must see the same partitions; a chunk's checksum travels with it, and a chunk whose answers are
not there raises an error (write such documents to a table first).

Defined cases: a null or empty text is the end token alone; null and repeated ``doc_id`` and
repeated rows are scored row by row (a null id counts as training data); an empty table
gives an empty result; without training tokens N = V = 0 and all counts are 0; further
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.llm.common import file_system
from lakeops.session import shared_dir

#: Bytes of text for each slice.
SLICE_BYTES = 16 << 20
HASHES = 6
#: Bits for each entry at which a filter with HASHES hashes errs about once in 270 probes.
BITS_PER_ENTRY = 12
PSEUDO = 8.0
HELD_OUT = (7, 2)
CHUNK_WORDS = 400_000
END = b"\n"  # no word holds white space
#: The part under which the slices' own rows (filter, sizes) are kept beside the chunks' answers.
MODEL = -1

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_PRINT = np.uint64((1 << 40) - 1)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

SENT = "slice long, part long, chunk long, crc long, words binary, wcounts binary, pairs binary, pcounts binary"
ANSWERS = ("part long, slice long, chunk long, crc long, wq binary, wcounts binary, pq binary, bits binary, tokens long, "
           "distinct long")


def tokens(text: str | None) -> list[bytes]:
    """A-Z in lower case; the words, then one end."""
    out = (text or "").encode().translate(_LOWER).split()
    out.append(END)
    return out


def hashes_of(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def quantised(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c), 0 for 0."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def count_of(q: np.ndarray) -> np.ndarray:
    """Mean of the counts with this q: 2^(q-1) ... 2^q - 1."""
    return np.where(q > 0, (2.0 ** (q.astype(np.float64) - 1) + 2.0 ** q - 1) / 2, 0.0)


class Filter:
    """A slice's filter: a bit for each place, as many as the entries need."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, grams: np.ndarray, counts: np.ndarray) -> Filter:
        there = counts > 0
        grams, q = grams[there], quantised(counts[there])
        out = cls(np.zeros(max(64, 8 * -(-int(q.sum()) * BITS_PER_ENTRY // 8)), bool))
        level = 1
        while len(grams):
            for place in out.places(grams, level):
                out.bits[place] = True
            more = q > level
            grams, q, level = grams[more], q[more], level + 1
        return out

    def places(self, grams: np.ndarray, level: int):
        """Places for (n-gram, level)."""
        x = mix(grams + np.uint64(level * int(_C) & (1 << 64) - 1))
        step = (x >> np.uint64(32)) | np.uint64(1)
        for i in range(HASHES):
            yield ((x + np.uint64(i) * step) & np.uint64(0xFFFFFFFF)) % np.uint64(len(self.bits))

    def probe(self, grams: np.ndarray) -> np.ndarray:
        """q of each n-gram: the last level that is there."""
        q = np.zeros(len(grams), np.uint8)
        left, level = np.arange(len(grams)), 1
        while len(left) and level < 64:
            x = grams[left]
            there = np.ones(len(left), bool)
            for place in self.places(x, level):
                there &= self.bits[place]
            left = left[there]
            q[left] = level
            level += 1
        return q

    def packed(self) -> bytes:
        return np.packbits(self.bits, bitorder="little").tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Filter:
        return cls(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").astype(bool))


class Chunk:
    """Whole texts with their tokens numbered and their distinct n-grams dealt to slices."""

    def __init__(self, texts: list[list[bytes]], slices: int):
        numbers = defaultdict(count().__next__)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        total = int(self.sizes.sum())
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.word = np.fromiter((numbers[w] for t in texts for w in t), np.int64, total)
        self.words = list(numbers)
        h = hashes_of(self.words)
        hashes = h[self.word]
        before = np.empty_like(hashes)
        before[1:] = hashes[:-1]
        before[self.starts] = hashes_of([END])[0]
        self.before_word = np.empty_like(self.word)
        self.before_word[1:] = self.word[:-1]
        self.before_word[self.starts] = numbers[END]
        self.pairs, self.pair = np.unique(mix(before * _C + hashes), return_inverse=True)
        self.crc = zlib.crc32(self.sizes.tobytes(), zlib.crc32(hashes.tobytes()))
        self.by_slice = [_dealt(mix(h ^ _B), slices), _dealt(self.pairs, slices)]

    def counted(self, trains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the distinct words and pairs over the texts that train."""
        mask = np.repeat(trains, self.sizes)
        return (np.bincount(self.word[mask], minlength=len(self.words)),
                np.bincount(self.pair[mask], minlength=len(self.pairs)))


def _dealt(keys: np.ndarray, slices: int) -> dict[int, np.ndarray]:
    """The places of the n-grams of each slice, in order."""
    slice_ = (keys >> np.uint64(40)) % np.uint64(slices)
    order = np.argsort(slice_, kind="stable")
    ids, first = np.unique(slice_[order], return_index=True)
    return dict(zip(ids.tolist(), np.split(order, first[1:])))


_NONE = np.zeros(0, np.int64)


def _prints(pairs: np.ndarray) -> bytes:
    p = pairs & _PRINT
    return p.astype("<u4").tobytes() + (p >> np.uint64(32)).astype(np.uint8).tobytes()


def _unprinted(data: bytes) -> np.ndarray:
    n = len(data) // 5
    return np.frombuffer(data, "<u4", n).astype(np.uint64) | (np.frombuffer(data, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32))


def _packed_counts(counts: np.ndarray) -> bytes:
    """A byte for each count, then 8 bytes for each that is 255 or more."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def _unpacked_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", offset=n)
    return out


def _chunks(batches):
    """(ids, flags, tokens of each text) of about CHUNK_WORDS words, in the partition's order."""
    out, held = ([], [], []), 0
    for batch in batches:
        for doc, flag, text in zip(*(c for c in batch.columns)):
            ts = tokens(text.as_py())
            for column, x in zip(out, (doc.as_py(), flag.as_py(), ts)):
                column.append(x)
            held += len(ts)
            if held > CHUNK_WORDS:
                yield out
                out, held = ([], [], []), 0
    if out[0]:
        yield out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


@dataclass
class Model:
    """Where the slices' filters and the chunks' answers are, and N and V of the training texts."""

    path: str
    slices: int
    tokens: int
    distinct: int

    def filters(self, spark: SparkSession) -> DataFrame:
        """slice, bits, tokens and distinct words of each slice."""
        return spark.read.schema(ANSWERS).parquet(self.path).filter(F.col("part") == MODEL).select("slice", "bits", "tokens", "distinct")


def gather(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> Model:
    """Count, build the filters and answer every chunk of ``docs`` (columns doc_id, held_out, text)."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = 1 + total // slice_bytes
    sent, answers = _arrow(SENT), _arrow(ANSWERS)

    def send(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        for number, (_, held, texts) in enumerate(_chunks(batches)):
            chunk = Chunk(texts, slices)
            wcounts, pcounts = chunk.counted(~np.array(held, bool))
            words_of, pairs_of = chunk.by_slice
            yield _batch([(s, part, number, chunk.crc, b" ".join([chunk.words[i] for i in words_of.get(s, _NONE).tolist()]),
                           _packed_counts(wcounts[words_of.get(s, _NONE)]), _prints(chunk.pairs[pairs_of.get(s, _NONE)]),
                           _packed_counts(pcounts[pairs_of.get(s, _NONE)])) for s in sorted({*words_of, *pairs_of})], sent)

    def answer(key, rows):
        words = [w.split(b" ") if w else [] for w in rows["words"].to_pylist()]
        wcounts = [_unpacked_counts(c, len(w)) for c, w in zip(rows["wcounts"].to_pylist(), words)]
        # words: exact counts
        numbers = defaultdict(count().__next__)
        at = np.fromiter((numbers[w] for ws in words for w in ws), np.int64, sum(map(len, words)))
        exact = np.zeros(len(numbers), np.int64)
        np.add.at(exact, at, np.concatenate([*wcounts, _NONE]))
        # pairs
        prints = [_unprinted(p) for p in rows["pairs"].to_pylist()]
        pcounts = [_unpacked_counts(c, len(p)) for c, p in zip(rows["pcounts"].to_pylist(), prints)]
        pairs, pat = np.unique(np.concatenate([*prints, np.zeros(0, np.uint64)]), return_inverse=True)
        added = np.zeros(len(pairs), np.int64)
        np.add.at(added, pat, np.concatenate([*pcounts, _NONE]))
        # words and pairs share the filter; the words' top bit keeps them apart
        grams = np.concatenate([hashes_of(list(numbers)) | np.uint64(1 << 63), pairs])
        filter_ = Filter.of(grams, np.concatenate([exact, added]))
        q = filter_.probe(grams)
        wq, pq = q[:len(exact)][at], q[len(exact):][pat]
        wends, pends = np.cumsum([len(w) for w in words]), np.cumsum([len(p) for p in prints])
        out = [(part, key[0].as_py(), chunk, crc, wq[we - len(w):we].tobytes(), exact[at[we - len(w):we]].astype("<i8").tobytes(),
                pq[pe - len(p):pe].tobytes(), None, None, None)
               for part, chunk, crc, w, we, p, pe in zip(rows["part"].to_pylist(), rows["chunk"].to_pylist(), rows["crc"].to_pylist(),
                                                         words, wends.tolist(), prints, pends.tolist())]
        out.append((MODEL, key[0].as_py(), 0, 0, b"", b"", b"", filter_.packed(), int(exact.sum()), int((exact > 0).sum())))
        return pa.Table.from_batches([_batch(out, answers)])

    path = shared_dir(spark, "bloom_lm")
    made = _input(docs).mapInArrow(send, SENT).groupBy("slice").applyInArrow(answer, ANSWERS)
    spread = F.when(F.col("part") == MODEL, F.col("slice")).otherwise(F.lit(0))
    made.repartition("part", spread).write.partitionBy("part").parquet(path)
    model = Model(path, slices, 0, 0)
    if total:
        n, v = model.filters(spark).agg(F.sum("tokens"), F.sum("distinct")).first()
        model = Model(path, slices, n or 0, v or 0)
    return model


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("held_out").cast("boolean").alias("held_out"),
                       F.col("text").cast("string").alias("text"))


def _answers(path: str, part: int) -> dict[int, list]:
    """By chunk: the rows (slice, crc, wq, wcounts, pq) of a partition's answers."""
    import pyarrow.dataset as ds
    files, folder = file_system(path)
    table = ds.dataset(f"{folder}/part={part}", filesystem=files, format="parquet").to_table(
        columns=["chunk", "slice", "crc", "wq", "wcounts", "pq"])
    out = defaultdict(list)
    for chunk, *row in zip(*(c.to_pylist() for c in table.columns)):
        out[chunk].append(row)
    return out


def score(docs: DataFrame, model: Model, pseudo: float = PSEUDO) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of the ``docs`` given to :func:`gather`."""
    n, v, slices, path = model.tokens, model.distinct, model.slices, model.path
    norm = math.log10(n + v + 1)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

    def work(batches):
        from pyspark import TaskContext
        part, answers = TaskContext.get().partitionId(), None
        for number, (ids, held, texts) in enumerate(_chunks(batches)):
            answers = _answers(path, part) if answers is None else answers
            chunk = Chunk(texts, slices)
            wq, exact, pq = np.zeros(len(chunk.words), np.uint8), np.zeros(len(chunk.words), np.int64), np.zeros(len(chunk.pairs), np.uint8)
            words_of, pairs_of = chunk.by_slice
            rows = answers.pop(number, [])
            if {r[0] for r in rows} != {*words_of, *pairs_of} or any(r[1] != chunk.crc for r in rows):
                raise ValueError(f"partition {part} has other documents than when its n-grams were gathered; write them to a table first")
            for s, _, q, c, p in rows:
                wq[words_of.get(s, _NONE)] = np.frombuffer(q, np.uint8)
                exact[words_of.get(s, _NONE)] = np.frombuffer(c, "<i8")
                pq[pairs_of.get(s, _NONE)] = np.frombuffer(p, np.uint8)
            unigram = count_of(wq)
            back = (unigram + 1) / (n + v + 1)
            history = unigram[chunk.before_word]
            joint = np.minimum(count_of(pq)[chunk.pair], history)
            logp = np.log10((joint + pseudo * back[chunk.word]) / (history + pseudo))
            base = np.log10(exact + 1.0)[chunk.word]
            known = (exact > 0)[chunk.word].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(chunk.sizes), pa.array(np.add.reduceat(known, chunk.starts)),
                 pa.array(np.add.reduceat(base, chunk.starts) - chunk.sizes * norm), pa.array(np.add.reduceat(logp, chunk.starts))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return (_input(docs).mapInArrow(work, schema).withColumn("train_tokens", F.lit(n).cast("long"))
            .select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"))


def held_out(doc_id: Column) -> Column:
    modulus, rest = HELD_OUT
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == rest, F.lit(False))


def score_corpus(docs: DataFrame, **options) -> DataFrame:
    """Train on the documents that are not held out, score all."""
    marked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return score(marked, gather(marked, **options))
