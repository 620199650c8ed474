"""Language-model scores: the exact base against counting, the model on held-out text."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import docs, none, odd  # noqa: F401
from lakeops.llm import bloom_lm as B


def brute(data):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(t for d, x in data if not held(d) for t in B.tokens(x))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, x in data:
        ts = B.tokens(x)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts)
        out.append((d or -1, held(d), len(ts), sum(counts[t] > 0 for t in ts), n, round(base, 6)))
    return sorted(out)


def result(df):
    return sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                   round(r["base_score"], 6)) for r in df.collect())


def brute_score(data):
    """The smoothed model with counts taken as the mean of their power of two, without any filter."""
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    words, pairs = Counter(), Counter()
    for d, x in data:
        if not held(d):
            ts = B.tokens(x)
            words.update(ts)
            pairs.update(zip([B.END, *ts], ts))
    mean = lambda c: 0.0 if not c else (2 ** (c.bit_length() - 1) + 2 ** c.bit_length() - 1) / 2
    n, v = sum(words.values()), len(words)
    out = {}
    for d, x in data:
        ts = B.tokens(x)
        total = 0.0
        for before, t in zip([B.END, *ts], ts):
            history = mean(words[before])
            back = (mean(words[t]) + 1) / (n + v + 1)
            total += math.log10((min(mean(pairs[before, t]), history) + B.PSEUDO * back) / (history + B.PSEUDO))
        out[d] = total
    return out


@pytest.mark.parametrize("slice_bytes", [B.SLICE_BYTES, 20_000])
def test_base_is_exact_and_score_near_the_model_without_a_filter(docs, slice_bytes):
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = B.score_corpus(docs, slice_bytes=slice_bytes).cache()
    assert result(got) == brute(data)
    rows, want = got.collect(), brute_score(data)
    for r in rows:   # the filter reads some absent pairs as rare ones; nothing is left out, so it is never far off
        assert abs(r["score"] - want[r["doc_id"]]) < 0.05 * abs(want[r["doc_id"]]) + 1
    trained = [r for r in rows if not r["held_out"]]
    # about one count in 270 is read as twice as high, which moves a token by log10(2) of about 2.5 at most
    assert sum(abs(r["score"] - want[r["doc_id"]]) for r in trained) < 0.001 * sum(abs(want[r["doc_id"]]) for r in trained)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # pairs help on unseen text


def test_odd_rows(odd, none):
    assert result(B.score_corpus(odd)) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert B.score_corpus(none).count() == 0


def test_small_chunks_and_many_slices(docs, monkeypatch):
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    some = B.Chunk([B.tokens(x) for _, x in data], 50)
    for dealt, n in zip(some.by_slice, (len(some.words), len(some.pairs))):
        assert sorted(i for places in dealt.values() for i in places.tolist()) == list(range(n))
    assert result(B.score_corpus(docs.repartition(7, "doc_id").sortWithinPartitions("doc_id"), slice_bytes=3000)) == brute(data)


def test_other_documents_than_gathered_are_refused(spark, docs):
    marked = docs.select("doc_id", B.held_out(F.col("doc_id")).alias("held_out"), "text").coalesce(1)
    model = B.gather(marked)
    with pytest.raises(Exception, match="other documents"):
        B.score(marked.orderBy(F.desc("doc_id")).coalesce(1), model).collect()


def test_filter_gives_quantised_counts_back():
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(0, 2 ** 63, 40000).astype(np.uint64))
    counts = rng.zipf(1.6, len(grams)).clip(1, 10 ** 6)
    made = B.Filter.of(grams, counts)
    read = B.Filter.unpacked(made.packed()).probe(grams)
    want = B.quantised(counts)
    assert (read >= want).all() and (read == want).mean() > 0.99  # never too low, seldom too high
    assert (read - want).max() < 6
    absent = rng.integers(0, 2 ** 63, 40000).astype(np.uint64)
    assert (made.probe(absent) > 0).mean() < 0.006
    assert (B.quantised(np.array([0, 1, 2, 3, 4, 255, 256, 2 ** 40])) == [0, 1, 2, 2, 3, 8, 9, 41]).all()


def test_the_filter_grows_with_its_entries(spark, docs):
    """No n-gram is left out, and what is gathered grows with the input."""
    sizes = {}
    for part in (4, 1):
        marked = docs.filter(F.col("doc_id") % part == 0).select("doc_id", F.lit(False).alias("held_out"), "text")
        model = B.gather(marked)
        sizes[part] = model.filters(spark).agg(F.sum(F.octet_length("bits"))).first()[0]
        words = Counter(t for r in marked.collect() for t in B.tokens(r["text"]))
        assert (model.tokens, model.distinct) == (sum(words.values()), len(words))
    assert sizes[1] > 2.5 * sizes[4]


def test_counts_travel_exactly():
    counts = np.array([0, 1, 254, 255, 256, 2 ** 40, 3])
    assert (B._unpacked_counts(B._packed_counts(counts), 7) == counts).all()
    pairs = np.random.default_rng(3).integers(0, 2 ** 63, 100).astype(np.uint64)
    assert (B._unprinted(B._prints(pairs)) == (pairs & B._PRINT)).all()
