"""Substring deduplication against brute force over all windows."""

import numpy as np

from llm_fixtures import docs, none, odd  # noqa: F401
from lakeops.llm import superkmer as S


def brute(data, k):
    """(doc_id, text) -> words kept; null ids last, rows of one id judged on their own positions."""
    seen = {}
    rows = sorted(((S.NULL_ID if d is None else d), (t or "").encode().split()) for d, t in data)
    for d, ws in rows:
        for i in range(len(ws) - k + 1):
            key = tuple(ws[i:i + k])
            seen[key] = min(seen.get(key, (d, i)), (d, i))
    out = {}
    for d, t in data:
        ws = (t or "").encode().split()
        gone = set()
        for i in range(len(ws) - k + 1):
            if seen[tuple(ws[i:i + k])] < (S.NULL_ID if d is None else d, i):
                gone.update(range(i, i + k))
        out.setdefault(d, []).append((len(ws), len(gone), b" ".join(w for i, w in enumerate(ws) if i not in gone).decode()))
    return {d: sorted(x) for d, x in out.items()}


def result(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"], r["kept"]))
    return {d: sorted(x) for d, x in out.items()}


def test_documents(docs):
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], S.K)
    assert sum(x[0][1] for x in want.values()) > 100
    assert result(S.remove_repeats(docs, bucket_bytes=100_000)) == want


def test_short_windows_and_periodic_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_WORDS", 50)
    data = [(i, " ".join("ab"[(i * j * j + j // 3) % 2] for j in range(40))) for i in range(30)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert result(S.remove_repeats(df, k=5, m=2, bucket_bytes=300)) == brute(data, 5)


def test_odd_rows(odd, none):
    assert result(S.remove_repeats(odd)) == brute([(r["doc_id"], r["text"]) for r in odd.collect()], S.K)
    assert S.remove_repeats(none).count() == 0


def test_window_ranks():
    x = np.random.default_rng(1).integers(0, 3, 400)
    for k in (1, 2, 5, 7, 20):
        ranks = S.window_ranks(x, k)
        keys = [tuple(x[i:i + k]) for i in range(len(x) - k + 1)]
        assert len(ranks) == len(keys) and len(set(zip(ranks.tolist(), keys))) == len(set(keys)) == len(set(ranks.tolist()))
