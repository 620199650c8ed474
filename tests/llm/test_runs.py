"""Periodic runs against the definition, word by word."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from llm_fixtures import SF, none, odd  # noqa: F401
from lakeops.llm import runs as R
from lakeops.llm.queries import op11_runs


def brute(words):
    """Every stretch with smallest period q, by the definition: longest stretches of equal words q apart, least q each."""
    n, found = len(words), {}
    for q in range(n // 4, 0, -1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found[i, j + q - i] = q
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(a == b for a, b in zip(words, words[q:])))


def _random_texts(seed, many):
    rng = random.Random(seed)
    for _ in range(many):
        kind, n = rng.random(), rng.randint(0, 60)
        signs = "abc"[:rng.randint(1, 3)]
        if kind < 0.4:
            text = rng.choices(signs, k=n)
        else:
            text = []
            while len(text) < n:
                unit = rng.choices("abcdefgh", k=rng.randint(1, 9))
                length = rng.randint(1, 6 * len(unit))
                text += (unit * 7)[:length]
                if kind > 0.8 and rng.random() < 0.5:
                    text += text[-rng.randint(1, len(text)):]
        yield [w.encode() for w in text[:200]]


def test_runs_equal_the_definition():
    texts = list(_random_texts(1, 4000)) + [[b"x"] * n for n in range(12)] + [[b"x"] * 500, [b"x", b"y"] * 100, []]
    got = R.runs_of(texts)
    assert [brute(t) for t in texts] == got
    assert sum(map(len, got)) > 2000
    for t, runs in zip(texts, got):
        for start, length, q in runs:
            assert smallest_period(t[start:start + length]) == q
    assert [R.runs_of([t])[0] for t in texts[:300]] == got[:300]


def test_long_periods_and_long_texts():
    rng = random.Random(5)
    unit = [b"w%d" % rng.randrange(500) for _ in range(3000)]
    text = unit[:100] + unit * 5 + [b"end"] + [b"tick"] * 20_000 + unit[:50]
    runs = R.runs_of([text])[0]
    assert [r for r in runs if r[1] > 10_000] == long_runs(text, (3000, 1))
    fib = [[b"a"], [b"a", b"b"]]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    assert R.runs_of([fib[-1]])[0] == brute(fib[-1]) == []
    cubes = [w for w in fib[9] for _ in range(7)]
    assert R.runs_of([cubes])[0] == brute(cubes) != []


def long_runs(words, periods):
    out = {}
    for q in periods:
        same = np.array([a == b for a, b in zip(words, words[q:])])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], same, [0]])))
        out.update({(int(a), int(b - a + q)): q for a, b in zip(edges[::2], edges[1::2]) if b - a + q > 10_000})
    return sorted((s, n, q) for (s, n), q in out.items() if n >= 4 * q)


def test_suffix_order_and_prefixes():
    rng = random.Random(8)
    for _ in range(200):
        texts = [[rng.randint(1, 2) for _ in range(rng.randint(5, 40))] for _ in range(3)]
        w = np.array([0] * R.LEAST + sum((t + [0] * R.LEAST for t in texts), []))
        text = np.array([0] * R.LEAST + sum(([i] * (len(t) + R.LEAST) for i, t in enumerate(texts)), []))
        starts = np.array([i for i in range(len(w) - R.LEAST) if (w[i:i + R.LEAST] > 0).all()])
        suffix, lcp, first = R.suffixes(w, text, starts)
        tail = {p: w[p:p + next(k for k in range(len(w)) if w[p + k] == 0)].tolist() for p in suffix}
        keys = [(text[p], tail[p]) for p in suffix]
        assert keys == sorted(keys) and set(starts) <= set(suffix)
        for k in range(1, len(suffix)):
            a, b = tail[suffix[k - 1]], tail[suffix[k]]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == (same if same >= R.LEAST and text[suffix[k - 1]] == text[suffix[k]] else 0)


def _planted(doc_id, text):
    ws = (text or "").encode().split()
    if doc_id is not None and ws:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            n = len(ws)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    return ws


def _digest(doc_id, text):
    ws = _planted(doc_id, text)
    runs = R.runs_of([ws])[0] if len(ws) > 400 else brute(ws)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(ws) if i not in dropped)).hexdigest())


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = sorted(tuple(r) for r in op11_runs(spark, SF).collect())
    assert got == sorted(_digest(r["doc_id"], r["text"]) for r in rows)
    assert sum(r[1] > 0 for r in got) > 5


def test_odd_rows(spark, odd, none):
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    got = sorted((tuple(r) for r in R.digest(R.find_runs(R.planted(odd))).collect()), key=key)
    assert got == sorted((_digest(r["doc_id"], r["text"]) for r in odd.collect()), key=key)
    found = {r["doc_id"]: r for r in R.find_runs(odd).collect()}
    assert found[9]["runs"] == [(0, 300, 1)] and found[9]["collapsed"] == "x"
    assert found[1]["n_words"] == 0 and found[1]["runs"] == [] and found[1]["collapsed"] == ""
    assert R.digest(R.find_runs(none)).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r[1:] == (0, None, None, None, None, empty, empty) for r in got if r[0] in (1, 2, 3))
