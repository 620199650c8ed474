"""Quality rules: counts against brute force, and the estimate against planted outliers."""

import random
import re
from collections import Counter

import numpy as np

from llm_fixtures import docs, none, odd  # noqa: F401
from lakeops.llm import mcd as M


def brute(t):
    t = t or ""
    ws = re.findall("[^\x20\x09-\x0D]+", t)
    times = Counter(zip(ws, ws[1:], ws[2:]))
    covered = {j for i in range(len(ws) - 2) if times[tuple(ws[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def five(r):
    return r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]


def test_counts(spark, docs):
    random.seed(1)
    made = [(i, "".join(random.choice(["a ", "b ", "c\n", "#", "é", "\x0b", " ", "<a>"]) for _ in range(random.randint(0, 80))))
            for i in range(1000, 1400)]
    data = [(r["doc_id"], r["text"]) for r in docs.collect()] + made
    df = spark.createDataFrame([(*d, "x", "y") for d in data], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in M.counts(df).collect()}
    for d, t in data:
        want = brute(t)
        assert five(got[d]) == want
        assert got[d]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_outliers_go_and_clean_texts_stay(spark):
    random.seed(2)
    text = lambda n, width: " ".join("".join(random.choice("abcdefgh") for _ in range(random.randint(2, width))) for _ in range(n))
    clean = [(i, text(random.randint(60, 600), 9)) for i in range(400)]
    bad = [(1000 + i, " | ".join(text(100, 9).split())) for i in range(60)] + [(2000 + i, text(100, 90)) for i in range(40)]
    df = spark.createDataFrame([(*d, "en", "s") for d in clean + bad], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in M.judge(df).filter("kept").collect()}
    assert kept == {d for d, _ in clean}


def test_odd_rows(odd, none):
    rows = M.judge(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)  # a few rows: judged by their plain mean and covariance
    kept = M.keep(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in rows)
    assert M.judge(none).count() == M.keep(none).count() == 0


def _text(n, width=9):
    return " ".join("".join(random.choice("abcdefgh") for _ in range(random.randint(2, width))) for _ in range(n))


def _judged(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return {r["doc_id"]: r for r in M.judge(df).collect()}


def test_small_groups_are_judged(spark):
    random.seed(3)
    rows = [(i, _text(random.randint(60, 600)), "en", "big") for i in range(400)]
    clean = [(1000 + i, _text(random.randint(60, 600)), *k) for i, k in enumerate(
        [("en", "small")] * 20 + [("fr", "small")] * 20 + [("de", None), (None, "alone")])]
    junk = [(2000 + i, " | ".join(_text(100).split()), *k) for i, k in enumerate([("en", "small"), ("fr", "small"), ("it", "x")])]
    junk += [(2100 + i, _text(100, 90), *k) for i, k in enumerate([("en", "small"), ("fr", "small"), ("pt", None)])]
    got = _judged(spark, rows + clean + junk)
    assert all(r["distance"] is not None for r in got.values())
    assert {d for d, r in got.items() if r["kept"]} == {d for d, *_ in rows + clean}


def test_many_copies_do_not_mask_themselves(spark):
    random.seed(4)
    rows = [(i, _text(random.randint(60, 600)), "en", "s") for i in range(300)]
    junk = " | ".join(_text(100).split())
    copies = [(1000 + i, junk, "en", "s") for i in range(200)]
    alike = [(2000 + i, " | ".join(_text(100).split()), "en", "s") for i in range(150)]
    for bad in (copies, alike):
        assert {d for d, r in _judged(spark, rows + bad).items() if r["kept"]} == {d for d, *_ in rows}


def test_cut_is_a_quantile_and_not_fitted(spark):
    assert abs(M.consistency(0.5, M.CHI2_SHARE) - 1.912) < 0.001 and abs(M.consistency(0.975, M.CHI2_INSIDE) - 1.0556) < 0.001
    random.seed(5)
    rows = [(i, _text(random.randint(60, 600)), "en", "s") for i in range(300)]
    far = [(1000 + i, _text(100, 20), "en", "s") for i in range(3)]  # between 25.7 and the former 85
    got = _judged(spark, rows + far)
    assert all(M.CUT < got[d]["distance"] and not got[d]["kept"] for d, *_ in far)
    assert all(got[d]["kept"] for d, *_ in rows)


def _vectors(spark, rng, groups):
    """Correlated normal vectors per group, 30 % of them far off in one direction."""
    rows = []
    for g, n in groups.items():
        mix = rng.normal(size=(5, 5))
        x = rng.normal(size=(n, 5)) @ mix
        x[: int(0.3 * n)] += 25 * mix[0]
        rows += [(2, "en", g, *map(float, v)) for v in x]
    return spark.createDataFrame(rows, "_level int, lang string, source string, x0 double, x1 double, x2 double, x3 double, x4 double")


def test_determinant_falls_and_converges_over_several_starts(spark):
    rng = np.random.default_rng(9)
    sizes = {"a": 400, "b": 150, "c": 60}
    vectors = _vectors(spark, rng, sizes)
    best, steps = M.least_determinant(vectors, list(M.KEYS))
    first, second = ({(r["source"], r["_start"]): r["log_det"] for r in s.collect()} for s in steps[:2])
    assert len(first) == 3 * M.STARTS and all(second[k] <= first[k] + M.LEAST_FALL for k in first)
    assert max(first.values()) - min(first.values()) > 1   # the starts differ
    found = {r["source"]: r for r in best.collect()}
    later = [{r["source"]: r["log_det"] for r in s.collect()} for s in steps[2:]]
    for g in sizes:
        assert found[g]["log_det"] <= min(v for (s, _), v in second.items() if s == g)   # from the best start on
        assert found[g]["log_det"] <= min(step[g] for step in later) + 1e-12
        assert abs(later[-1][g] - found[g]["log_det"]) < 0.05 and len(later) < M.MOST_STEPS
    # the determinant itself, of the estimate's covariance
    for g, r in found.items():
        cov = np.array([[r[f"s{min(i, j)}{max(i, j)}"] for j in range(5)] for i in range(5)])
        assert abs(np.linalg.slogdet(cov)[1] - r["log_det"]) < 1e-6


def test_estimate_is_near_the_best_of_many_random_starts(spark):
    """Against FAST-MCD with exact half samples and 60 random starts, in numpy."""
    rng = np.random.default_rng(10)
    vectors = _vectors(spark, rng, {"a": 300})
    found = M.least_determinant(vectors, list(M.KEYS))[0].first()
    x = np.array([[r[c] for c in M.STATS] for r in vectors.collect()])
    factor, h, least = M.consistency(M.SHARE, M.CHI2_SHARE), len(x) // 2, np.inf
    for _ in range(60):
        pick = x[rng.choice(len(x), 6, replace=False)]
        for _ in range(30):
            mean, cov = pick.mean(axis=0), factor * np.cov(pick.T, bias=True) + np.diag(M.FLOOR)
            d = ((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(axis=1)
            pick = x[np.argsort(d)[:h]]
        least = min(least, np.linalg.slogdet(factor * np.cov(pick.T, bias=True) + np.diag(M.FLOOR))[1])
    assert abs(found["log_det"] - least) < 0.3   # bins keep a few vectors more than half
    clean = x[90:]
    off = np.array([found[f"m{i}"] for i in range(5)]) - clean.mean(axis=0)
    assert np.abs(off / clean.std(axis=0)).max() < 0.4   # and not between the clean vectors and the others
