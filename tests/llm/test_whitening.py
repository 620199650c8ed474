"""Whitening against numpy and exact fractions, and eigenvectors with known clusters."""

from fractions import Fraction

import numpy as np
import pytest

from llm_fixtures import SF
from lakeops.llm import whitening as W
from lakeops.llm.queries import op12_whitening

LD = np.longdouble


def _x(vectors):
    return np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000


def test_query_equals_brute_force(spark):
    data = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = _x([r["embedding"] for r in data])
    n, dim = x.shape
    s = x.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov((x - s / n).T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    got = {(r["vec_id"], r["component"]): r for r in op12_whitening(spark, SF).collect()}
    assert len(got) == 8 * n
    for c in range(8):
        want = (x - s / n) @ vectors[:, c] / np.sqrt(values[c])
        mine = np.array([got[r["vec_id"], c + 1]["whitened"] for r in data])
        assert np.abs(mine * np.sign(mine @ want) - want).max() < 1e-9
        assert all(abs(got[r["vec_id"], c + 1]["explained"] - values[c] / values.sum()) < 1e-12 for r in data)
    for r, row in zip(data, x):
        assert got[r["vec_id"], 1]["deviation"] == sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s))
    assert {r["n"] for r in got.values()} == {n}
    assert {r["identity_error"] < 1e-12 for r in got.values()} == {True}


def test_covariance_is_exact(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(300, 5)) + 50).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(4)
    n, s = W.sums(df)
    x = _x(vectors)
    assert (n, s) == (300, x.sum(axis=0).tolist())
    v = W.covariance(df, n, s)
    for i in range(5):
        for j in range(5):
            want = sum(Fraction(n * int(a) - s[i]) * Fraction(n * int(b) - s[j]) for a, b in x[:, [i, j]]) / n ** 3
            assert abs(Fraction(float(v[i, j])) - want) <= abs(want) * Fraction(1, 1 << 52) + Fraction(1, 1 << 60)


def _known(values, seed=0):
    """A matrix with these eigenvalues, in the higher precision, and its eigenvectors: products of reflections."""
    rng = np.random.default_rng(seed)
    q = np.eye(len(values), dtype=LD)
    for _ in range(len(values)):
        v = rng.normal(size=len(values)).astype(LD)
        v /= np.sqrt((v * v).sum())
        q = q - 2 * np.outer(q @ v, v)
    return (q * np.array(values, LD)) @ q.T, q


@pytest.mark.parametrize("values", [
    np.arange(30, 0, -1.0),
    10.0 ** -np.arange(12),
    np.concatenate([[5 + 4e-8, 5 + 3e-8, 5 + 1e-8, 5], np.arange(4, 1, -0.5)]),
    np.concatenate([[7 + 3e-11, 7 + 1e-11, 7], [3 + 1e-9, 3], [1.0, 0.5, 0.25]]),
])
def test_refined_vectors_reach_beyond_float64(values):
    """With eigenvalues as close as 1e-11 the plain solver errs by 1e-5; refined vectors are right to eps / gap."""
    a, q = _known(values)
    got, x = W.refined(a)
    scale, eps = np.abs(values).max(), np.finfo(LD).eps
    assert np.abs(got - np.sort(values)[::-1]).max() < 50 * eps * scale * len(values)
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-17
    gap = np.abs(np.subtract.outer(values, values) + np.eye(len(values)) * scale).min()
    for c in range(len(values)):
        sign = np.sign(x[:, c] @ q[:, c])
        assert np.abs(x[:, c] * sign - q[:, c]).max() < 100 * eps * scale / gap * len(values)


def test_float32_start_is_refined():
    a, q = _known(np.arange(20, 0, -1.0), 3)
    start = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1]
    x = W.refined(a)[1]
    assert np.abs(np.abs(start) - np.abs(q)).max() > 1e-8
    assert np.abs(np.abs(x) - np.abs(q)).max() < 1e-17


def test_equal_eigenvalues_give_some_orthonormal_basis():
    a, _ = _known([4, 2, 2, 2, 1, 1, 0, 0], 5)
    values, x = W.refined(a)
    assert np.abs(values - np.array([4, 2, 2, 2, 1, 1, 0, 0])).max() < 1e-17
    assert np.abs(x.T @ x - np.eye(8)).max() < 1e-17
    assert np.abs(a @ x - x * values).max() < 1e-17
    for m in (np.zeros((3, 3)), np.eye(3) * 7):
        values, x = W.refined(m)
        assert np.abs(m @ x - x * values).max() == 0 and np.abs(x.T @ x - np.eye(3)).max() < 1e-18


SCHEMA = "vec_id long, embedding array<double>, component int, v int, id int, n int, deviation int, whitened int, at int"


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [[1.0, 2.0, 0.5], [0.25, -1.0, 3.0], [2.0, 0.0, 1.0], [-1.5, 1.0, 0.0], [0.0, 0.5, -2.0]]
    rows = [(i, v) for i, v in enumerate(good)] + [(None, good[0]), (0, good[0]), (1, good[1])]
    bad = [(20, None), (21, [1.0, None, 2.0]), (22, [1.0, nan, 2.0]), (23, [inf, 0.0, 0.0]), (24, []), (25, [1.0, 2.0]),
           (26, [1e300, 0.0, 0.0]), (27, [-inf, nan, None])]
    df = spark.createDataFrame([(*r, *[0] * 7) for r in rows + bad], SCHEMA).repartition(3)
    got = W.whiten(df).collect()
    assert len(got) == 3 * len(rows) and {r["n"] for r in got} == {len(rows)}
    x = _x([v for _, v in rows])
    s = x.sum(axis=0)
    assert sorted(r["deviation"] for r in got) == sorted(3 * [int(d) for d in ((len(rows) * x - s) ** 2).sum(axis=1)])
    assert got[0]["identity_error"] < 1e-12
    assert abs(sum({r["component"]: r["explained"] for r in got}.values()) - 1) < 1e-12
    assert W.whiten(df.limit(0)).count() == 0 and W.whiten(df.where("vec_id > 19")).count() == 2


def test_no_variance_and_large_entries(spark):
    def run(rows):
        return W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()

    one = run([(1, [3.0, 4.0])])
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [
        (1, 0, None, 0.0, None), (2, 0, None, 0.0, None)]
    flat = run([(i, [float(i), 5.0, float(-i)]) for i in range(6)])
    assert [r["whitened"] is None for r in sorted(flat, key=lambda r: r["component"])] == [False] * 6 + [True] * 12
    assert flat[0]["identity_error"] < 1e-12
    large = run([(1, [2.0 ** 40, 1.0]), (2, [-2.0 ** 40, 2.0]), (3, [0.0, -5.0]), (4, [2.0 ** 39, 1.0])])
    assert len(large) == 8 and {r["deviation"] for r in large} == {None}
    assert abs(sum(r["whitened"] ** 2 for r in large if r["component"] == 1) / 4 - 1) < 1e-12
