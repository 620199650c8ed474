"""Whitening of embeddings by their principal components, with refined eigenvectors.

1. :func:`fit` reads the vectors twice: once for their number and exact sums, once for the products
   of vectors centred on the rounded mean, which Spark adds up (d*(d+1)/2 numbers a task, whole numbers
   below 2**53 for usual inputs, so exact in any order).  Only that matrix, whose size the dimension
   bounds, comes to the driver.
2. :func:`refined` takes the eigenvectors of the covariance in float32 and corrects them by the
   matrix-multiplication steps of Ogita and Aishima in a higher precision.  Eigenvalues closer than a
   step's own error bound form a cluster; it is taken apart by a small eigenproblem inside its
   subspace, shifted by the cluster's mean, so that the differences in it keep their digits.
3. :func:`transform` projects every vector, :func:`identity_error` measures the covariance of what came out.

The entries are the whole numbers x = floor(1024 * c) + 100000 of the given entries c.

Defined cases: rows whose vector is null, or holds null, NaN or infinite entries, are left out, and
so are those with an entry whose x is no long (2**62 or more).  All vectors used have one length: the
one that most remaining rows have, the longest of equally frequent ones; rows of other lengths are
left out.  Null and repeated ids and repeated rows stay.  A component without variance (an eigenvalue
not over d * 2**-52 of the largest) cannot be whitened: its value is null, and it takes no part in
identity_error (null if no component has any variance).  A deviation beyond a long is null.  Without
rows the result is empty.  Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
#: Rows multiplied at once: whole-number products of usual entries stay exact in a double.
BLOCK = 4096
#: The precision of the refinement.
HIGHER = np.longdouble
STEPS = 30
LARGEST = float(1 << 62)


@dataclass
class Whitening:
    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def dim(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> list[float]:
        trace = np.trace(self.covariance)
        return [float(v / trace) if trace > 0 else 0.0 for v in self.values]

    def usable(self, k: int) -> list[bool]:
        top = self.values[0] if len(self.values) else 0
        return [bool(v > top * self.dim * 2.0 ** -52) for v in self.values[:k]]


def _by_length(column: pa.ListArray):
    """(rows, whole numbers x) for each length of the lists that hold finite numbers only."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))[:-1]]).astype(np.int64)
    for length in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == length)
        with np.errstate(over="ignore", invalid="ignore"):
            scaled = np.floor(1024.0 * values[starts[rows][:, None] + np.arange(length)])
            good = (np.abs(scaled) < LARGEST).all(axis=1)
        yield int(length), rows[good], scaled[good].astype(np.int64) + 100_000


def _column(vectors: DataFrame, vector: str, *others: Column) -> DataFrame:
    return vectors.select(F.col(vector).cast("array<double>").alias("v"), *others)


def _sum(x: np.ndarray) -> list[int]:
    if int(np.abs(x).max()) * len(x) >= 1 << 62:
        x = x.astype(object)
    return [int(s) for s in x.sum(axis=0)]


def _blocks(column: pa.ListArray, dim: int):
    for length, _, x in _by_length(column):
        if length == dim:
            for at in range(0, len(x), BLOCK):
                yield x[at:at + BLOCK]


def sums(vectors: DataFrame, vector: str = "embedding") -> tuple[int, list[int]]:
    """The number of vectors of the common length, and their exact sums per dimension."""

    def add(batches):
        totals = {}
        for batch in batches:
            for length, rows, x in _by_length(batch.column(0)):
                if len(rows):
                    n, s = totals.get(length, (0, [0] * length))
                    totals[length] = n + len(rows), [a + b for a, b in zip(s, _sum(x))]
        for length, (n, s) in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([length] * length, pa.int32()), pa.array(range(length), pa.int32()), pa.array([n] * length, pa.int64()),
                 pa.array([Decimal(v) for v in s], pa.decimal128(38, 0))], names=["length", "i", "n", "s"])

    parts = _column(vectors, vector).mapInArrow(add, "length int, i int, n long, s decimal(38,0)")
    parts = parts.groupBy("length", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
    lengths = parts.where("i = 0").orderBy(F.desc("n"), F.desc("length")).limit(1)
    rows = parts.join(lengths.select("length"), "length").orderBy("i").collect()
    return (rows[0]["n"], [int(r["s"]) for r in rows]) if rows else (0, [])


def covariance(vectors: DataFrame, n: int, s: list[int], vector: str = "embedding") -> np.ndarray:
    """Covariance (divisor n) of the x-vectors, in the higher precision."""
    dim = len(s)
    middle = [(2 * v + n) // (2 * n) for v in s]
    upper = np.triu_indices(dim)

    def products(batches):
        total = np.zeros((dim, dim), HIGHER)
        for batch in batches:
            for x in _blocks(batch.column(0), dim):
                centred = (x - np.array(middle, np.int64)).astype(np.float64)
                total += centred.T @ centred
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0])), pa.int64()),
                                          pa.array(total[upper].astype(np.float64))], names=["k", "g"])

    rows = (_column(vectors, vector).mapInArrow(products, "k long, g double")
            .groupBy("k").agg(F.sum("g").alias("g")).toPandas())
    out = np.zeros((dim, dim), HIGHER)
    i, j = upper[0][rows["k"]], upper[1][rows["k"]]
    out[i, j] = out[j, i] = rows["g"].to_numpy()
    off = np.array([HIGHER(v - m * n) / n for v, m in zip(s, middle)], HIGHER)
    return out / n - np.outer(off, off)


def _clusters(values: np.ndarray, gap) -> list[np.ndarray]:
    """Groups of two and more eigenvalues, neighbours in which are at most ``gap`` apart."""
    order = np.argsort(values)
    parts = np.split(order, np.flatnonzero(np.diff(values[order]) > gap) + 1)
    return [p for p in parts if len(p) > 1]


def refined(matrix: np.ndarray, precision=HIGHER, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix."""
    a = np.asarray(matrix, precision)
    dim = len(a)
    size = np.abs(a).max() if dim else 0
    if not size:
        return np.zeros(dim, precision), np.eye(dim, dtype=precision)
    a = a / size
    eps = np.finfo(precision).eps * dim
    norm = np.sqrt((a * a).sum())
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(precision)
    one = np.eye(dim, dtype=precision)
    last = np.inf
    for _ in range(steps):
        ax = a @ x
        r, s = one - x.T @ x, x.T @ ax
        r, s = (r + r.T) / 2, (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        bound = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
        gaps = values[None, :] - values[:, None]
        apart = np.abs(gaps) > bound
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gaps, 1), r / 2)
        x = x + x @ e
        change = np.abs(e).max()
        turned = False
        for part in _clusters(values, bound):
            own = x[:, part]
            middle = values[part].mean()
            inner = own.T @ (a @ own) - middle * (own.T @ own)
            inner = (inner + inner.T) / 2
            rest = np.abs(inner - np.diag(np.diag(inner))).max()
            if rest > eps * norm:
                x[:, part] = own @ np.linalg.eigh((inner / np.abs(inner).max()).astype(np.float64))[1].astype(precision)
                turned = True
        if not turned and np.abs(r).max() <= eps and (change <= eps or change >= last / 2):
            break
        last = change
    x = x + x @ ((one - x.T @ x) / 2)
    values = np.diag(x.T @ (a @ x)) / (x * x).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(dim)] < 0, -1, 1)
    return values[order] * size, x


def fit(vectors: DataFrame, vector: str = "embedding") -> Whitening:
    n, s = sums(vectors, vector)
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    v = covariance(vectors, n, s, vector)
    values, components = refined(v)
    return Whitening(n, s, v, values, components)


def _scaled(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - s, exact: as longs where they fit with their squares' sum, else as Python numbers."""
    most = max(map(abs, s)) + n * int(np.abs(x).max()) if len(x) else 0
    if most >= 1 << 62:
        return x.astype(object) * n - np.array(s, object)
    y = x * n - np.array(s, np.int64)
    return y if len(y) == 0 or int(np.abs(y).max()) ** 2 * len(s) < 1 << 62 else y.astype(object)


def transform(vectors: DataFrame, model: Whitening, k: int = COMPONENTS, id_: str = "vec_id",
              vector: str = "embedding") -> DataFrame:
    """id, deviation (sum of (n*x - S)**2) and the whitened values of the first ``k`` components."""
    k = min(k, model.dim)
    usable = model.usable(k)
    n, s, dim = model.n, model.sums, model.dim
    scale = np.array([np.sqrt(v) if u else 1 for v, u in zip(model.values, usable)], HIGHER)
    weights = (model.vectors[:, :k] / scale).astype(np.float64) if k else np.zeros((dim, 0))
    schema = "id long, deviation long, whitened array<double>"

    def project(batches):
        for batch in batches:
            for length, rows, x in _by_length(batch.column(0)):
                if length != dim or not len(rows):
                    continue
                y = _scaled(x, n, s)
                deviation = [d if d < 1 << 63 else None for d in map(int, (y * y).sum(axis=1))]
                out = (y / n).astype(np.float64) @ weights
                flat = pa.array(out.ravel(), mask=~np.tile(usable, len(rows)))
                offsets = pa.array(np.arange(len(rows) + 1) * k, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(pa.array(rows)), pa.array(deviation, pa.int64()),
                     pa.ListArray.from_arrays(offsets, flat)], names=["id", "deviation", "whitened"])

    return (_column(vectors, vector, F.col(id_).cast("long").alias("id")).mapInArrow(project, schema)
            .withColumnRenamed("id", id_))


def identity_error(whitened: DataFrame, model: Whitening, k: int = COMPONENTS) -> float | None:
    """The largest absolute entry of (covariance of the whitened values - identity), over usable components."""
    usable = np.flatnonzero(model.usable(k))
    if not len(usable):
        return None
    c = len(usable)

    def products(batches):
        total, first = np.zeros((c, c)), np.zeros(c)
        for batch in batches:
            column = batch.column(0)
            w = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)[:, usable]
            total += w.T @ w
            first += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(c * c + c), pa.int64()),
                                          pa.array(np.concatenate([total.ravel(), first]))], names=["k", "g"])

    rows = (whitened.select("whitened").mapInArrow(products, "k long, g double")
            .groupBy("k").agg(F.sum("g").alias("g")).orderBy("k").collect())
    g = np.array([r["g"] for r in rows])
    mean = g[c * c:] / model.n
    return float(np.abs(g[:c * c].reshape(c, c) / model.n - np.outer(mean, mean) - np.eye(c)).max())


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    model = fit(vectors)
    out = transform(vectors, model, k)
    error = identity_error(out, model, k)
    explained = F.array(*map(F.lit, model.explained[:k])) if model.n else F.array().cast("array<double>")
    return (out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
                    "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"),
                    F.lit(error).cast("double").alias("identity_error")))
