"""Toxic severity by cumulative-link (proportional odds) regression over sparse text features.

P(grade <= k | x) = sigmoid(theta_k - w.x): one weight vector shared by all ordered thresholds
theta_0 < theta_1 < ...  The expected severity is the sum over k of P(grade > k).

Features are words and word beginnings of 4, 5 and 6 letters (lower case, letters only), with
value ln(1 + occurrences); of them, those that the labelled sample ties to toxic texts.

Grades.  The labels only say toxic or not.  :func:`grade_labels` orders the toxic ones by how dense
they are in words that mark toxic texts (counted on the sample): below ``DENSITIES[0]`` of the words
is grade 1, and so on.  Other graded labels can be given to :func:`fit` directly.

The model is fitted on at most ``SAMPLE`` labelled rows, those with the least hash of doc_id, and
at most ``FEATURES`` features; both bound what reaches the driver.  All documents are scored.

Words are runs of letters, of any length and between any signs (no-break spaces, commas, slashes).

Defined cases: null and empty texts have no features (the base rate's severity); a label with a null
doc_id or grade is ignored, of several labels for a doc_id the highest counts; null and repeated
doc_ids are scored row by row; without toxic (or without any) labels every severity is 0; further
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.llm.common import pin

SAMPLE = 40_000
FEATURES = 5_000
STEMS = (4, 5, 6)
#: Least gain in log likelihood of giving a feature its own rate of toxic texts (of a million features
#: without a tie to toxicity about one passes).
LEAST_GAIN = 14.0
DENSITIES = (0.01, 0.03)
L2 = 1e-4
STEPS = 400
REMEMBER = 400_000
LONG = 400

_LETTERS = re.compile(r"[^\W\d_]+")


def features_of(word: bytes) -> list[str]:
    """The features of a word between white space."""
    out = []
    for part in _LETTERS.findall(word.decode().lower()):
        out.append(part)
        out += [part[:n] + "-" for n in STEMS if len(part) > n]
    return out


class _Known(dict):
    """The chosen features of each word, remembered for words under ``LONG`` bytes."""

    def __init__(self, chosen: dict):
        self.chosen = chosen

    def __missing__(self, word):
        if len(self) > REMEMBER:
            self.clear()
        chosen = self.chosen
        value = tuple(chosen[f] for f in features_of(word) if f in chosen)
        if len(word) < LONG:
            self[word] = value
        return value


def sample_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled rows; of copies, near or exact, mostly one.

    Else each word of a text with many copies would look like a mark of its grade.  Texts with the same
    least hash of five words count as copies.
    """
    some = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
            .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # bounded by ``sample`` rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(some), "doc_id")

    def least(batches):
        import xxhash
        for batch in batches:
            keys = []
            for text in batch.column(1).to_pylist():
                ws = (text or "").encode().split()
                keys.append(min((xxhash.xxh3_64_intdigest(b" ".join(ws[i:i + 5]))
                                 for i in range(max(1, len(ws) - 4))), default=0) - (1 << 63))
            yield batch.append_column("copy", pa.array(keys, pa.int64()))

    marked = rows.mapInArrow(least, "doc_id long, text string, toxic int, copy long")
    return marked.groupBy("copy").agg(F.min(F.struct("doc_id", "toxic", "text")).alias("x")).select("x.text", "x.toxic")


def marking(sample: DataFrame, most: int = FEATURES) -> dict[str, float]:
    """Features that mark toxic texts, by their gain."""

    def count(batches):
        toxic, clean = Counter(), Counter()
        n = [0, 0]
        for batch in batches:
            for i in range(batch.num_rows):
                bad = batch.column(1)[i].as_py() > 0
                seen = {f for w in set((batch.column(0)[i].as_py() or "").encode().split())
                        for f in features_of(w)}
                (toxic if bad else clean).update(seen)
                n[bad] += 1
        toxic[""], clean[""] = n[1], n[0]
        # what no toxic text of this task has still counts where another task's has
        keys = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()),
             pa.array([clean[k] for k in keys], pa.int64())], names=["feature", "toxic", "clean"])

    kind = "feature string, toxic long, clean long"
    counts = pin(sample.select("text", "toxic").mapInArrow(count, kind).groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "ordinal_counts")
    total = counts.filter("feature = ''").first()
    if total is None or not total["toxic"]:
        return {}
    rate = total["toxic"] / (total["toxic"] + total["clean"])
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    gain = F.col("toxic") * F.log(share / rate) + F.when(
        F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    rows = (counts.filter((F.col("feature") != "") & (F.col("toxic") > 0)).withColumn("gain", gain)
            .filter((share > rate) & (F.col("gain") >= LEAST_GAIN)).orderBy(F.desc("gain"), "feature").limit(most).collect())
    return {r["feature"]: r["gain"] for r in rows}


class Graded:
    """The labelled sample: chosen features, and per row its features and its grade."""

    def __init__(self, spark, names: list[str], rows: list[tuple[dict[int, int], int]], grades: int):
        self.spark, self.names, self.rows, self.grades = spark, names, rows, grades


def grade_labels(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Graded:
    """The labelled sample with grades 0 ... len(DENSITIES) + 1."""
    rows = pin(sample_of(docs, labels, sample), "ordinal_sample")
    names = sorted(marking(rows))
    chosen = {f: i for i, f in enumerate(names)}

    def look(batches):
        known = _Known(chosen)
        for batch in batches:
            out = [[], [], [], []]
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # letter runs, so that a text has the same density whatever signs separate its words
                ws = [w.encode() for w in _LETTERS.findall((text or "").lower())]
                hits = [h for h in map(known.__getitem__, ws) if h]
                found = Counter(f for h in hits for f in h)
                for x, y in zip(out, (list(found), list(found.values()), toxic, len(hits) / max(1, len(ws)))):
                    x.append(y)
            kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)],
                                             names=["at", "times", "toxic", "density"])

    seen = rows.select("text", "toxic").mapInArrow(
        look, "at array<long>, times array<long>, toxic long, density double").collect()
    grade = [(1 + int(np.searchsorted(DENSITIES, r["density"], side="right"))) if r["toxic"] > 0 else 0 for r in seen]
    return Graded(docs.sparkSession, names, [(dict(zip(r["at"], r["times"])), g) for r, g in zip(seen, grade)],
                  len(DENSITIES) + 2)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Severity:
    """Fitted weights by feature, thresholds in order, and the least P(grade > 0) that is called toxic."""

    def __init__(self, weights: dict[str, float], thresholds: list[float], cut: float = 0.5):
        self.weights, self.thresholds, self.cut = weights, thresholds, cut


def best_cut(p: np.ndarray, bad: np.ndarray) -> float:
    """The middle of the gap in ``p`` that gives the best F1 on the sample."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(bad[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + bad.sum())
    last = np.append(p[order][1:] < p[order][:-1], True)  # equal values fall on one side
    at = int(np.argmax(np.where(last, f1, 0)))
    after = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float((p[order][at] + after) / 2)


def fit(data: Graded, l2: float = L2, steps: int = STEPS) -> Severity:
    """Maximum likelihood with an L2 penalty on the weights.

    The cut comes from rows that the weights were not fitted on: each half of the sample is
    predicted by the other.
    """
    y = np.array([g for _, g in data.rows], np.int64)
    k = data.grades
    if not len(y) or not (y > 0).any():
        return Severity({}, [40.0] * (k - 1))
    p = np.zeros(len(y))
    halves = [list(range(i, len(y), 2)) for i in (0, 1)]
    for train, test in (halves, halves[::-1]):
        if (y[train] > 0).any():
            w, theta = _descend([data.rows[i] for i in train], len(data.names), k, l2, steps)
            p[test] = [1 - _sigmoid(theta[0] - sum(w[f] * math.log1p(c) for f, c in data.rows[i][0].items()))
                       for i in test]
    w, theta = _descend(data.rows, len(data.names), k, l2, steps)
    return Severity(dict(zip(data.names, w.tolist())), theta.tolist(), best_cut(p, y > 0))


def _descend(rows, n: int, k: int, l2: float, steps: int, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on all the rows."""
    y = np.array([g for _, g in rows], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    col = np.fromiter((i for f, _ in rows for i in f), np.int64, len(row))
    val = np.log1p(np.fromiter((c for f, _ in rows for c in f.values()), np.float64, len(row)))
    w, first, gaps = np.zeros(n), np.array([1.0]), np.zeros(k - 2)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, first, gaps)]
    for step in range(1, steps + 1):
        theta = np.cumsum(np.concatenate([first, np.logaddexp(0, gaps)]))  # increasing by softplus
        z = np.bincount(row, val * w[col], len(rows))
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        high, low = _sigmoid(edges[y + 1] - z), _sigmoid(edges[y] - z)
        p = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high) / p, low * (1 - low) / p
        dz = (dh - dl) / len(rows)
        grad_theta = np.zeros(k + 1)
        np.add.at(grad_theta, y + 1, -dh / len(rows))
        np.add.at(grad_theta, y, dl / len(rows))
        tail = np.cumsum(grad_theta[1:k][::-1])[::-1]
        grads = (np.bincount(col, val * dz[row], n) + l2 * w, tail[:1], tail[1:] * _sigmoid(gaps))
        for param, grad, (m, v) in zip((w, first, gaps), grads, state):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return w, np.cumsum(np.concatenate([first, np.logaddexp(0, gaps)]))


def predict(docs: DataFrame, model: Severity) -> DataFrame:
    """(doc_id, toxic, grade, severity, p_toxic) of every row.

    ``toxic`` is P(grade > 0) of at least the model's cut; ``grade`` is then the severity, rounded, 1 at least.
    """
    names = list(model.weights)
    chosen = {f: i for i, f in enumerate(names)}
    cut = model.cut
    weights, theta = np.array([model.weights[f] for f in names]), np.array(model.thresholds)

    def work(batches):
        known = _Known(chosen)
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                hits = [h for h in map(known.__getitem__, (batch.column(1)[i].as_py() or "").encode().split()) if h]
                if hits:
                    found = Counter(f for h in hits for f in h)
                    z[i] = sum(weights[f] * math.log1p(c) for f, c in found.items())
            above = 1 - _sigmoid(theta[None, :] - z[:, None])
            toxic = above[:, 0] >= cut
            level = np.where(toxic, np.maximum(1, np.rint(above.sum(1))), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(toxic), pa.array(level.astype(np.int64)), pa.array(above.sum(1)),
                 pa.array(above[:, 0])], names=["doc_id", "toxic", "grade", "severity", "p_toxic"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        work, "doc_id long, toxic boolean, grade long, severity double, p_toxic double")
