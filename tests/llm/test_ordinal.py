"""Severity: planted grades, held-out accuracy, odd rows."""

import random

from llm_fixtures import none, odd  # noqa: F401
from lakeops.llm import ordinal as O


def _data(n, seed):
    random.seed(seed)
    words = ["".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    bad = ["vilely", "vileness", "viler", "scorned"]
    out = []
    for i in range(n):
        grade = random.choice([0, 0, 0, 1, 2, 3])
        ws = random.choices(words, k=100)
        for _ in range([0, 1, 2, 6][grade]):
            ws[random.randrange(100)] = random.choice(bad)
        out.append((i, " ".join(ws), grade))
    return out


def test_held_out_documents(spark):
    data = _data(1200, 1)
    df = spark.createDataFrame([d[:2] for d in data], "doc_id long, text string")
    labels = spark.createDataFrame([(d, 1, int(g > 0)) for d, _, g in data if d % 2], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in O.predict(df, O.fit(O.grade_labels(df, labels))).collect()}
    test = [(g, got[d]) for d, _, g in data if d % 2 == 0]
    assert sum((g > 0) == r["toxic"] for g, r in test) >= 0.98 * len(test)
    mean = [sum(r["severity"] for g, r in test if g == k) / sum(g == k for g, _ in test) for k in range(4)]
    assert mean == sorted(mean) and mean[3] > mean[1] + 0.5


def test_thresholds_are_ordered_and_shared():
    rows = [({0: k} if k else {}, k) for k in (0, 1, 2, 3) for _ in range(50)]
    model = O.fit(O.Graded(None, ["f"], rows, 4))
    assert model.thresholds == sorted(model.thresholds) and model.weights["f"] > 0


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(None, 1, 1), (5, 1, None), (6, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        rows = O.predict(odd, O.fit(O.grade_labels(odd, lab))).collect()
        assert len(rows) == odd.count() and not any(r["toxic"] for r in rows)
        assert all(r["grade"] == 0 and r["severity"] < 1e-6 for r in rows)
    assert O.predict(none, O.fit(O.grade_labels(none, labels))).count() == 0


def test_texts_joined_by_other_signs(spark):
    data = _data(1200, 2)
    joined = [(d, text.replace(" ", "\u00a0,/\u3000"[d % 4]), g) for d, text, g in data]
    assert all(len(w) >= 400 for _, text, _ in joined for w in text.encode().split())
    plain, other = (spark.createDataFrame([d[:2] for d in x], "doc_id long, text string") for x in (data, joined))
    labels = spark.createDataFrame([(d, 1, int(g > 0)) for d, _, g in data if d % 2], "doc_id long, quality int, toxic int")
    graded = O.grade_labels(plain, labels)
    model = O.fit(graded)
    got = [{r["doc_id"]: r for r in O.predict(df, model).collect()} for df in (plain, other)]
    assert all(abs(got[0][d]["severity"] - got[1][d]["severity"]) < 1e-9 for d, *_ in data)
    assert sum(got[1][d]["toxic"] for d, _, g in data if g) >= 0.98 * sum(g > 0 for *_, g in data)
    # the fit, too, sees the words of such texts
    assert O.grade_labels(other, labels).names == graded.names
