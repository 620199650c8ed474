"""Near-duplicate classes against all pairs, and samples against the weighted Jaccard similarity."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from llm_fixtures import docs, none, odd  # noqa: F401
from lakeops.llm import icws as I


def classes(texts, idf, threshold=I.THRESHOLD):
    """Components of the pairs with weighted Jaccard of at least the threshold, over all pairs."""
    doc, shingle, weight = I.weighted_sets([(t or "").encode().split() for t in texts], idf)
    sets = [dict(zip(shingle[doc == i].tolist(), weight[doc == i].tolist())) for i in range(len(texts))]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < i}:
            both = sum(min(w, sets[j][x]) for x, w in s.items() if x in sets[j])
            if both >= threshold * (sum(s.values()) + sum(sets[j].values()) - both):
                up[top(i)] = top(j)
        for j in range(i):
            if (texts[i] or "") == (texts[j] or ""):
                up[top(i)] = top(j)
    groups = defaultdict(list)
    for i in range(len(texts)):
        groups[top(i)].append(i)
    return groups.values()


def test_classes_are_those_of_all_pairs(spark, docs):
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    # chains of edits around the threshold, and a large group of near copies
    words = [f"w{i}" for i in range(200)]
    for i in range(60):
        data.append((10_000 + i, " ".join(w if j != 3 * i else f"edit{i}" for j, w in enumerate(words))))
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = {min(data[i][0] for i in g): len(g) for g in classes([t for _, t in data], I.word_idf(df))}
    got = Counter(r["class_id"] for r in I.near_duplicates(df).collect())
    assert got == want
    assert got[10_000] == 60


def test_odd_rows(odd, none):
    rows = I.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    of = defaultdict(set)
    for r in rows:
        of[r["class_id"]].add(r["doc_id"])
    assert {6, 7, 8, None} in of.values()  # copies, and one with a word more
    kept = I.one_of_each(odd).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 3, 4, 5, 6, 8, 9, 10]
    assert I.one_of_each(odd).columns == odd.columns
    assert I.near_duplicates(none).count() == I.one_of_each(none).count() == 0


@pytest.mark.parametrize("shared", [0.5, 0.8, 0.95])
def test_samples_agree_as_often_as_the_sets_are_similar(shared):
    gamma = I._gamma_table()
    tables = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
    rng = np.random.default_rng(3)
    n = 400
    both = rng.integers(0, 2 ** 63, n).astype(np.uint64)
    weight = 1 + rng.random(n)
    cut = int(n * shared)
    other = np.concatenate([both[:cut], rng.integers(0, 2 ** 63, n - cut).astype(np.uint64)])
    drawn = I.samples(np.repeat([0, 1], n), np.concatenate([both, other]), np.concatenate([weight, weight]), 2000, tables)
    similar = weight[:cut].sum() / (2 * weight.sum() - weight[:cut].sum())
    assert abs((drawn[0] == drawn[1]).mean() - similar) < 0.05


def test_long_chains_become_one_component(spark):
    links = spark.createDataFrame([(bytes([0, i]), bytes([0, i + 1])) for i in range(40)] + [(b"x", b"y")],
                                  "a binary, b binary")
    labels = {bytes(r["vertex"]): bytes(r["label"]) for r in I.components(links).collect()}
    assert {labels[bytes([0, i])] for i in range(41)} == {bytes([0, 0])} and labels[b"y"] == b"x"


def test_pairs_on_one_template_are_all_found(spark):
    """Pairs well above the threshold among texts of one template, which are alike below it."""
    rng = np.random.default_rng(5)
    names = lambda n: [f"v{x}" for x in rng.integers(0, 10 ** 6, n)]
    template, data = names(240), []
    for pair in range(700):
        body = template + names(45)
        for half in range(2):
            data.append((2 * pair + half, " ".join(body + names(12))))
    got = I.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert Counter(r["class_id"] for r in got) == {2 * p: 2 for p in range(700)}


@pytest.mark.parametrize("side", [False, True])
def test_links_of_a_block_are_those_of_all_pairs(side):
    rng = np.random.default_rng(11)
    sets, marks = [], []
    for i in range(150):
        base = np.arange(60, dtype=np.uint64) + np.uint64(1000 * (i % 7))
        own = rng.integers(10 ** 6, 10 ** 9, rng.integers(0, 12)).astype(np.uint64)
        s = np.unique(np.concatenate([rng.permutation(base)[:rng.integers(45, 61)], own]))
        sets.append((s, 1 + (s % np.uint64(5)).astype(float)))
        marks.append(rng.integers(0, 2, I.BANDS * I.ROWS).astype(np.uint8))
    marks = np.array(marks)
    marks[:, 9:12] = 1  # all meet in band 3, some before
    sides = rng.integers(0, 2, 150) if side else np.full(150, -1)

    def label(pairs):
        up = list(range(150))
        for a, b in pairs:
            x, y = up[a], up[b]
            up = [x if u == y else u for u in up]
        return [min(j for j in range(150) if up[j] == up[i]) for i in range(150)]

    want = []
    for i in range(150):
        for j in range(i):
            both = np.minimum(*(np.array([dict(zip(*map(np.ndarray.tolist, sets[k]))).get(x, 0) for x in
                                          set(sets[i][0].tolist()) | set(sets[j][0].tolist())]) for k in (i, j))).sum()
            first = (marks[i].reshape(-1, I.ROWS) == marks[j].reshape(-1, I.ROWS)).all(1).argmax()
            if (first == 3 and both >= I.THRESHOLD * (sets[i][1].sum() + sets[j][1].sum() - both)
                    and (not side or sides[i] != sides[j])):
                want.append((j, i))
    got = I._linked(sets, np.arange(150), sides, marks, 3)
    assert label(got) == label(want) and len(want) > len(got) > 20


def test_buckets_cut_into_parts_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    template = [f"v{x}" for x in range(100)]
    data = []
    for pair in range(30):
        body = template + [f"p{pair}w{x}" for x in range(25)]
        data += [(2 * pair + half, " ".join(body + [f"h{rng.integers(10 ** 9)}"])) for half in range(2)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = {min(data[i][0] for i in g): len(g) for g in classes([t for _, t in data], I.word_idf(df))}
    monkeypatch.setattr(I, "BLOCK", 3_000)
    monkeypatch.setattr(I, "candidates", lambda salted: salted.limit(0).select(
        salted["vertex"].alias("a"), salted["vertex"].alias("b")))  # without the first pass
    assert Counter(r["class_id"] for r in I.near_duplicates(df).collect()) == want


def test_a_third_of_the_rows_in_one_class(spark):
    words = [f"w{i}" for i in range(150)]
    data = [(i, " ".join(words[:140] + [f"e{i}"] + words[140:])) for i in range(300)]
    data += [(1_000 + i, " ".join(f"x{i}y{j}" for j in range(60))) for i in range(600)]
    got = Counter(r["class_id"] for r in I.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect())
    assert got[0] == 300 and len(got) == 601
