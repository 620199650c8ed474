"""Containment search against all (document, item) pairs."""

from llm_fixtures import SF, docs, none, odd  # noqa: F401
from lakeops.llm import containment as C


def brute(docs, items, threshold=C.THRESHOLD):
    def grams(t):
        ws = (t or "").split()
        return {tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()
    out, held, asked = set(), {}, {}
    for d, t in docs:
        held.setdefault(d, set()).update(grams(t))
    for i, t in items:
        asked.setdefault(i, set()).update(grams(t))
    for d, x in held.items():
        for i, y in asked.items():
            if y and len(x & y) >= threshold * len(y):
                out.add((d, i, len(y), len(x & y)))
    return out


def found(df):
    rows = [(r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_items_in_documents(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    # every item inside long documents, whole, with one word changed, and cut in half
    filler = [f"f{i}" for i in range(3000)]
    for i, t in items:
        ws = t.split()
        for kind, part in enumerate((ws, [*ws[:3], "changed", *ws[4:]], ws[:len(ws) // 2])):
            data.append((10_000 + 10 * i + kind, " ".join(filler[:37 * i + 11] + part + filler[37 * i + 11:])))
    items += [(500, "tiny item"), (501, "six words are in this item"), (502, None)]
    data += [(90_000, "a tiny item"), (90_001, "tiny item"), (90_002, "x six words are in this item y")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = brute(data, items)
    assert len(want) > 2 * len(items) - 10
    assert found(C.contained(df, spark.createDataFrame(items, "item_id long, text string"))) == want


def test_odd_rows(spark, odd, none):
    items = [(None, "copy1 copy2 copy3 copy4 copy5 copy6 copy7"), (3, ""), (4, "one"), (4, None)]
    bench = spark.createDataFrame([(*i, 0, 0) for i in items], "item_id long, text string, part int, v0 int")
    data = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(C.contained(odd, bench)) == brute(data, items)
    clean = C.clean(odd, bench)
    assert clean.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(
        str(d) for d, t in data if not brute([(0, t)], items))
    assert C.contained(none, bench).count() == C.contained(odd, bench.limit(0)).count() == 0
    assert C.clean(odd, bench.limit(0)).count() == odd.count()
