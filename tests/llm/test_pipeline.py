"""The pipeline's stages on a small corpus with planted cases."""

import random

import corpus_pipeline as C
from llm_fixtures import SF, none, odd  # noqa: F401
from lakeops.llm import packing
from lakeops.llm.queries import tokenizer_path


def test_stages(spark, tmp_path):
    random.seed(4)
    text = lambda n: " ".join("".join(random.choice("abcdefghij") for _ in range(random.randint(2, 9))) for _ in range(n))
    item = text(40)
    data = [(i, text(120)) for i in range(200)]
    copies = [(1000 + i, data[i][1]) for i in range(10)] + [(1100 + i, data[i][1] + " more") for i in range(10, 20)]
    leaks = [(2000 + i, text(100) + " " + item + " " + text(50)) for i in range(5)]
    junk = [(3000 + i, "spam spam spam " * 40) for i in range(5)] + [(3100, ""), (3101, None), (3102, "too short")]
    private = [(4000, text(80) + " joe@mail.example.org " + text(10))]
    rows = [(d, t, "en", "s", len(t or "")) for d, t in data + copies + leaks + junk + private]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r["doc_id"] for r in docs.collect()})
    clean = {d for d, _ in data}
    assert kept[0] == clean | {d for d, _ in copies + leaks + private}
    assert kept[1] == clean | {d for d, _ in leaks + private}
    assert kept[2] == kept[3] == clean | {4000}
    masked = {r["doc_id"]: r for r in docs.collect()}
    assert "<email>" in masked[4000]["text"] and masked[4000]["n_chars"] == len(masked[4000]["text"])
    assert masked[5]["text"] == dict(data)[5]
    packed = C.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    want = sum(len(x) // 4 + 1 for x in packing.token_bytes([r["text"] for r in masked.values()], tokenizer_path()))
    assert sum(r["length"] for r in packed) == want
    assert sum(r["length"] for r in C.run(spark, str(tmp_path)).collect()) == want


def test_odd_rows_go_through_the_stages(spark, odd, none):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns; and an empty table."""
    import corpus_pipeline as C
    for docs in (odd, none):
        rows = docs
        for name, stage in C.STAGES[:-1]:
            out = stage(spark, rows, SF)
            assert out.columns == docs.columns, name
            rows = spark.createDataFrame(out.collect(), docs.schema)
        packed = C.STAGES[-1][1](spark, rows, SF).collect()
        assert {p["doc_id"] for p in packed} == {r["doc_id"] for r in rows.collect()}
