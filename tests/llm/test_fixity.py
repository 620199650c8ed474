"""Fixity audit against a record-by-record comparison."""

import hashlib

from llm_fixtures import SF  # noqa: F401
from pyspark.sql import functions as F

from lakeops.llm import fixity as X


def found(first, second, **options):
    rows = X.audit(X.tree(first, **options), X.tree(second, **options)).collect()
    return sorted(((r["file"], r["offset"], r["record_id"], r["state"]) for r in rows), key=str)


def test_records_lie_one_after_the_other(spark):
    rows = X.warc_records(spark.read.parquet(f"{SF}/pages.parquet")).orderBy("file", "offset").collect()
    at = {}
    for r in rows:
        assert r["offset"] == at.get(r["file"], 0) and r["length"] == len(r["content"].encode())
        at[r["file"]] = r["offset"] + r["length"]
        head, body = r["content"].split("\r\n\r\n", 1)
        assert hashlib.sha256(body[:-4].encode()).hexdigest() in head


def test_damage_is_located(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    records = X.warc_records(pages)
    assert found(records, records) == []
    ids = sorted(r["page_id"] for r in pages.collect())
    altered, lost = ids[3:40:9], ids[5:30:11]
    other = records.filter(~F.col("record_id").isin(lost)).withColumn(
        "content", F.when(F.col("record_id").isin(altered), F.concat("content", F.lit("x"))).otherwise(F.col("content")))
    place = {r["record_id"]: (r["file"], r["offset"]) for r in records.collect()}
    want = sorted(((*place[i], i, s) for s, group in (("altered", altered), ("missing", lost)) for i in group), key=str)
    assert found(records, other) == want
    assert found(records, other, file_bytes=1 << 18) == want  # fewer levels, several roots a file
    assert found(other, records) == sorted(((f, o, i, {"missing": "extra"}.get(s, s)) for f, o, i, s in want), key=str)


def test_a_replica_has_one_root_and_equal_ones_read_nothing_else(spark):
    many = spark.range(3000).selectExpr("concat('file-', id % 700) as file", "(id div 700) * 100000 as offset", "id as record_id", "concat('c', id) as content")
    first, second = X.tree(many), X.tree(many.repartition(5))
    assert len(first) == X.levels_for() + 1 + X.NAME_DIGITS + 1
    assert first[-1].count() == 1 and first[-1].first()["n"] == 3000 and first[-1].first()["hash"] == second[-1].first()["hash"]
    counts = [level.count() for level in first[X.levels_for():]]
    assert counts[0] == 700 and counts == sorted(counts, reverse=True) and counts[-2:] == [16, 1]
    assert X.audit(first, second).count() == 0
    other = X.tree(many.withColumn("content", F.when(F.col("record_id") == 1234, "changed").otherwise(F.col("content"))))
    rows = X.audit(first, other).collect()
    assert [(r["file"], r["offset"], r["record_id"], r["state"]) for r in rows] == [("file-534", 100000, 1234, "altered")]
    # the branch down to it alone is read
    bad = X._differ(first[-1], other[-1])
    below = X._named(first[-2], bad, 0)
    assert X._differ(below, X._named(other[-2], bad, 0)).count() == 1


def test_pages_without_ids_are_spread(spark):
    pages = spark.range(500).selectExpr("cast(null as long) as page_id", "concat('u', id) as url", "concat('h', id) as html")
    records = X.warc_records(pages)
    assert records.count() == 500 and records.select("file").distinct().count() > 300
    assert found(records, X.warc_records(pages.repartition(7))) == []


def test_only_differing_branches_are_read(spark):
    records = X.warc_records(spark.read.parquet(f"{SF}/pages.parquet"))
    tree = X.tree(records)
    bad = tree[1].limit(1).select("file", "place")
    below = X._below(tree[0], bad, X.RANGE_BYTES)
    assert 0 < below.count() < records.count()


def test_odd_records(spark):
    schema = "file string, offset long, record_id long, content string, place int, hash int, n int, up int"
    rows = [(None, 0, None, None), ("", 0, 1, ""), ("f", 0, 2, "a"), ("f", 0, 2, "a"), ("f", 10 ** 7, 3, "b" * 100_000)]
    first = spark.createDataFrame([(*r, 0, 0, 0, 0) for r in rows], schema)
    assert found(first, first) == []
    assert len(found(first, first.limit(0))) > 0 and {x[3] for x in found(first, first.limit(0))} == {"missing"}
    changed = first.withColumn("content", F.coalesce("content", F.lit("")))
    assert [x[3] for x in found(first, changed)] == ["altered"]
    pages = spark.createDataFrame([(None, None, None), (1, None, "x"), (1, "u", None)], "page_id long, url string, html string")
    assert X.warc_records(pages).count() == 3 and X.warc_records(pages.limit(0)).count() == 0
