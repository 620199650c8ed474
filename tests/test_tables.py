"""Writes, round trip, sampling and verification."""

import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from lakeops.session import shared_dir
from lakeops.sources import tables as TB

SCHEMA = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType(), False),
                       T.StructField("ts", T.TimestampNTZType(), False)])
ROWS = [(20, "oak", dt.datetime(1999, 12, 31, 23, 59, 59)), (21, "elm", dt.datetime(2000, 2, 29, 6, 0, 1)),
        (35, "ash", dt.datetime(2031, 7, 4, 0, 0, 0))]


def test_roundtrip_three_rows(spark):
    df = TB.rows_to_view(spark, ROWS, SCHEMA, "trees")
    back, diff = TB.roundtrip(df, shared_dir(spark, "test_roundtrip"))
    assert diff.count() == 0
    got = [tuple(r) for r in TB.normalize_times(TB.scan_ordered(back, ["id", "name", "ts"], ["id"])).collect()]
    assert got == [(20, "oak", "1999-12-31 23:59:59"), (21, "elm", "2000-02-29 06:00:01"),
                   (35, "ash", "2031-07-04 00:00:00")]


def test_replace_is_idempotent_and_append_by_name(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = shared_dir(spark, "test_replace")
    TB.replace_rows(df, path)
    TB.replace_rows(df, path)
    assert TB.read_table(spark, path).count() == 3
    TB.append_rows(df.select("ts", "id", "name"), path)
    assert TB.read_table(spark, path).count() == 6
    assert TB.verify_rows(TB.read_table(spark, path), df.unionByName(df)).count() == 0


def test_verify_reports_both_sides(spark):
    a = spark.createDataFrame(ROWS, SCHEMA)
    e = spark.createDataFrame([ROWS[0], ROWS[1], (35, "ASH", ROWS[2][2])], SCHEMA)
    sides = sorted((r.name, r.side) for r in TB.verify_rows(a, e).collect())
    assert sides == [("ASH", "missing"), ("ash", "unexpected")]


def test_sample_size_rules(spark):
    assert [TB.sample_size(x) for x in (None, "abc", 0, -5, "7", 250)] == [100, 100, 100, 100, 7, 250]
    df = spark.range(1000)
    assert TB.table_sample(df, "x", order_by=["id"]).count() == 100
    empty = TB.table_sample(df.filter("id < 0"), 5)
    assert empty.columns == ["id"] and empty.count() == 0


def test_create_namespace_and_table(spark):
    TB.create_namespace(spark, "lakeops_test_ns")
    TB.create_namespace(spark, "lakeops_test_ns")
    loc = shared_dir(spark, "test_table")
    TB.create_table(spark, "lakeops_test_ns.demo", SCHEMA, location=loc)
    TB.create_table(spark, "lakeops_test_ns.demo", SCHEMA, location=loc)
    assert spark.table("lakeops_test_ns.demo").columns == ["id", "name", "ts"]
    bad = spark.createDataFrame([(1, None, None)], "id long, name string, ts timestamp_ntz")
    assert sorted(r.column for r in TB.null_violations(bad, SCHEMA).collect()) == ["name", "ts"]
    stored = spark.table("lakeops_test_ns.demo").schema
    assert all(f.nullable for f in stored.fields)                     # Parquet reports nullable
    assert TB.required_columns(stored) == ["id", "name", "ts"]        # the flags survive
    with_nulls = spark.createDataFrame([(None, "a", None)], stored)
    assert sorted(r.column for r in TB.null_violations(with_nulls).collect()) == ["id", "ts"]


def test_build_session_applies_catalog_conf(spark):
    from lakeops.session import build_session
    s = build_session({"spark.sql.catalog.lake.type": "rest"})
    assert s.conf.get("spark.sql.catalog.lake.type") == "rest"
    assert s.conf.get("spark.sql.adaptive.enabled") == "true"


def test_keyed_tables_join_without_shuffle(spark):
    from pyspark.sql import functions as F
    from lakeops.operators import registry as G
    TB.create_namespace(spark, "lakeops_keyed")
    base = spark.range(0, 2000).select(F.col("id"), (F.col("id") % 7).alias("v"))
    changes = spark.range(0, 2000, 3).select(F.col("id"), F.lit(1).alias("v"))
    TB.write_keyed(base, "lakeops_keyed.base", ["id"], 8, location=shared_dir(spark, "keyed_base"))
    TB.write_keyed(changes, "lakeops_keyed.changes", ["id"], 8, location=shared_dir(spark, "keyed_changes"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # force the shuffle-join path
    try:
        table, _ = G.update_by_key(spark.table("lakeops_keyed.base"), spark.table("lakeops_keyed.changes"), ["id"])
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        want = sum(1 for i in range(2000) if i % 3 == 0 or i % 7 == 1)
        assert table.filter("v = 1").count() == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_named_table_binds_the_name(spark):
    import pytest
    spark.range(3).createOrReplaceTempView("lakeops_named")
    assert TB.named_table(spark, "lakeops_named").count() == 3
    with pytest.raises(Exception):
        TB.named_table(spark, "lakeops_named; DROP TABLE x").count()
    assert TB.table_sample(TB.named_table(spark, "lakeops_named"), 2, order_by=["id"]).count() == 2


def _filled(spark, partition=()):
    import uuid
    name = f"lakeops_named_{uuid.uuid4().hex[:8]}"
    TB.create_table(spark, name, SCHEMA, partition_by=partition, location=shared_dir(spark, "test_named"))
    TB.create_table(spark, name, SCHEMA)   # there already
    TB.append_table(spark.createDataFrame(ROWS, SCHEMA).select("ts", "id", "name"), name)
    return name


def _rows(spark, name):
    return sorted(tuple(r) for r in spark.table(name).select("id", "name", "ts").collect())


@pytest.mark.parametrize("partition", [(), ("name",)])
def test_a_named_table_is_filled_and_replaced(spark, partition):
    name = _filled(spark, partition)
    assert _rows(spark, name) == sorted(ROWS)
    new = spark.createDataFrame([("fir", 7, ROWS[0][2]), ("elm", 8, ROWS[1][2])], "name string, id int, ts timestamp_ntz")
    first = TB.replace_table(new, name)
    assert _rows(spark, name) == [(7, "fir", ROWS[0][2]), (8, "elm", ROWS[1][2])]
    second = TB.replace_table(spark.table(name).filter("id = 7"), name)   # from its own rows
    assert _rows(spark, name) == [(7, "fir", ROWS[0][2])] and first != second
    TB.append_table(spark.createDataFrame(ROWS[:1], SCHEMA), name)
    assert _rows(spark, name) == [(7, "fir", ROWS[0][2]), ROWS[0]]
    assert TB.required_columns(spark.table(name).schema) and set(spark.table(name).schema.names) == {"id", "name", "ts"}


def test_a_failed_write_leaves_the_named_table(spark):
    name = _filled(spark)
    fails = spark.createDataFrame(ROWS, SCHEMA).withColumn("id", F.expr("if(id = 35, raise_error('lost'), id)"))
    nulls = spark.createDataFrame([(1, None, None)], "id long, name string, ts timestamp_ntz")
    for write in (TB.replace_table, TB.append_table):
        with pytest.raises(Exception, match="lost"):
            write(fails, name)
        with pytest.raises(ValueError, match="NULLs in required columns"):
            write(nulls, name)
        with pytest.raises(ValueError, match="missing columns"):
            write(spark.createDataFrame(ROWS, SCHEMA).drop("ts"), name)
        with pytest.raises(ValueError, match="unknown columns"):
            write(spark.createDataFrame(ROWS, SCHEMA).withColumn("x", F.lit(1)), name)
        assert _rows(spark, name) == sorted(ROWS)


def test_upsert_rewrites_only_touched_parts(spark):
    from lakeops.operators.registry import upsert_latest
    from lakeops.sources import keyed as K, versions
    schema = "k long, v string, seq long, created_at timestamp_ntz"
    base = spark.range(400).selectExpr("id as k", "concat('old', id) as v", "cast(null as long) as seq", "timestamp_ntz'2024-01-01' as created_at")
    path = shared_dir(spark, "test_keyed")
    K.create(base, path, ["k"], 16)
    day = dt.datetime(2024, 2, 1)
    changes = spark.createDataFrame([(3, "new3", 5, day, False), (3, "newer3", 6, day, False), (3, "late", 1, day, False),
                                     (1000, "added", 2, day, False), (7, None, 9, day, True)], f"{schema}, gone boolean")
    before = {r["part"]: r["place"] for r in versions.newest(spark, path, K._PLACES)[1].collect()}
    old = K.read(spark, path, schema)
    touched = K.upsert(changes, path, schema, ["k"], 16, "seq", gone=F.col("gone"))
    after = {r["part"]: r["place"] for r in versions.newest(spark, path, K._PLACES)[1].collect()}
    assert touched == sorted({r[0] for r in changes.select(K.part_of(["k"], 16)).collect()}) and len(touched) <= 3
    assert {p for p in before if before[p] != after[p]} == set(touched) and len(before) == 16
    want = upsert_latest(base.filter("k <> 7"), changes.filter("not gone").drop("gone"), ["k"], "seq")
    got = K.read(spark, path, schema)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert old.count() == 400   # a reader of the older version goes on
    # parts that are not touched are not read
    read = K.read(spark, path, schema, touched).inputFiles()
    assert read and all(any(f"_part={p}/" in f for p in touched) for f in read)
    # a job that fails leaves the version
    with pytest.raises(Exception, match="lost"):
        K.upsert(changes.drop("gone").withColumn("v", F.expr("if(k = 3, raise_error('lost'), v)")), path, schema, ["k"], 16, "seq")
    assert sorted(map(str, K.read(spark, path, schema).collect())) == sorted(map(str, got.collect()))
    # the second of two writers of one version fails
    with pytest.raises(Exception):
        versions.add(spark.createDataFrame([(0, "x")], K._PLACES), path, 1)
    K.upsert(spark.createDataFrame([], f"{schema}"), path, schema, ["k"], 16, "seq")
    assert K.read(spark, path, schema).count() == got.count()
