"""Scalar, map and JSON expressions against the reference's cases."""

import datetime as dt

from pyspark.sql import functions as F

from lakeops.functions import exprs as X
from lakeops.operators.claims import principals_from_claims


def one(spark, col, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(col).collect()]


def test_phase_badge_order(spark):
    data = [(" Running ", False), ("unknown", False), ("CrashLoopError", False), ("Submitted", False),
            ("Failed", True), (None, False)]
    b = X.phase_badge(F.col("p"), F.col("r"))
    got = [(r.k, r.l) for r in spark.createDataFrame(data, "p string, r boolean")
           .select(b["kind"].alias("k"), b["label"].alias("l")).collect()]
    assert got == [("running", "Running"), ("unknown", "Unknown"), ("failed", "CrashLoopError"),
                   ("pending", "Submitted"), ("ready", "Ready"), ("unknown", "Unknown")]


def test_is_terminal(spark):
    got = one(spark, X.is_terminal("d", "r", "p"),
              [("Stopped", False, ""), ("Running", True, ""), ("Running", False, "Running"), ("Running", False, "running")],
              "d string, r boolean, p string")
    assert got == [True, True, True, False]


def test_age_label(spark):
    now = dt.datetime(2024, 1, 31, 0, 0, 0)
    ts = [now - dt.timedelta(seconds=s) for s in (5, 59, 60, 3599, 3600, 86399, 86400, -30)]
    df = spark.createDataFrame([(t.isoformat(sep=" "),) for t in ts] + [(None,)], "t string")
    got = [r[0] for r in df.select(X.age_label(F.col("t").cast("timestamp_ntz"), X.ntz(now))).collect()]
    assert got == ["5s", "59s", "1m", "59m", "1h", "23h", "1d", "0s", "—"]


def test_resource_summary(spark):
    df = spark.createDataFrame([(("500m", "1", "1Gi", "2Gi"),), (("2", "", "", "4Gi"),), (None,)],
                               "r struct<cpu_request:string,cpu_limit:string,memory_request:string,memory_limit:string>")
    got = [r[0] for r in df.select(X.resource_summary("r")).collect()]
    assert got == ["500m→1 · 1Gi→2Gi", "2→— · —→4Gi", "—"]


def test_slug_and_cr_name(spark):
    got = one(spark, X.slug("n"), [("My Cluster!",), ("---",), ("a" * 60,), ("a" * 50 + "-b",), ("Ünïcode ok",)], "n string")
    assert got == ["my-cluster", "cluster", "a" * 51, "a" * 50, "n-code-ok"]
    cr = one(spark, X.cr_name(F.col("n"), F.lit("k")), [("Prod",)], "n string")[0]
    assert cr.startswith("qs-prod-") and len(cr) == len("qs-prod-") + 8


def test_display_name(spark):
    got = one(spark, X.display_name("n", "p"),
              [("  Named ", "/a/b"), ("", "/Reports/Q1"), (None, "Loose"), ("", "///"), ("", "/x/  ")],
              "n string, p string")
    assert got == ["Named", "Q1", "Loose", "Untitled", "Untitled"]


def test_parse_time_or_null(spark):
    got = one(spark, X.parse_time_or_null("t"),
              [("2024-01-01T12:00:00Z",), ("2024-01-01T12:00:00+02:00",), ("2024-01-01",), ("garbage",), (None,)],
              "t string")
    assert got[0] is not None and got[1] is not None and got[2:] == [None, None, None]


def test_config_normalize_defaults_and_clamps(spark):
    cfgs = ['{"name":"  prod ","worker_min":-1,"worker_max":0,"idle_minutes":-5,'
            '"spark_conf":{"a":"1"," b ":"2","":"x"," a":"3"}}',
            '{"worker_min":"3","driver":{"cpu_request":" 2 ","cpu_limit":""}}',
            'not json']
    df = spark.createDataFrame([(c,) for c in cfgs], "c string").select(X.config_normalize("c").alias("n"))
    rows = df.select("n.name", "n.worker_min", "n.worker_max", "n.idle_minutes", "n.driver.cpu_request",
                     "n.driver.cpu_limit", X.entries_text(F.col("n.spark_conf")).alias("conf")).collect()
    assert tuple(rows[0]) == ("prod", 0, 0, 0, "500m", "1", "a=3,b=2")
    assert tuple(rows[1]) == ("", 3, 3, 30, "2", "", "")
    assert tuple(rows[2]) == ("", 1, 2, 30, "500m", "1", "")


def test_conf_merge_autoscaling(spark):
    df = spark.createDataFrame([({"spark.sql.defaultCatalog": "lake"}, 2, 5), ({"x": "1"}, 0, 0),
                                ({"spark.dynamicAllocation.enabled": "false"}, 1, 3)],
                               "user map<string,string>, wmin int, wmax int")
    base = F.create_map(F.lit("x"), F.lit("base"), F.lit("y"), F.lit("base"))
    rows = df.select(X.conf_merge(base, F.col("user"), F.col("wmin"), F.col("wmax"), F.lit(1)).alias("m")).collect()
    m0, m1, m2 = (r.m for r in rows)
    assert m0["spark.dynamicAllocation.minExecutors"] == "2" and m0["spark.dynamicAllocation.maxExecutors"] == "5"
    assert m0["spark.dynamicAllocation.enabled"] == "true" and m0["spark.sql.defaultCatalog"] == "lake"
    assert m1 == {"x": "1", "y": "base"}
    assert m2["spark.dynamicAllocation.enabled"] == "false"


def test_prefix_keys_and_prune_blank(spark):
    df = spark.createDataFrame([({"team": "data"}, {"cpu": "1", "memory": ""}), ({}, {"cpu": ""})],
                               "t map<string,string>, r map<string,string>")
    rows = df.select(X.prefix_keys("t", "lakeops/").alias("a"), X.prune_blank("r").alias("b")).collect()
    assert rows[0].a == {"lakeops/team": "data"} and rows[0].b == {"cpu": "1"}
    assert rows[1].b is None


def test_claims(spark):
    claims = ['{"preferred_username":"alice","sub":"s1","realm_access":{"roles":["lake_admin","viewer"]}}',
              '{"sub":"s2","realm_access":{"roles":["other_role"]},"groups":["g1",2,"g2"]}',
              '{"sub":"s3"}', '{"sub":"s4","realm_access":{"roles":["lake_admin",1]}}',
              '{"preferred_username":"","sub":"s5","realm_access":{"roles":["lake_admin"]}}',
              '{"sub":"s6","realm_access":{"roles":["lake_admin",null]}}']
    df = spark.createDataFrame(list(enumerate(claims)), "claim_id long, claims string")
    rows = {r.claim_id: r for r in principals_from_claims(df, "lake_admin").collect()}
    assert rows[0].status == "ok" and rows[0].username == "alice" and rows[0].roles == ["lake_admin", "viewer"]
    assert rows[1].status == "missing_role" and rows[1].groups == ["g1", "g2"]
    assert rows[2].status.startswith("invalid:realm_access")
    assert rows[3].status == "invalid:roles contains non-string element"
    assert rows[4].status == "ok" and rows[4].username == "s5"
    assert rows[5].status == "invalid:roles contains non-string element"


def test_cell_text(spark):
    df = spark.createDataFrame([(None, {"k": 1}, [1, 2], 1.5)], "a string, m map<string,int>, l array<int>, d double")
    row = X.cell_text_frame(df).first()
    assert tuple(row) == ("NULL", '{"k":1}', "[1,2]", "1.5")


def test_blank_null_and_quote(spark):
    got = spark.createDataFrame([("",), ("x",), (None,)], "s string").select(
        X.blank_to_null("s").alias("n"), X.null_to_blank(X.blank_to_null("s")).alias("b")).collect()
    assert [tuple(r) for r in got] == [(None, ""), ("x", "x"), (None, "")]
    assert X.quote_ident("we`ird") == "`we``ird`"


def test_staged_normalize_equals_expression(spark):
    cfgs = ['{"name":" a ","worker_min":"4","spark_conf":{"x":"1"," x":"2"},"env":{"K":3},"tags":"bad"}',
            '{"worker_max":7,"executor":{"memory_limit":" 8Gi "},"image":" img "}', '{}', None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cfgs)], "id long, config string")
    a = sorted(map(str, df.select("id", X.config_normalize("config").alias("cfg")).collect()))
    b = sorted(map(str, X.normalize_configs(df).select("id", "cfg").collect()))
    assert a == b
    row = X.normalize_configs(df).orderBy("id").first().cfg
    assert (row.worker_min, row.worker_max, row.spark_conf, row.env, row.tags) == (4, 4, {"x": "2"}, {"K": "3"}, {})
