"""Hot keys: one object / group / cluster holds most rows.  Results must equal a
brute-force evaluation of the rules, with broadcast joins disabled so the
shuffle joins (and AQE's skew splitting) are the ones exercised."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lakeops.fixtures import LADDERS
from lakeops.operators import access as A, activity as V
from lakeops.plans import strategy as J


@pytest.fixture()
def shuffle_joins(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def rank(t, lvl):
    return LADDERS[t].index(lvl) if lvl in LADDERS.get(t, []) else -1


def brute_allows(req, principals, grants):
    rid, t, oid, required, owner, user = req
    want = rank(t, required)
    if want < 0:
        return False
    admin, groups = principals.get(user, (False, []))
    if admin or (owner != "" and owner == user):
        return True
    best = -1
    for (gt, gid, pt, pid, lvl) in grants:
        if gt == t and gid == oid and ((pt == "user" and pid == user) or (pt == "group" and pid in groups)):
            best = max(best, rank(t, lvl))
    return best >= want


def test_authorize_hot_object_and_group(spark, shuffle_joins):
    rnd = random.Random(7)
    levels = LADDERS["notebook"] + ["bogus"]
    principals = {f"u{i}": (i % 50 == 0, ["everyone"] + ([f"g{i % 5}"] if i % 3 else [])) for i in range(300)}
    grants = {}
    for i in range(3000):   # a third of all grants on one object
        oid = "hot" if i % 3 == 0 else f"nb{rnd.randrange(200)}"
        pt, pid = ("group", "everyone") if i % 4 == 0 else (("group", f"g{i % 5}") if i % 4 == 1 else ("user", f"u{rnd.randrange(300)}"))
        grants[("notebook", oid, pt, pid)] = rnd.choice(levels[:-1])
    grant_rows = [(*k, v) for k, v in grants.items()]
    reqs = []
    for i in range(4000):   # and a third of all requests on it
        oid = "hot" if i % 3 == 0 else f"nb{rnd.randrange(200)}"
        user = f"u{rnd.randrange(320)}"   # u300.. are not in the directory
        reqs.append((i, "notebook", oid, rnd.choice(levels), user if i % 97 == 0 else "", user))
    g = spark.createDataFrame(grant_rows, "object_type string, object_id string, principal_type string, "
                                          "principal_id string, level string")
    p = spark.createDataFrame([(u, a, gs) for u, (a, gs) in principals.items()],
                              "username string, admin boolean, groups array<string>")
    r = spark.createDataFrame(reqs, "request_id long, object_type string, object_id string, required string, "
                                    "owner string, username string")
    got = {row.request_id: row.allowed for row in A.authorize(r, p, g).collect()}
    want = {req[0]: brute_allows(req, principals, grant_rows) for req in reqs}
    assert got == want
    assert 0 < sum(want.values()) < len(want)


def test_cluster_events_hot_cluster(spark, shuffle_joins):
    rnd = random.Random(3)
    clusters = [(i, f"qs-{i}") for i in range(50)] + [(99, "qs-1-server")]
    events = []
    for i in range(3000):
        cid = 1 if i % 3 else rnd.randrange(60)    # two thirds on qs-1
        suffix = rnd.choice(["", "-server", "-exec-1", "x"])
        events.append((i, f"qs-{cid}{suffix}", "Normal", "r", "m", None, "2024-01-01T00:00:00Z"))
    ev = spark.createDataFrame(events, "event_id long, object string, type string, reason string, message string, "
                                       "cnt long, last_seen string")
    cl = spark.createDataFrame(clusters, "id long, cr_name string")
    got = sorted((r.cluster_id, r.event_id) for r in V.cluster_events(ev, cl).collect())
    want = sorted((cid, e[0]) for e in events for cid, cr in clusters
                  if e[1] == cr or e[1].startswith(cr + "-"))
    assert got == want


def test_hot_grant_key_is_split_against_aggregated_grants(spark):
    """The grants come from an aggregate on the join's keys, where AQE does not split; the salt does."""
    keep = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "40", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in keep}
    try:
        for k, v in keep.items():
            spark.conf.set(k, v)
        log = spark.range(5000).selectExpr("'notebook' as object_type", "if(id % 3 = 0, 'hot', concat('nb', id)) as object_id",
                                           "'group' as principal_type", "'everyone' as principal_id", "'view' as level",
                                           "id as grant_seq", "timestamp_ntz'2024-01-01' as created_at")
        grants = A.current_grants(log)
        pairs = spark.range(30000).selectExpr("concat('u', id) as username", "'notebook' as object_type",
                                              "if(id % 3 = 0, 'hot', concat('nb', id)) as object_id")
        exp = pairs.withColumn("principal_type", F.lit("group")).withColumn("principal_id", F.lit("everyone"))
        hot = J.hot_keys(pairs.withColumn("one", F.lit(1)), ["object_type", "object_id"], "one")
        assert [r.object_id for r in hot.collect()] == ["hot"]
        joins = {"plain": exp.join(grants, A.GRANT_KEY, "left"),
                 "salted": J.salted_join(exp, grants, A.GRANT_KEY, hot, F.col("username"))}
        largest = {}
        for name, df in joins.items():
            assert df.filter("level = 'view' and object_id = 'hot'").count() == 10000
            per = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
            largest[name] = max(r["count"] for r in per)
        assert largest["plain"] >= 10000 and largest["salted"] < 2500
        plan = A.authorize(pairs.withColumns({"request_id": F.monotonically_increasing_id(), "owner": F.lit(""), "required": F.lit("view")}),
                           spark.createDataFrame([], "username string, admin boolean, groups array<string>"), grants)
        text = plan._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in text.splitlines() if re.search(r"Join \[.*_part#\d+\], \[.*_part#\d+\]", line)]
        assert len(joins) == 2   # pairs with grants, requests with their pair's verdict
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
