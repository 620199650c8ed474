"""Idle rule, status merge, event attribution and log tail."""

import datetime as dt

from pyspark.sql import functions as F

from lakeops.functions import exprs as X
from lakeops.operators import activity as V

NOW = dt.datetime(2024, 1, 31, 12, 0, 0)


def test_idle_due(spark):
    """A cluster is due just if it runs, is not pinned, has a window, and its last touch is longer ago."""
    cases = [(state, pinned, window, ago) for state in ("Running", "Stopped") for pinned in (None, False, True)
             for window in (0, 45, 3_000_000_000) for ago in (44, 45, 46)]
    clusters = spark.createDataFrame([(f"k{i}", s, p, '{"idle_minutes": %d}' % w) for i, (s, p, w, _) in enumerate(cases)],
                                     "id string, desired_state string, pinned boolean, config string")
    act = spark.createDataFrame([(f"k{i}", (NOW - dt.timedelta(minutes=c[3])).isoformat(sep=" ")) for i, c in enumerate(cases)],
                                "cluster_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = {f"k{i}" for i, (s, p, w, ago) in enumerate(cases) if s == "Running" and not p and 0 < w < ago}
    due = V.idle_due(clusters, V.last_activity(act), X.ntz(NOW))
    assert {r.id for r in due.collect()} == want
    once = V.idle_apply(clusters, due)
    twice = V.idle_apply(once, V.idle_due(once, V.last_activity(act), X.ntz(NOW)))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert {r.id for r in once.filter("desired_state = 'Stopped'").collect()} == want | {
        f"k{i}" for i, c in enumerate(cases) if c[0] == "Stopped"}


def test_idle_minutes_strict_json(spark):
    df = spark.createDataFrame([('{"idle_minutes": 30}',), ('{"idle_minutes": "30"}',), ('{bad',), (None,),
                                ('{"idle_minutes": 1.5}',)], "c string")
    assert [r.m for r in df.select(X.idle_minutes_of("c").alias("m")).collect()] == [30, 0, 0, 0, 0]


def test_events_filtered_by_cluster_name(spark):
    ev = spark.createDataFrame(
        [(1, "qs-c1-server", "Normal", "Scheduled", "msg", None, "2024-01-01T00:00:00Z"),
         (2, "unrelated-x", "Normal", "Other", "msg", 3, "bad time"),
         (3, "qs-c10-server", "Warning", "Failed", "msg", 2, "2024-01-01T00:00:00+02:00"),
         (4, "qs-c1", "warning", "Killing", "msg", 1, "")],
        "event_id long, object string, type string, reason string, message string, cnt long, last_seen string")
    cl = spark.createDataFrame([(1, "qs-c1"), (10, "qs-c10")], "id long, cr_name string")
    out = V.cluster_events(ev, cl)
    rows = {(r.cluster_id, r.event_id): r for r in out.collect()}
    assert set(rows) == {(1, 1), (10, 3), (1, 4)}
    assert rows[(1, 1)].reason == "Scheduled" and rows[(1, 1)]["count"] == 0
    assert rows[(1, 4)].last_seen is None and rows[(1, 4)].warning is True
    assert rows[(10, 3)].last_seen is not None
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_status_merge_and_badges(spark):
    clusters = spark.createDataFrame([(1, "Pending"), (2, "Pending"), (3, "Failed")], "id long, phase string")
    live = spark.createDataFrame([(1, "Ready"), (2, "")], "id long, live_phase string")
    m = V.status_merge(clusters, live)
    b = X.phase_badge(F.col("phase"), F.col("ready"))
    rows = {r.id: (r.phase, r.ready, r.kind, r.label)
            for r in m.select("id", "phase", "ready", b["kind"].alias("kind"), b["label"].alias("label")).collect()}
    assert rows[1] == ("Ready", True, "ready", "Ready")
    assert rows[2] == ("Pending", False, "pending", "Pending")
    assert rows[3] == ("Unknown", False, "unknown", "Unknown")


def test_ready_state_rules(spark):
    df = spark.createDataFrame([("Ready",), ("ReadyState",), ("NotReady",), ("Not Ready",), ("not_ready",), ("",), (None,)],
                               "p string")
    assert [r.r for r in df.select(X.ready_state("p").alias("r")).collect()] == [True, True, False, False, False,
                                                                                False, False]


def test_log_tail_keeps_last_lines_in_order(spark):
    lines = spark.createDataFrame([(1, i, f"l{i}") for i in range(10)] + [(2, 0, "x")],
                                  "cluster_id long, line_no long, line string")
    got = [(r.cluster_id, r.line_no) for r in V.log_tail(lines, 3).orderBy("cluster_id", "line_no").collect()]
    assert got == [(1, 7), (1, 8), (1, 9), (2, 0)]
