"""Streams over several micro-batches equal their batch forms."""

import datetime as dt
import os
import re
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lakeops.operators import activity as V
from lakeops.session import shared_dir
from lakeops.plans.q_streams import run_idle
from lakeops.streaming import idle as I, streams as S

T0 = dt.datetime(2024, 1, 1)


def write_batches(rows_per_batch):
    d = tempfile.mkdtemp(prefix="lakeops-stream-")
    for i, rows in enumerate(rows_per_batch):
        cols = list(zip(*rows))
        path = f"{d}/batch{i:03d}.parquet"
        pq.write_table(pa.table({"cluster_id": pa.array(cols[0], pa.int64()),
                                 "ts": pa.array(cols[1], pa.timestamp("us"))}), path)
        os.utime(path, (1_700_000_000 + 10 * i, 1_700_000_000 + 10 * i))   # files arrive in this order
    return d


def activity_batches():
    # three files, each a micro-batch; cluster 1 is busy, 2 has a long gap, 3 appears late
    b0 = [(1, T0 + dt.timedelta(minutes=m)) for m in range(0, 60, 5)] + [(2, T0)]
    b1 = [(1, T0 + dt.timedelta(minutes=60 + m)) for m in range(0, 60, 10)] + [(2, T0 + dt.timedelta(hours=5))]
    # the last file also carries a touch from 00:30, behind the watermark by then
    b2 = [(3, T0 + dt.timedelta(hours=6)), (1, T0 + dt.timedelta(hours=9)), (2, T0 + dt.timedelta(hours=12)),
          (1, T0 + dt.timedelta(minutes=30))]
    return [b0, b1, b2]


def test_last_activity_over_batches(spark):
    d = write_batches(activity_batches())
    stream = S.file_stream(spark, d, max_files_per_trigger=1)
    log = S.run_to_log(S.stream_last_activity(stream), shared_dir(spark, "test_stream_last"))
    got = {r.cluster_id: r.last_activity_at for r in S.latest(spark.read.parquet(log), ["cluster_id"]).collect()}
    want = {r.cluster_id: r.last_activity_at for r in V.last_activity(spark.read.parquet(d)).collect()}
    assert got == want
    assert spark.read.parquet(log).select("_batch").distinct().count() == 3


def test_idle_sessions_over_batches(spark):
    d = write_batches(activity_batches())
    clusters = spark.createDataFrame([(1, "Running", False, '{"idle_minutes": 30}'),
                                      (2, "Running", False, '{"idle_minutes": 60}'),
                                      (3, "Stopped", False, '{"idle_minutes": 60}')],
                                     "id long, desired_state string, pinned boolean, config string")
    stream = S.file_stream(spark, d, max_files_per_trigger=1)
    log = S.run_to_log(S.stream_idle(stream, clusters), shared_dir(spark, "test_stream_idle"), output_mode="append")
    sessions = spark.read.parquet(log)
    got = sorted((r.cluster_id, r.first_at, r.last_at, r.touches) for r in sessions.collect())
    # Closed by the watermark (latest event 12:00 minus 1 hour): cluster 1's
    # two sessions and cluster 2's first two; cluster 3 is stopped.  The 00:30
    # touch arrives behind the watermark but its session is still held in
    # state in that batch, so it is merged before the session is emitted.
    want = [(1, T0, T0 + dt.timedelta(minutes=110), 19),
            (1, T0 + dt.timedelta(hours=9), T0 + dt.timedelta(hours=9), 1), (2, T0, T0, 1),
            (2, T0 + dt.timedelta(hours=5), T0 + dt.timedelta(hours=5), 1)]
    assert got == want
    ep = S.idle_episodes(sessions.withColumn("session_start", F.col("session.start")), F.lit(T0 + dt.timedelta(hours=3)))
    assert sorted((r.cluster_id, r.idle_at) for r in ep.collect()) == [
        (1, T0 + dt.timedelta(minutes=140)), (2, T0 + dt.timedelta(hours=1))]


def test_windowed_cluster_events_over_batches(spark):
    d = tempfile.mkdtemp(prefix="lakeops-stream-ev-")
    batches = [
        [(1, "qs-1-server", "Normal", T0 + dt.timedelta(minutes=1)), (2, "qs-1", "Warning", T0 + dt.timedelta(minutes=3)),
         (3, "qs-10-exec-1", "Normal", T0 + dt.timedelta(minutes=12))],
        [(4, "qs-1-exec-2", "warning", T0 + dt.timedelta(minutes=14)), (5, "other", "Normal", T0 + dt.timedelta(minutes=15))],
        [(6, "qs-10", "Normal", T0 + dt.timedelta(minutes=25)), (7, "qs-1-server", "Normal", T0 + dt.timedelta(minutes=9))],
    ]
    for i, rows in enumerate(batches):
        cols = list(zip(*rows))
        path = f"{d}/batch{i:03d}.parquet"
        pq.write_table(pa.table({"event_id": pa.array(cols[0], pa.int64()), "object": pa.array(cols[1]),
                                 "type": pa.array(cols[2]), "last_seen": pa.array(cols[3], pa.timestamp("us"))}), path)
        os.utime(path, (1_700_000_000 + 10 * i, 1_700_000_000 + 10 * i))
    clusters = spark.createDataFrame([(1, "qs-1"), (10, "qs-10")], "id long, cr_name string")
    stream = S.file_stream(spark, d, max_files_per_trigger=1)
    log = S.run_to_log(S.stream_cluster_events(stream, clusters), shared_dir(spark, "test_stream_events"))
    got = sorted((r.cluster_id, r.window_start, r.events, r.warnings)
                 for r in S.latest(spark.read.parquet(log), ["cluster_id", "window_start"]).collect())
    w = dt.timedelta(minutes=10)
    assert got == [(1, T0, 3, 1), (1, T0 + w, 1, 1), (10, T0 + w, 1, 0), (10, T0 + 2 * w, 1, 0)]


def test_change_log_is_compacted_under_replay(spark):
    d = write_batches(activity_batches())
    out = shared_dir(spark, "test_compact")

    def run():
        return S.run_to_log(S.stream_last_activity(S.file_stream(spark, d, max_files_per_trigger=1)), out)

    def state():
        return {r.cluster_id: r.last_activity_at for r in S.current(spark, out, ["cluster_id"]).collect()}

    log = run()
    want = {r.cluster_id: r.last_activity_at for r in V.last_activity(spark.read.parquet(d)).collect()}
    assert state() == want and S.compact(spark, out, ["cluster_id"]) == 2 and state() == want
    assert S.compact(spark, out, ["cluster_id"]) is None
    # what is read is the base: one row a key, and no partition of the log
    plan = S.current(spark, out, ["cluster_id"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*_batch.* > 2\)", plan) and "/base/" in plan
    # a replayed old batch changes nothing, whatever it holds
    spark.createDataFrame([(1, T0), (9, T0)], "cluster_id long, last_activity_at timestamp_ntz").write.mode(
        "overwrite").parquet(f"{log}/_batch=1")
    assert state() == want
    # the tail after the base counts, a replayed batch of it once
    later = spark.createDataFrame([(1, T0 + dt.timedelta(days=1))], "cluster_id long, last_activity_at timestamp_ntz")
    for _ in range(2):
        later.write.mode("overwrite").parquet(f"{log}/_batch=3")
    want[1] = T0 + dt.timedelta(days=1)
    assert state() == want
    assert S.compact(spark, out, ["cluster_id"]) == 3 and state() == want
    later.withColumn("last_activity_at", F.lit(T0 + dt.timedelta(days=2))).write.parquet(f"{log}/_batch=4")
    assert S.compact(spark, out, ["cluster_id"]) == 4
    want[1] = T0 + dt.timedelta(days=2)
    assert S.expire(spark, out) == 5 and state() == want
    assert {r[0] for r in spark.read.parquet(log).select("_batch").distinct().collect()} == {4}


def test_base_of_a_failed_compaction_is_not_read(spark):
    d = write_batches(activity_batches())
    out = shared_dir(spark, "test_compact")
    S.run_to_log(S.stream_last_activity(S.file_stream(spark, d, max_files_per_trigger=1)), out)
    want = sorted(map(tuple, S.current(spark, out, ["cluster_id"]).collect()))
    spark.createDataFrame([(7, T0, 2)], "cluster_id long, last_activity_at timestamp_ntz, _batch long").write.parquet(
        shared_dir(spark, "base"))
    assert sorted(map(tuple, S.current(spark, out, ["cluster_id"]).collect())) == want


def test_final_windows_in_append_mode_and_late_rows_aside(spark):
    out = shared_dir(spark, "test_gate")
    m = lambda x: T0 + dt.timedelta(minutes=x)
    schema = "event_id long, object string, type string, last_seen timestamp_ntz"
    deliveries = [
        [(1, "qs-1-server", "Normal", m(1)), (2, "qs-1", "Warning", m(3)), (3, "qs-10-exec-1", "Normal", m(75))],
        # the clock stands at 75: windows that ended by 15 are over, so 4 is late and 5 is not
        [(4, "qs-1", "Normal", m(9)), (5, "qs-1-exec-2", "warning", m(14)), (6, "qs-10", "Normal", m(200)), (7, "qs-1", "Normal", None)],
        [(8, "qs-1", "Normal", m(75)), (9, "qs-10", "Normal", m(139)), (10, "qs-10", "Normal", m(140)), (11, "other", "Normal", m(2))],
    ]
    clusters = spark.createDataFrame([(1, "qs-1"), (10, "qs-10")], "id long, cr_name string")
    seen = []

    def windows():
        stream = S.stream_cluster_events(S.landed(spark, out, schema), clusters, ticks=S.tick_stream(spark, f"{out}/ticks"))
        log = S.run_to_log(stream, f"{out}/windows", output_mode="append")
        return sorted((r.cluster_id, (r.window_start - T0).seconds // 60, r.events, r.warnings) for r in spark.read.parquet(log).collect())

    S.write_tick(spark, f"{out}/ticks", F.lit("1970-01-01 00:00:00"))
    for rows in deliveries:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{out}/feed")
        S.run_gate(spark.readStream.schema(schema).parquet(f"{out}/feed"), out)
        seen.append(windows())
    S.write_tick(spark, f"{out}/ticks", F.lit(m(10_000)))
    seen.append(windows())
    assert seen[0] == [(1, 0, 2, 1)]                       # only that window is final
    assert seen[1] == [(1, 0, 2, 1), (1, 10, 1, 1), (10, 70, 1, 0)]
    assert seen[2] == seen[1]
    assert seen[3] == sorted(seen[2] + [(10, 200, 1, 0), (10, 140, 1, 0)])
    aside = sorted((r.event_id, r.kind, r._batch) for r in S.set_aside(spark, out).collect())
    assert aside == [(4, "late", 1), (7, "untimed", 1), (8, "late", 2), (9, "late", 2), (11, "late", 2)]


def test_idle_due_with_state_equals_the_batch_rule(spark):
    rows = [(1, "Running", False, '{"idle_minutes": 30}', T0), (2, "Running", False, '{"idle_minutes": 60}', T0),
            (3, "Stopped", False, '{"idle_minutes": 60}', T0), (4, "Running", False, '{"idle_minutes": 60}', T0),
            (5, "Running", True, '{"idle_minutes": 60}', T0), (6, "Running", False, '{"idle_minutes": 90}', None),
            (7, "Running", None, '{"idle_minutes": 1}', T0 + dt.timedelta(days=40)), (8, "Running", False, "bad", T0)]
    clusters = spark.createDataFrame(rows, "id long, desired_state string, pinned boolean, config string, created_at timestamp_ntz")
    out = shared_dir(spark, "test_idle_due")
    feed = f"{out}/feed"
    m = lambda x: T0 + dt.timedelta(minutes=x)
    steps = [([(1, m(0)), (2, m(0))], 20), ([(1, m(25))], 60), ([], 61), ([(1, m(70)), (4, m(62)), (9, m(5))], 100),
             ([(6, m(90)), (4, m(63))], 181), ([(2, m(400))], 400), ([(1, m(3)), (None, m(399))], 60 * 24 * 60)]
    for touches, now in steps:
        spark.createDataFrame(touches, "cluster_id long, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(feed)
        S.write_tick(spark, f"{out}/ticks", F.lit(m(now)))
        run_idle(spark, spark.readStream.schema("cluster_id long, ts timestamp_ntz").parquet(feed), clusters, out)
        batch = V.idle_due(clusters, V.last_activity(spark.read.parquet(feed)), F.lit(m(now)))
        got = sorted((r.cluster_id, r.last_activity_at, r.idle_minutes) for r in S.current(spark, out, ["cluster_id"]).filter("due").collect())
        assert got == sorted((r.id, r.last_activity_at, r.idle_minutes) for r in batch.collect()), now


def test_idle_due_follows_registry_changes(spark):
    clusters = spark.createDataFrame([(1, "Running", False, '{"idle_minutes": 30}', T0)],
                                     "id long, desired_state string, pinned boolean, config string, created_at timestamp_ntz")
    out = shared_dir(spark, "test_idle_changes")
    m = lambda x: T0 + dt.timedelta(minutes=x)
    schema = "id long, desired_state string, pinned boolean, config string, created_at timestamp_ntz, changed_at timestamp_ntz"
    window = '{"idle_minutes": 30}'
    steps = [([], 40, {1}), ([(1, "Running", True, window, T0, m(41))], 50, set()),
             ([(1, "Running", True, window, T0, m(51)), (1, "Running", False, window, T0, m(52)), (2, "Running", False, window, m(50), m(50))], 60, {1}),
             ([], 90, {1, 2}), ([(2, "Stopped", False, window, m(50), m(91))], 95, {1})]
    none = spark.createDataFrame([], "cluster_id long, ts timestamp_ntz")
    none.write.parquet(f"{out}/feed")
    for k, v in I.STATE_STORE.items():
        spark.conf.set(k, v)
    for changes, now, due in steps:
        spark.createDataFrame(changes, schema).coalesce(1).write.mode("append").parquet(f"{out}/changes")
        S.write_tick(spark, f"{out}/ticks", F.lit(m(now)))
        stream = I.stream_idle_due(spark.readStream.schema(none.schema).parquet(f"{out}/feed"), clusters,
                                   S.tick_stream(spark, f"{out}/ticks"), spark.readStream.schema(schema).parquet(f"{out}/changes"))
        S.run_to_log(stream, out)
        assert {r.cluster_id for r in S.current(spark, out, ["cluster_id"]).filter("due").collect()} == due
    for k in I.STATE_STORE:
        spark.conf.unset(k)


def test_idle_due_keeps_one_state_for_many_clusters(spark):
    # text ids, one row without an id, one row twice; clusters 0, 5, 10... are touched
    m = lambda x: T0 + dt.timedelta(minutes=x)
    rows = [(f"c{i}", "Stopped" if i % 7 == 0 else "Running", i % 11 == 0, f'{{"idle_minutes": {i % 90}}}', m(i % 4) if i % 13 else None)
            for i in range(300)] + [(None, "Running", False, '{"idle_minutes": 20}', T0)]
    schema = "id string, desired_state string, pinned boolean, config string, created_at timestamp_ntz"
    registry = spark.createDataFrame(rows, schema)
    out = shared_dir(spark, "test_idle_parts")
    feed = f"{out}/feed"
    before = {k: spark.conf.get(k, None) for k in I.STATE_STORE}
    for k, v in I.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        for touches, now in [([(f"c{i}", m(i % 60)) for i in range(0, 310, 5)] + [(None, m(50)), ("c5", None)], 45),
                             ([("c5", m(70)), ("c1", m(71)), ("c299", m(72))], 100)]:
            spark.createDataFrame(touches, "cluster_id string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(feed)
            S.write_tick(spark, f"{out}/ticks", F.lit(m(now)))
            stream = I.stream_idle_due(spark.readStream.schema("cluster_id string, ts timestamp_ntz").parquet(feed),
                                       registry.union(registry.limit(1)), S.tick_stream(spark, f"{out}/ticks"), parts=8)
            S.run_to_log(stream, out)
            batch = V.idle_due(registry, V.last_activity(spark.read.parquet(feed)), F.lit(m(now)))
            got = sorted((str(r.cluster_id), r.last_activity_at, r.idle_minutes)
                         for r in S.current(spark, out, ["cluster_id"]).filter("due").collect())
            assert got == sorted((str(r.id), r.last_activity_at, r.idle_minutes) for r in batch.collect()), now
        held = spark.read.format("statestore").option("stateVarName", "clusters").load(f"{out}/checkpoint")
        sizes = [len(r[0]) for r in held.select("value.id").collect()]
        assert len(sizes) == 9 and sum(sizes) == 303            # 8 parts and the row without an id; c300 and c305 are not in the registry
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
