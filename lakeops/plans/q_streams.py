"""Registered streaming queries: X1-X3 run to completion over the events file.

Each query streams the whole events table (``availableNow``), lands its
micro-batch output as a change log in shared storage and returns the change
log reduced to the latest row per key, which the batch oracle then checks.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeops.fixtures import FIXTURES, fixture, render
from lakeops.functions import exprs as X
from lakeops.plans.catalogue import query
from lakeops.session import shared_dir
from lakeops.streaming import idle as I, streams as S

NOW = "2024-01-31 00:00:00"
_STREAM_VIEW = "lakeops_events_stream"


#: Files of a backlog that make one micro-batch.
FILES_A_BATCH = 64


def stream_fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture whose ``events`` input is a stream over the events file."""
    view = f"{_STREAM_VIEW}_{uuid.uuid4().hex[:12]}"
    S.file_stream(spark, f"{sf_dir}/events.parquet", FILES_A_BATCH).createOrReplaceTempView(view)
    try:
        return spark.sql(re.sub(r"\bevents\b", view, render(FIXTURES[name], "spark")))
    finally:
        spark.catalog.dropTempView(view)


@query("stream_last_activity", """
SELECT cluster_id, max(ts) AS last_activity_at FROM fx_activity GROUP BY cluster_id""")
def q_stream_last_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = S.stream_last_activity(stream_fixture(spark, sf_dir, "fx_activity"))
    log = S.run_to_log(agg, shared_dir(spark, "stream_last_activity"))
    return S.latest(spark.read.parquet(log), ["cluster_id"])


@query("stream_compacted_log", """
SELECT cluster_id, max(ts) AS last_activity_at FROM fx_activity GROUP BY cluster_id""")
def q_stream_compacted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The touches in two deliveries, the log compacted after each; the second base comes from the first and a tail."""
    out = shared_dir(spark, "stream_compacted_log")
    touches = fixture(spark, sf_dir, "fx_activity")
    for clicks in (True, False):
        touches.filter((F.col("action") == "click") == F.lit(clicks)).write.mode("append").parquet(f"{out}/feed")
        S.run_to_log(S.stream_last_activity(spark.readStream.schema(touches.schema).parquet(f"{out}/feed")), out)
        S.compact(spark, out, ["cluster_id"])
    return S.current(spark, out, ["cluster_id"])


@query("stream_cluster_events", """
SELECT c.id AS cluster_id, time_bucket(INTERVAL '10 minutes', e.last_seen) AS window_start,
  time_bucket(INTERVAL '10 minutes', e.last_seen) + INTERVAL '10 minutes' AS window_end,
  count(*) AS events, CAST(sum(CASE WHEN lower(e.type) = 'warning' THEN 1 ELSE 0 END) AS BIGINT) AS warnings
FROM fx_cluster_events e JOIN fx_clusters c ON e.object = c.cr_name OR starts_with(e.object, c.cr_name || '-')
GROUP BY ALL""")
def q_stream_cluster_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "stream_cluster_events")
    events = stream_fixture(spark, sf_dir, "fx_cluster_events")
    S.run_gate(events, out)
    return _final_windows(spark, sf_dir, out, events.schema)


def _final_windows(spark: SparkSession, sf_dir: str, out: str, schema) -> DataFrame:
    """The windows of the gate's on-time rows, in append mode; a last tick closes them all."""
    clusters = fixture(spark, sf_dir, "fx_clusters").select("id", "cr_name")
    for tick in ("1970-01-01 00:00:00", "2100-01-01 00:00:00"):
        S.write_tick(spark, f"{out}/ticks", F.lit(tick))
        windows = S.stream_cluster_events(S.landed(spark, out, schema, FILES_A_BATCH), clusters,
                                          ticks=S.tick_stream(spark, f"{out}/ticks"))
        log = S.run_to_log(windows, f"{out}/windows", output_mode="append")
    return spark.read.parquet(log).drop("_batch")


_LATE = f"""
WITH first AS (SELECT max(last_seen) - INTERVAL {S.WATERMARK_DELAY} AS clock FROM fx_cluster_events WHERE reason <> 'click'),
e AS (SELECT f.*, f.reason = 'click' AND time_bucket(INTERVAL '10 minutes', f.last_seen) + INTERVAL '10 minutes' <= first.clock AS late
      FROM fx_cluster_events f, first)
"""


def _late_feed(spark: SparkSession, sf_dir: str, out: str) -> DataFrame:
    """Events in two deliveries through the gate: the clicks come after all others."""
    events = fixture(spark, sf_dir, "fx_cluster_events")
    for clicks in (False, True):
        events.filter((F.col("reason") == "click") == F.lit(clicks)).write.mode("append").parquet(f"{out}/feed")
        S.run_gate(spark.readStream.schema(events.schema).parquet(f"{out}/feed"), out)
    return events


@query("stream_late_events", _LATE + "SELECT event_id, 'late' AS kind FROM e WHERE late")
def q_stream_late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "stream_late_events")
    _late_feed(spark, sf_dir, out)
    return S.set_aside(spark, out).select("event_id", "kind")


@query("stream_final_windows", _LATE + """
SELECT c.id AS cluster_id, time_bucket(INTERVAL '10 minutes', e.last_seen) AS window_start,
  time_bucket(INTERVAL '10 minutes', e.last_seen) + INTERVAL '10 minutes' AS window_end,
  count(*) AS events, CAST(sum(CASE WHEN lower(e.type) = 'warning' THEN 1 ELSE 0 END) AS BIGINT) AS warnings
FROM e JOIN fx_clusters c ON e.object = c.cr_name OR starts_with(e.object, c.cr_name || '-')
WHERE NOT e.late GROUP BY ALL""")
def q_stream_final_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "stream_final_windows")
    events = _late_feed(spark, sf_dir, out)
    return _final_windows(spark, sf_dir, out, events.schema)


@query("stream_idle_due", f"""
WITH la AS (SELECT cluster_id, max(ts) AS at FROM fx_activity GROUP BY cluster_id),
c AS (SELECT f.id, f.desired_state, f.pinned, coalesce(la.at, f.created_at) AS last_activity_at,
        CASE WHEN json_type(config, '$.idle_minutes') IN ('UBIGINT', 'BIGINT')
             THEN CAST(json_extract(config, '$.idle_minutes') AS BIGINT) ELSE 0 END AS idle_minutes
      FROM fx_clusters f LEFT JOIN la ON la.cluster_id = f.id)
SELECT id AS cluster_id, last_activity_at, idle_minutes FROM c
WHERE desired_state = 'Running' AND NOT coalesce(pinned, false) AND idle_minutes > 0
  AND TIMESTAMP '{NOW}' > last_activity_at + to_minutes(idle_minutes)""")
def q_stream_idle_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "stream_idle_due")
    clusters = fixture(spark, sf_dir, "fx_clusters")
    for tick in ("1970-01-01 00:00:00", NOW):
        S.write_tick(spark, f"{out}/ticks", F.lit(tick))
        run_idle(spark, stream_fixture(spark, sf_dir, "fx_activity"), clusters, out)
    return (S.current(spark, out, ["cluster_id"]).filter("due").select("cluster_id", "last_activity_at", "idle_minutes"))


def run_idle(spark: SparkSession, activity: DataFrame, clusters: DataFrame, out: str) -> str:
    """Run the idle stream over what there is, with the state store it needs."""
    before = {k: spark.conf.get(k, None) for k in I.STATE_STORE}
    for k, v in I.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        return S.run_to_log(I.stream_idle_due(activity, clusters, S.tick_stream(spark, f"{out}/ticks")), out)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@query("stream_idle", f"""
WITH el AS (
  SELECT id, CASE WHEN json_type(config, '$.idle_minutes') IN ('UBIGINT', 'BIGINT')
                  THEN CAST(json_extract(config, '$.idle_minutes') AS BIGINT) ELSE 0 END AS idle
  FROM fx_clusters WHERE desired_state = 'Running' AND NOT coalesce(pinned, false)),
a AS (SELECT a.cluster_id, a.ts, el.idle FROM fx_activity a JOIN el ON el.id = a.cluster_id WHERE el.idle > 0),
g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + to_minutes(idle) THEN 1 ELSE 0 END AS brk
      FROM a WINDOW w AS (PARTITION BY cluster_id ORDER BY ts)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY cluster_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT cluster_id, min(ts) AS first_at, max(ts) AS last_at, max(ts) + to_minutes(any_value(idle)) AS idle_at,
  count(*) AS touches FROM s GROUP BY cluster_id, sid
HAVING max(ts) + to_minutes(any_value(idle)) < TIMESTAMP '{NOW}'""")
def q_stream_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "stream_idle")
    # the traffic first, then the clock: a tick one watermark delay after NOW closes what ended before NOW
    for tick in (F.lit("1970-01-01 00:00:00"), F.expr(f"timestamp_ntz'{NOW}' + INTERVAL {S.WATERMARK_DELAY}")):
        S.write_tick(spark, f"{out}/ticks", tick)
        sessions = S.stream_idle(stream_fixture(spark, sf_dir, "fx_activity"), fixture(spark, sf_dir, "fx_clusters"),
                                 ticks=S.tick_stream(spark, f"{out}/ticks"))
        log = S.run_to_log(sessions, out, output_mode="append")
    latest = S.latest(spark.read.parquet(log).withColumn("session_start", F.col("session.start")).drop("session"),
                      ["cluster_id", "session_start"])
    return S.idle_episodes(latest, X.ntz(NOW))
