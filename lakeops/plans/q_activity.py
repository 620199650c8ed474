"""Registered activity queries: A4, J1, J4, I1, I2, N2, R7 and status badges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeops.fixtures import fixture
from lakeops.functions import exprs as X
from lakeops.operators import activity as V
from lakeops.plans.catalogue import query

# Fixed evaluation time for the idle rule (the data ends 2024-01-30).
NOW = "2024-01-31 00:00:00"
TAIL_LINES = 20


def merged_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.status_merge(fixture(spark, sf_dir, "fx_clusters"), fixture(spark, sf_dir, "fx_live"))


_MERGED = """
WITH merged AS (
  SELECT c.id, c.desired_state, l.live_phase,
    CASE WHEN l.id IS NULL THEN 'Unknown' ELSE COALESCE(NULLIF(l.live_phase, ''), c.phase) END AS phase,
    COALESCE(l.id IS NOT NULL AND contains(translate(lower(COALESCE(l.live_phase, '')), ' -_', ''), 'ready')
      AND NOT contains(translate(lower(COALESCE(l.live_phase, '')), ' -_', ''), 'notready'), false) AS ready
  FROM fx_clusters c LEFT JOIN fx_live l ON l.id = c.id),
badged AS (
  SELECT *, regexp_replace(COALESCE(phase, ''), '^\\s+|\\s+$', '', 'g') AS p FROM merged)
"""


@query("status_merge", _MERGED + "SELECT id, live_phase, phase, ready FROM merged")
def q_status_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_status(spark, sf_dir).select("id", "live_phase", "phase", "ready")


@query("phase_badge", _MERGED + """
SELECT id, CASE WHEN ready THEN 'ready' WHEN lower(p) IN ('', 'unknown') THEN 'unknown'
  WHEN contains(lower(p), 'running') THEN 'running' WHEN contains(lower(p), 'fail') OR contains(lower(p), 'error') THEN 'failed'
  ELSE 'pending' END AS kind,
 CASE WHEN ready THEN 'Ready' WHEN lower(p) IN ('', 'unknown') THEN 'Unknown' ELSE p END AS label
FROM badged""")
def q_phase_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = merged_status(spark, sf_dir)
    b = X.phase_badge(F.col("phase"), F.col("ready"))
    return m.select("id", b["kind"].alias("kind"), b["label"].alias("label"))


@query("is_terminal", _MERGED + """
SELECT id, desired_state = 'Stopped' OR ready OR COALESCE(phase = 'Running', false) AS terminal FROM merged""")
def q_is_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = merged_status(spark, sf_dir)
    return m.select("id", X.is_terminal("desired_state", "ready", "phase").alias("terminal"))


@query("ready_state", """
SELECT id, phase,
 contains(translate(lower(phase), ' -_', ''), 'ready') AND NOT contains(translate(lower(phase), ' -_', ''), 'notready') AS ready
FROM fx_clusters""")
def q_ready_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "fx_clusters").select("id", "phase", X.ready_state("phase").alias("ready"))


@query("last_activity", """
SELECT cluster_id, max(ts) AS last_activity_at FROM fx_activity GROUP BY cluster_id""")
def q_last_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.last_activity(fixture(spark, sf_dir, "fx_activity"))


_IDLE = f"""
WITH la AS (SELECT cluster_id, max(ts) AS last_activity_at FROM fx_activity GROUP BY cluster_id),
c AS (
  SELECT c.*, COALESCE(la.last_activity_at, c.created_at) AS last_activity_at,
    CASE WHEN json_type(c.config, '$.idle_minutes') IN ('UBIGINT', 'BIGINT')
         THEN CAST(json_extract(c.config, '$.idle_minutes') AS BIGINT) ELSE 0 END AS idle_minutes
  FROM fx_clusters c LEFT JOIN la ON la.cluster_id = c.id),
due AS (
  SELECT id, idle_minutes, last_activity_at FROM c
  WHERE desired_state = 'Running' AND NOT pinned AND idle_minutes > 0
    AND TIMESTAMP '{NOW}' > last_activity_at + to_minutes(idle_minutes))
"""


@query("idle_due", _IDLE + "SELECT * FROM due")
def q_idle_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    la = V.last_activity(fixture(spark, sf_dir, "fx_activity"))
    d = V.idle_due(fixture(spark, sf_dir, "fx_clusters"), la, X.ntz(NOW))
    return d.select("id", "idle_minutes", "last_activity_at")


@query("idle_apply", _IDLE + """
SELECT id, CASE WHEN id IN (SELECT id FROM due) THEN 'Stopped' ELSE desired_state END AS desired_state,
 CASE WHEN id IN (SELECT id FROM due) THEN 'Stopped' ELSE desired_state END AS desired_state_again
FROM fx_clusters""")
def q_idle_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = fixture(spark, sf_dir, "fx_clusters")
    la = V.last_activity(fixture(spark, sf_dir, "fx_activity"))
    once = V.idle_apply(clusters, V.idle_due(clusters, la, X.ntz(NOW)))
    # Rerun on the new state: nothing is Running-and-due any more, so no change.
    twice = V.idle_apply(once, V.idle_due(once, la, X.ntz(NOW)))
    return once.select("id", "desired_state").join(
        twice.select("id", F.col("desired_state").alias("desired_state_again")), "id")


@query("unknown_touches", """
SELECT cluster_id, count(*) AS touches FROM fx_activity
WHERE cluster_id NOT IN (SELECT id FROM fx_clusters WHERE desired_state <> 'Stopped') GROUP BY cluster_id""")
def q_unknown_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the stopped clusters have been taken out of the registry
    clusters = fixture(spark, sf_dir, "fx_clusters").filter(F.col("desired_state") != "Stopped")
    return V.unknown_touches(fixture(spark, sf_dir, "fx_activity"), clusters)


@query("event_times", """
SELECT f.event_id, CASE WHEN f.event_id % 10 IN (3, 4, 5) THEN NULL WHEN f.event_id % 10 = 6 THEN e.ts - INTERVAL 2 HOUR ELSE e.ts END AS seen_at
FROM fx_event_times f JOIN events e ON e.event_id = f.event_id""")
def q_event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeops.streaming.streams import wall_clock_of
    # as wall clock time in UTC, whatever zone the session has
    return fixture(spark, sf_dir, "fx_event_times").select("event_id", wall_clock_of(X.parse_time_or_null(F.col("seen"))).alias("seen_at"))


@query("cluster_events", """
SELECT c.id AS cluster_id, c.cr_name, e.event_id, e.object, e.type, e.reason, e.message,
 CAST(COALESCE(e.cnt, 0) AS BIGINT) AS count, e.last_seen, COALESCE(lower(e.type) = 'warning', false) AS warning
FROM fx_cluster_events e JOIN fx_clusters c ON e.object = c.cr_name OR starts_with(e.object, c.cr_name || '-')""")
def q_cluster_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = V.cluster_events(fixture(spark, sf_dir, "fx_cluster_events"),
                          fixture(spark, sf_dir, "fx_clusters").select("id", "cr_name"))
    return ev.select("cluster_id", "cr_name", "event_id", "object", "type", "reason", "message",
                     "count", "last_seen", "warning")


@query("log_tail", f"""
SELECT cluster_id, line_no, line FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY line_no DESC) AS rn FROM fx_log_lines)
WHERE rn <= {TAIL_LINES}""")
def q_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.log_tail(fixture(spark, sf_dir, "fx_log_lines"), n=TAIL_LINES).orderBy("cluster_id", "line_no")


@query("log_tail_default", f"""
SELECT cluster_id, line_no, line FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY line_no DESC) AS rn FROM fx_log_lines)
WHERE rn <= {V.LOG_TAIL_LINES}""")
def q_log_tail_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The default tail length (500 lines per driver).
    return V.log_tail(fixture(spark, sf_dir, "fx_log_lines")).orderBy("cluster_id", "line_no")


@query("age_label", f"""
WITH la AS (SELECT cluster_id, max(ts) AS ts FROM fx_activity GROUP BY cluster_id),
s AS (SELECT c.id, la.ts, greatest(0, CAST(floor(epoch(TIMESTAMP '{NOW}' - la.ts)) AS BIGINT)) AS secs
      FROM fx_clusters c LEFT JOIN la ON la.cluster_id = c.id)
SELECT id, CASE WHEN ts IS NULL THEN '—' WHEN secs < 60 THEN CAST(secs AS VARCHAR) || 's'
  WHEN secs // 60 < 60 THEN CAST(secs // 60 AS VARCHAR) || 'm'
  WHEN secs // 3600 < 24 THEN CAST(secs // 3600 AS VARCHAR) || 'h'
  ELSE CAST(secs // 86400 AS VARCHAR) || 'd' END AS age FROM s""")
def q_age_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    la = V.last_activity(fixture(spark, sf_dir, "fx_activity")).withColumnRenamed("cluster_id", "id")
    c = fixture(spark, sf_dir, "fx_clusters").select("id").join(la, "id", "left")
    return c.select("id", X.age_label(F.col("last_activity_at"), X.ntz(NOW)).alias("age"))
