"""Cluster activity: last touch, idle detection, status merge, event and log feeds.

A4 last_activity, J1 status_merge, J4 cluster_events, I1 idle_due,
I2 idle_apply, N2 log_tail, R7 flag_warnings.

Activity is aggregated to one row per cluster *before* it meets the cluster
registry, so a cluster holding a third of all touches costs one partial
aggregate, not a skewed join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakeops.functions import exprs as X

# Fixed value: lines of driver log a tail returns by default.
LOG_TAIL_LINES = 500


def last_activity(activity: DataFrame, key: str = "cluster_id", ts: str = "ts") -> DataFrame:
    """(key, last_activity_at): latest touch per cluster (A4)."""
    return activity.groupBy(key).agg(F.max(ts).alias("last_activity_at"))


def unknown_touches(activity: DataFrame, clusters: DataFrame, key: str = "cluster_id", id_col: str = "id") -> DataFrame:
    """(key, touches): touches of clusters that the registry does not have, which a touch reports as not found (A4).

    Touches are counted per cluster before they meet the registry.
    """
    counted = activity.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("touches"))
    return counted.join(clusters.select(F.col(id_col).alias(key)), key, "left_anti")


def status_merge(clusters: DataFrame, live: DataFrame, key: str = "id") -> DataFrame:
    """Registry rows with the live phase merged in.

    A live phase overrides the stored phase when non-empty; a cluster without
    a live resource reports ``Unknown`` and is not ready.
    """
    lv = live.select(key, F.col("live_phase"), F.lit(True).alias("_live"))
    j = clusters.join(lv, key, "left")
    has_live = F.coalesce(F.col("_live"), F.lit(False))
    phase = (F.when(~has_live, F.lit(X.UNKNOWN_LABEL))
             .otherwise(F.coalesce(F.nullif(F.col("live_phase"), F.lit("")), F.col("phase"))))
    ready = has_live & X.ready_state(F.col("live_phase"))
    return j.withColumn("phase", phase).withColumn("ready", ready).drop("_live")


def object_prefixes(obj: Column) -> Column:
    """Every '-'-bounded prefix of a name plus the name itself.

    ``qs-1-server`` -> [qs, qs-1, qs-1-server].  A cluster ``cr`` owns an
    event when the object equals ``cr`` or starts with ``cr-``, i.e. exactly
    when ``cr`` is one of these prefixes.
    """
    parts = F.split(obj, "-", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "-"))


#: An idle window that long (1,900 years) is never over; it keeps the interval within its type.
MOST_MINUTES = 1_000_000_000


def flag_warnings(events: DataFrame, type_col: str = "type") -> DataFrame:
    """Adds ``warning``: the event type is Warning, any case."""
    return events.withColumn("warning", F.coalesce(F.lower(F.col(type_col)) == "warning", F.lit(False)))


def cluster_events(events: DataFrame, clusters: DataFrame) -> DataFrame:
    """Events attributed to clusters by object name.

    ``events``: event_id, object, type, reason, message, cnt, last_seen
    (timestamp, or RFC 3339 text which is parsed, bad text -> NULL).
    ``clusters``: id, cr_name.  The prefix match is rewritten as an equi-join
    on the exploded prefixes of the distinct object names, so the planner uses
    hash joins instead of a nested loop over (events x clusters), and events with
    their messages are not multiplied.
    """
    names = events.select("object").distinct().withColumn("_cand", F.explode(object_prefixes(F.col("object"))))
    cl = clusters.select(F.col("cr_name").alias("_cand"), F.col("id").alias("cluster_id"), "cr_name")
    j = events.join(names.join(cl, "_cand").drop("_cand"), "object")
    if dict(j.dtypes).get("last_seen") == "string":
        j = j.withColumn("last_seen", X.parse_time_or_null(F.col("last_seen")))
    j = j.withColumn("count", F.coalesce(F.col("cnt"), F.lit(0)).cast("long")).drop("cnt")
    return flag_warnings(j)


def idle_due(clusters: DataFrame, activity_last: DataFrame, now: Column, key: str = "id",
             activity_key: str = "cluster_id") -> DataFrame:
    """Clusters to stop at ``now``.

    Running, not pinned, idle_minutes > 0, and ``now - last_activity`` strictly
    greater than the window.  Last activity falls back to ``created_at`` when
    the registry carries it and the cluster was never touched.
    """
    la = activity_last.select(F.col(activity_key).alias(key), "last_activity_at")
    j = clusters.join(la, key, "left")
    if "created_at" in clusters.columns:
        j = j.withColumn("last_activity_at", F.coalesce("last_activity_at", "created_at"))
    idle = X.idle_minutes_of(F.col("config"))
    due = ((F.col("desired_state") == "Running") & ~F.coalesce(F.col("pinned"), F.lit(False)) & (idle > 0)
           & (now > F.col("last_activity_at") + F.make_dt_interval(mins=F.least(idle, F.lit(MOST_MINUTES)).cast("int"))))
    return j.withColumn("idle_minutes", idle).filter(F.coalesce(due, F.lit(False)))


def idle_apply(clusters: DataFrame, due: DataFrame, key: str = "id") -> DataFrame:
    """Due clusters get desired_state Stopped; others unchanged (I2).  Idempotent."""
    d = due.select(key).distinct().withColumn("_due", F.lit(True))
    j = clusters.join(d, key, "left")
    out = [F.when(F.col("_due"), F.lit("Stopped")).otherwise(F.col(c)).alias(c) if c == "desired_state"
           else F.col(c) for c in clusters.columns]
    return j.select(*out)


TAIL_PARTS = 32


def log_tail(lines: DataFrame, n: int = LOG_TAIL_LINES, key: str = "cluster_id",
             order_col: str = "line_no") -> DataFrame:
    """Last ``n`` lines per driver, in original order.

    ``row_number() <= n`` over a descending order plans as a WindowGroupLimit,
    which keeps only ``n`` rows per key on the map side before the shuffle.  The
    lines of a key are first cut to ``n`` in each of ``TAIL_PARTS`` parts, so that the map
    tasks' leftovers of a hot key do not all meet in one task.
    """
    part = F.pmod(F.xxhash64(order_col), F.lit(TAIL_PARTS))
    some = Window.partitionBy(key, "_part").orderBy(F.col(order_col).desc())
    w = Window.partitionBy(key).orderBy(F.col(order_col).desc())
    return (lines.withColumn("_part", part).withColumn("_rn", F.row_number().over(some)).filter(F.col("_rn") <= n)
            .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn", "_part"))
