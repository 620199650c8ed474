"""Structured Streaming forms of the activity operators.

The workspace polls on timers; here the same rules run continuously:

* X1 ``stream_last_activity``: running latest touch per cluster.
* X2 ``stream_idle``: idle episodes from per-cluster session windows whose
  gap is the cluster's own idle window (stream-static join for config).
* X2 with state (``streaming.idle``): clusters that fall due, the never-touched too.
* X3 ``stream_cluster_events``: events attributed to clusters (prefix join
  against the static registry) counted per tumbling window; in append mode only
  final windows come out, and :func:`run_gate` keeps late rows aside.

Each stream writes micro-batch results with ``foreachBatch`` into a change
log in shared storage, one overwritten partition per batch id, with the
checkpoint beside it: a restarted query resumes where it stopped, a replayed
batch replaces its own partition, and an executor loss only reruns tasks.
Readers reduce a change log to the latest value per key; :func:`compact` folds
its older batches into a base, so that they read the base and a short tail.
``withWatermark`` needs a TIMESTAMP column, so NTZ event times are cast for
the watermark while results keep the original NTZ values.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakeops.functions import exprs as X
from lakeops.operators.activity import MOST_MINUTES, object_prefixes
from lakeops.session import shared_dir
from lakeops.sources import versions

# Event-time lateness allowed, and the tumbling window size.
WATERMARK_DELAY = "1 hour"
EVENT_WINDOW = "10 minutes"


def file_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming reader over parquet files, schema taken from the files.

    ``path`` is a directory of files, or one file (then its directory is
    watched with a name filter, as the file source needs a directory).
    """
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if os.path.isfile(path.removeprefix("file:")):
        r = r.option("pathGlobFilter", os.path.basename(path))
        path = os.path.dirname(path)
    return r.parquet(path)


def _epoch() -> Column:
    return X.ntz("1970-01-01 00:00:00")


def instant_of(ntz_ts: Column) -> Column:
    """TIMESTAMP_NTZ -> TIMESTAMP whose UTC reading equals the NTZ wall clock.

    Independent of the session time zone (a plain cast would shift by it), so
    window boundaries line up with the NTZ values in every session.
    """
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch(), ntz_ts))


def wall_clock_of(instant: Column) -> Column:
    """Inverse of :func:`instant_of`."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), _epoch())


def _event_time(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("_et", instant_of(F.col(ts))).withWatermark("_et", WATERMARK_DELAY)


def run_to_log(agg: DataFrame, out_dir: str, output_mode: str = "update") -> str:
    """Run ``agg`` over all available input; land each batch in a change log.

    Returns the change-log path.  Each micro-batch is written to its own
    ``_batch=<id>`` partition with overwrite, so a batch replayed after a
    failure replaces its earlier attempt instead of duplicating it; readers
    get ``_batch`` back from the partition and take the latest value per key.
    """
    log_path = os.path.join(out_dir, "log")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(log_path, f"_batch={batch_id}"))

    q = (agg.writeStream.outputMode(output_mode).foreachBatch(sink)
         .option("checkpointLocation", os.path.join(out_dir, "checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return log_path


def latest(log: DataFrame, keys: list[str]) -> DataFrame:
    """Reduce a change log to the newest row per key (hash aggregate)."""
    rest = [c for c in log.columns if c not in keys and c != "_batch"]
    agg = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("_batch")).alias("_r"))
    return agg.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


_BASES = "upto long, place string"


def compact(spark: SparkSession, out_dir: str, keys: list[str]) -> int | None:
    """Fold the log's batches so far into a new base; returns the last batch in it (None: nothing new).

    The base is the newest row per key, in a folder of its own; a version file then names it and the last
    batch it holds.  A job that fails before that leaves the old base and the whole tail in force.  A
    batch that is replayed afterwards rewrites a partition which readers no longer look at.
    """
    base = versions.newest(spark, f"{out_dir}/bases", _BASES)
    log = versions.read_or_none(spark, f"{out_dir}/log")
    top = None if log is None else log.agg(F.max("_batch")).first()[0]
    if top is None or base is not None and top <= base[0]:
        return None
    place = shared_dir(spark, "base")
    current(spark, out_dir, keys, with_batch=True).write.parquet(place)
    versions.add(spark.range(1).select(F.lit(int(top)).alias("upto"), F.lit(place).alias("place")), f"{out_dir}/bases", int(top))
    return int(top)


def current(spark: SparkSession, out_dir: str, keys: list[str], with_batch: bool = False) -> DataFrame:
    """The newest row per key of the change log: its base and the batches after it."""
    log = spark.read.parquet(f"{out_dir}/log").withColumn("_batch", F.col("_batch").cast("long"))
    base = versions.newest(spark, f"{out_dir}/bases", _BASES)
    if base is not None:
        row = base[1].first()
        log = spark.read.parquet(row["place"]).unionByName(log.filter(F.col("_batch") > row["upto"]))
    out = latest(log.withColumn("_at", F.col("_batch")) if with_batch else log, keys)
    return out.withColumnRenamed("_at", "_batch") if with_batch else out


def expire(spark: SparkSession, out_dir: str) -> int:
    """Delete the log partitions and bases that the newest base and the one before do not need; returns how many.

    One older base stays, for readers that began before the newest one.
    """
    rows = versions.read_or_none(spark, f"{out_dir}/bases", f"{_BASES}, _v long")
    kept = rows.orderBy(F.desc("_v")).limit(2).collect() if rows is not None else []
    if len(kept) < 2:
        return 0
    upto = kept[1]["upto"]
    old = [r[0] for r in spark.read.parquet(f"{out_dir}/log").filter(F.col("_batch") <= upto).select("_batch").distinct().collect()]
    for batch in old:
        versions.remove(spark, f"{out_dir}/log/_batch={batch}")
    bases = rows.filter(F.col("_v") < kept[1]["_v"]).collect()
    for r in bases:
        versions.remove(spark, f"{out_dir}/bases/_v={r['_v']}")
        versions.remove(spark, r["place"])
    return len(old) + len(bases)


# --- X1 -----------------------------------------------------------------------------

def stream_last_activity(activity: DataFrame, key: str = "cluster_id", ts: str = "ts") -> DataFrame:
    """Streaming latest touch per cluster (X1); use with update mode."""
    return (_event_time(activity, ts).groupBy(key)
            .agg(F.max(F.col(ts)).alias("last_activity_at")))


# --- X2 -----------------------------------------------------------------------------

def write_tick(spark: SparkSession, path: str, at: Column) -> None:
    """Adds a tick of the clock, ``at`` (a timestamp without zone), to the folder that a tick stream reads."""
    spark.range(1).select(at.cast("timestamp_ntz").alias("ts")).write.mode("append").parquet(path)


def tick_stream(spark: SparkSession, path: str) -> DataFrame:
    """The ticks of :func:`write_tick` as a stream."""
    return spark.readStream.schema("ts timestamp_ntz").parquet(path)


def stream_idle(activity: DataFrame, clusters: DataFrame, key: str = "cluster_id", ts: str = "ts",
                ticks: DataFrame | None = None) -> DataFrame:
    """Activity sessions per eligible cluster, the gap being its idle window.

    A session ends ``idle_minutes`` after its last touch; every closed session
    is an idle episode whose ``idle_at`` is that end.  Only Running, unpinned
    clusters with idle_minutes > 0 take part (stream-static join).  Session
    windows run in append mode: a session is emitted once the watermark
    passes its end, i.e. once no later touch can still extend it.  ``ticks``, a
    stream of clock times, moves the watermark when there is no more traffic, so
    that the last session of every cluster is emitted too; the ticks' own
    sessions have a NULL key.
    """
    cfg = clusters.select(F.col("id").alias(key), "desired_state", "pinned",
                          X.idle_minutes_of(F.col("config")).alias("idle_minutes"))
    eligible = cfg.filter((F.col("desired_state") == "Running") & ~F.coalesce(F.col("pinned"), F.lit(False))
                                     & (F.col("idle_minutes") > 0)).select(key, "idle_minutes")
    # The watermark is taken after the stream-static join, so event time is
    # measured on the eligible clusters' touches.  (Defined before the join,
    # the optimizer would push the join's inferred key filter below the
    # watermark anyway, giving the same clock implicitly.)
    touches = activity.select(key, ts).join(eligible, key).select(key, ts, "idle_minutes")
    if ticks is not None:
        none = F.lit(None).cast(touches.schema[key].dataType)
        touches = touches.unionByName(ticks.select(none.alias(key), F.col("ts").alias(ts),
                                                   F.lit(1).cast(touches.schema["idle_minutes"].dataType).alias("idle_minutes")))
    s = _event_time(touches, ts)
    gap = F.concat(F.col("idle_minutes").cast("string"), F.lit(" minutes"))
    return (s.groupBy(key, F.session_window(F.col("_et"), gap).alias("session"))
            .agg(F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count(F.lit(1)).alias("touches"),
                 F.max("idle_minutes").alias("idle_minutes")))


def idle_episodes(sessions: DataFrame, now: Column) -> DataFrame:
    """(cluster_id, first_at, last_at, idle_at, touches): sessions idle before ``now``."""
    idle_at = F.col("last_at") + F.make_dt_interval(mins=F.least("idle_minutes", F.lit(MOST_MINUTES)).cast("int"))
    return (sessions.withColumn("idle_at", idle_at).filter((F.col("idle_at") < now) & F.col("cluster_id").isNotNull())
            .select("cluster_id", "first_at", "last_at", "idle_at", "touches"))


# --- X3 -----------------------------------------------------------------------------

def _micros(interval: str) -> int:
    amount, unit = interval.split()
    return int(amount) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1_000_000


def run_gate(events: DataFrame, out_dir: str, ts: str = "last_seen", window: str = EVENT_WINDOW,
             delay: str = WATERMARK_DELAY) -> str:
    """Land all available events, those that come too late for their window aside.

    Each batch goes to ``landed/_batch=<id>/kind=<kind>``: ``late`` if the row's window had ended ``delay``
    before the newest time of the batches before it, ``untimed`` if it has no time, else ``on_time``.  A batch's
    clock (the newest time so far) is one row beside it, from which the next one goes on, so a replayed
    batch sorts its rows as before.  Rows that pass the gate are never late for a windowed stream over
    ``on_time`` with the same delay: its watermark cannot be ahead of this clock.
    Returns the path of the on-time rows.
    """
    width, slack = _micros(window), _micros(delay)

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = versions.read_or_none(spark, f"{out_dir}/clock/_batch={batch_id - 1}", "newest long") if batch_id else None
        clock = before.first()["newest"] if before is not None else None
        at = F.unix_micros(instant_of(F.col(ts)))
        end = (F.floor(at / width) + 1) * width
        late = end <= F.lit(clock - slack) if clock is not None else F.lit(False)
        kind = F.when(at.isNull(), "untimed").when(late, "late").otherwise("on_time")
        landed = f"{out_dir}/landed/_batch={batch_id}"
        batch.withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").parquet(landed)
        rows = spark.read.schema(batch.schema).parquet(landed)
        rows.agg(F.greatest(F.max(at), F.lit(clock).cast("long")).alias("newest")).coalesce(1).write.mode("overwrite").parquet(
            f"{out_dir}/clock/_batch={batch_id}")

    q = (events.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out_dir}/gate")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{out_dir}/landed/_batch=*/kind=on_time"


def landed(spark: SparkSession, out_dir: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    """The gate's on-time rows as a stream."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(f"{out_dir}/landed/_batch=*/kind=on_time")


def set_aside(spark: SparkSession, out_dir: str) -> DataFrame:
    """The rows that the gate kept aside, with ``kind`` (late or untimed) and ``_batch``."""
    return spark.read.parquet(f"{out_dir}/landed").filter(F.col("kind") != "on_time")


def stream_cluster_events(events: DataFrame, clusters: DataFrame, ts: str = "last_seen",
                          ticks: DataFrame | None = None) -> DataFrame:
    """Per cluster and tumbling window: events and warnings.

    The prefix-explode equi-join of the batch operator against the static
    registry, then a windowed count under the watermark.  In append mode a window comes
    out once, when the watermark has passed its end; ``ticks``, a stream of clock
    times, moves the watermark when there are no more events.
    """
    if ticks is not None:
        events = events.select("object", "type", ts).unionByName(
            ticks.select(F.lit("").alias("object"), F.lit("").alias("type"), F.col("ts").alias(ts)))
    ev = _event_time(events, ts).withColumn("_cand", F.explode(object_prefixes(F.col("object"))))
    cl = clusters.select(F.col("cr_name").alias("_cand"), F.col("id").alias("cluster_id"))
    j = ev.join(cl, "_cand")
    w = F.window(F.col("_et"), EVENT_WINDOW)
    return (j.groupBy("cluster_id", w.alias("w"))
            .agg(F.count(F.lit(1)).alias("events"),
                 F.sum(F.coalesce(F.lower(F.col("type")) == "warning", F.lit(False)).cast("long")).alias("warnings"))
            .select("cluster_id", wall_clock_of(F.col("w.start")).alias("window_start"),
                    wall_clock_of(F.col("w.end")).alias("window_end"), "events", "warnings"))
