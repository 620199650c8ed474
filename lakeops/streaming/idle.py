"""X2 with state: clusters that fall idle, those never touched among them.

A cluster's state starts from the registry (creation time, idle window, whether the rule applies) and
keeps the last touch.  The clusters are dealt to a fixed number of parts by a hash of their id, and a part is a key of
``transformWithState``: its state is a row of arrays with an entry for each of its clusters, and one event-time
timer stands at the first end of an idle window among them, so that what a key costs besides its rows
(an Arrow batch, calls to the state store) is paid once for a part and not for every cluster.  The clock is a
stream of ticks: only they carry event time, so a touch is never dropped as late, and a cluster that has no
traffic at all still falls due when a tick passes its window.  Rows come out when a cluster's verdict
changes: due, due since a later touch, or due no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lakeops.functions import exprs as X
from lakeops.operators.activity import MOST_MINUTES
from lakeops.streaming.streams import instant_of, wall_clock_of

#: Needed by ``transformWithState``.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass":
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Clusters with a state in common; a checkpoint belongs to the number it was begun with.
PARTS = 4096
#: Parts of their own: the ticks, and the registry row without an id.
TICKS, NO_ID = -1, -2
#: Stands for a time that is missing, so that the columns of times have no nulls and stay whole numbers.
NEVER = -2**63
STATE = "id array<{key}>, touched array<long>, created array<long>, minutes array<long>, applies array<boolean>, told array<long>, timer long"
OUT = "cluster_id {key}, last_us long, idle_minutes long, due boolean, at_ms long"
SETTINGS = ["created", "minutes", "applies"]
UNKNOWN = {"touched": NEVER, "created": NEVER, "minutes": 0, "applies": False, "told": NEVER}


def _known(ids, **columns) -> pd.DataFrame:
    """The state of some clusters by id; columns that are not given are those of clusters not in the registry."""
    index = pd.Index(list(ids), dtype=object)
    return pd.DataFrame({c: np.asarray(columns.get(c, np.full(len(index), v)), dtype="bool" if c == "applies" else "int64")
                         for c, v in UNKNOWN.items()}, index=index)


class IdleClusters(StatefulProcessor):
    """Emits (cluster, last activity, window, due) whenever a cluster's verdict changes; a key is a part of the clusters."""

    def __init__(self, key: str, kind: str) -> None:
        self.key, self.kind = key, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("clusters", STATE.format(key=self.kind))

    def _load(self) -> tuple[pd.DataFrame, int | None]:
        found = self.state.get()
        if found is None:
            return _known([]), None
        ids, *columns, timer = found
        return _known(ids, **dict(zip(UNKNOWN, columns, strict=True))), timer

    def _decide(self, clusters: pd.DataFrame, timer: int | None, now_ms: int | None) -> Iterator[pd.DataFrame]:
        touched, created, minutes, applies, told = (clusters[c].to_numpy() for c in UNKNOWN)
        since = np.where(touched != NEVER, touched, created)
        waits = applies & (since != NEVER)
        end = since + np.clip(minutes, 0, MOST_MINUTES) * 60_000_000
        due = waits & (now_ms * 1000 > end) if now_ms is not None else np.zeros(len(end), bool)
        waits &= ~due
        wake = max(int(end[waits].min()) // 1000, (now_ms or 0) + 1) if waits.any() else None
        if timer != wake:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wake is not None:
                self.handle.registerTimer(wake)
        tells = np.where(due, since, NEVER)
        self.state.update((clusters.index.tolist(), touched.tolist(), created.tolist(), minutes.tolist(), applies.tolist(),
                           tells.tolist(), wake))
        new = tells != told
        if new.any():
            last = pd.arrays.IntegerArray(since[new], since[new] == NEVER)
            yield pd.DataFrame({"cluster_id": clusters.index[new], "last_us": last, "idle_minutes": minutes[new],
                                "due": due[new], "at_ms": now_ms})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = next(initialState.itertuples())
        ids = [None] if key[0] == NO_ID else row.id
        for _ in self._decide(_known(ids, **{c: getattr(row, c) for c in SETTINGS}), None, None):
            pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] == TICKS:
            return
        last, changes = [], []
        for part in rows:
            last.append(part[part["touched"] != NEVER].groupby(self.key)["touched"].max())
            changes.append(part[part["changed"] != NEVER])
        last = pd.concat(last).groupby(level=0).max()
        changes = pd.concat(changes).sort_values("changed", kind="stable").drop_duplicates(self.key, keep="last")
        clusters, timer = self._load()
        ids = pd.Index(last.index.tolist() + changes[self.key].tolist(), dtype=object).unique()
        clusters = pd.concat([clusters, _known(ids[~ids.isin(clusters.index)])])
        at = clusters.index.get_indexer(last.index.astype(object))
        touched = clusters["touched"].to_numpy(copy=True)
        touched[at] = np.maximum(touched[at], last.to_numpy())
        clusters["touched"] = touched
        if len(changes):
            clusters.loc[changes[self.key].tolist(), SETTINGS] = changes[SETTINGS].to_numpy()
            clusters = clusters.astype({c: "bool" if c == "applies" else "int64" for c in SETTINGS})
        yield from self._decide(clusters, timer, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        clusters, timer = self._load()
        if timer == expiredTimerInfo.getExpiryTimeInMs():
            timer = None
        yield from self._decide(clusters, timer, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _us(ts: Column) -> Column:
    return F.coalesce(F.unix_micros(instant_of(ts)), F.lit(NEVER))


def _part(key: Column, parts: int) -> Column:
    return F.when(key.isNull(), F.lit(NO_ID)).otherwise(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))


def _settings(clusters: DataFrame, key: str, *others: Column) -> DataFrame:
    """key, created, minutes and applies (Running, not pinned, a window) of each cluster."""
    minutes = F.coalesce(X.idle_minutes_of(F.col("config")).cast("long"), F.lit(0))
    created = _us(F.col("created_at")) if "created_at" in clusters.columns else F.lit(NEVER)
    applies = (F.col("desired_state") == "Running") & ~F.coalesce(F.col("pinned"), F.lit(False)) & (minutes > 0)
    return clusters.select(F.col("id").alias(key), created.alias("created"), minutes.alias("minutes"),
                           F.coalesce(applies, F.lit(False)).alias("applies"), *others)


def stream_idle_due(activity: DataFrame, clusters: DataFrame, ticks: DataFrame, changes: DataFrame | None = None,
                    key: str = "cluster_id", ts: str = "ts", parts: int = PARTS) -> DataFrame:
    """Clusters whose idle verdict changes (X2), in update mode.

    ``activity`` (a stream) has ``key`` and ``ts``; ``clusters`` is the registry at the start (one row per id);
    ``ticks`` is a stream of clock times ``ts``; ``changes``, a stream of registry rows with ``changed_at``,
    brings clusters made or altered later (of several of a cluster in a batch the latest counts).  A cluster is
    due when the clock has passed its last touch, or else its creation, by more than its window.  ``parts`` is
    the number of states that the clusters are dealt to; it stays as it is for the life of a checkpoint.
    """
    first = _settings(clusters, key)
    kind = first.schema[key].dataType
    null, never = F.lit(None), F.lit(NEVER)
    feed = activity.select(F.col(key).cast(kind).alias(key), _us(F.col(ts)).alias("touched"), null.cast("timestamp").alias("_et"))
    config = {"created": never, "minutes": F.lit(0).cast("long"), "applies": F.lit(False), "changed": never}
    feed = feed.withColumns(config)
    if changes is not None:
        rows = _settings(changes, key, _us(F.col("changed_at")).alias("changed"))
        feed = feed.unionByName(rows.withColumns({"touched": never, "_et": null.cast("timestamp")}))
    feed = feed.filter(F.col(key).isNotNull()).withColumn("_part", _part(F.col(key), parts))
    clock = ticks.select(null.cast(kind).alias(key), never.alias("touched"), instant_of(F.col("ts")).alias("_et"))
    feed = feed.unionByName(clock.withColumns(config).withColumn("_part", F.lit(TICKS)))
    held = F.collect_list(F.struct(F.col(key).alias("id"), *SETTINGS))
    first = first.dropDuplicates([key]).groupBy(_part(F.col(key), parts).alias("_part")).agg(held.alias("_held")).select(
        "_part", *[F.col(f"_held.{c}") for c in ("id", *SETTINGS)])
    out = (feed.withWatermark("_et", "0 seconds").groupBy("_part")
           .transformWithStateInPandas(IdleClusters(key, kind.simpleString()), OUT.format(key=kind.simpleString()), "Update",
                                       "EventTime", initialState=first.groupBy("_part")))
    clock = wall_clock_of(F.timestamp_millis(F.col("at_ms")))
    return out.select(F.col("cluster_id").alias(key), wall_clock_of(F.timestamp_micros(F.col("last_us"))).alias("last_activity_at"),
                      "idle_minutes", "due", clock.alias("decided_at"))
