"""Registered table queries: T4-T9 (writes go to the shared checkpoint folder)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeops.functions import exprs as X
from lakeops.fixtures import table
from lakeops.plans.catalogue import query
from lakeops.session import shared_dir
from lakeops.sources import tables as TB

_DEMO = "SELECT event_id AS id, event_type AS name, ts FROM events"


def demo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round-trip table shape (id, name, ts) over the whole events table."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("id"), F.col("event_type").alias("name"), "ts", "value")


@query("replace_rows", _DEMO)
def q_replace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "replace_rows")
    rows = demo_rows(spark, sf_dir)
    TB.replace_rows(rows.filter(F.col("value") < 100).drop("value"), path)   # an older version
    TB.replace_rows(rows.drop("value"), path)                                # replaces it whole
    return TB.read_table(spark, path)


@query("append_rows", _DEMO)
def q_append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "append_rows")
    rows = demo_rows(spark, sf_dir)
    TB.replace_rows(rows.filter(F.col("value") < 250).drop("value"), path)
    TB.append_rows(rows.filter(F.col("value") >= 250).select("ts", "name", "id"), path)  # by name
    return TB.read_table(spark, path)


@query("named_table", _DEMO)
def q_named_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table made by name, filled, replaced whole and appended to, then read by its name."""
    rows = demo_rows(spark, sf_dir)
    name = f"lakeops_demo_{uuid.uuid4().hex[:12]}"
    TB.create_table(spark, name, rows.drop("value").schema, location=shared_dir(spark, "named_table"))
    try:
        TB.append_table(rows.filter(F.col("value") < 100).drop("value"), name)
        TB.replace_table(rows.filter(F.col("value") < 250).drop("value"), name)
        TB.append_table(rows.filter(F.col("value") >= 250).select("ts", "name", "id"), name)
        return TB.read_table(spark, TB.describe(spark, name)["location"])
    finally:
        spark.sql(f"DROP TABLE {name}")   # its files, at a location of its own, stay


@query("scan_ordered", """
SELECT event_id AS id, event_type AS name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text FROM events""")
def q_scan_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return TB.scan_ordered(ev, [F.col("event_id").alias("id"), F.col("event_type").alias("name"),
                                X.ts_text("ts").alias("ts_text")], ["id"])


@query("table_sample", "SELECT event_id, user_id, ts, event_type, value, props FROM events ORDER BY event_id LIMIT 100")
def q_table_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return TB.table_sample(ev, None, order_by=["event_id"])


@query("verify_rows", """
WITH a AS (SELECT event_id AS id, event_type AS name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events),
e AS (SELECT event_id AS id, CASE WHEN event_type = 'error' THEN upper(event_type) ELSE event_type END AS name,
        strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events)
SELECT *, 'missing' AS side FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM a)
UNION ALL SELECT *, 'unexpected' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM e)""")
def q_verify_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo_rows(spark, sf_dir).drop("value")
    path = shared_dir(spark, "verify_rows")
    TB.replace_rows(rows, path)
    # The expected table spells error events in capitals: those rows differ.
    expected = rows.withColumn("name", F.when(F.col("name") == "error", F.upper("name")).otherwise(F.col("name")))
    return TB.verify_rows(TB.read_table(spark, path), expected)


@query("roundtrip", """
SELECT event_id AS id, event_type AS name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events""")
def q_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = demo_rows(spark, sf_dir).drop("value")
    back, diff = TB.roundtrip(rows, shared_dir(spark, "roundtrip"))
    if not diff.isEmpty():
        raise AssertionError("round trip changed rows")
    return TB.normalize_times(back)
