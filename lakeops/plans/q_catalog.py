"""Registered catalog queries: M4-M9 over metadata documents and snapshot logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeops.fixtures import fixture
from lakeops.plans.catalogue import query
from lakeops.sources import catalog as C

_ALL = """
WITH a AS (SELECT table_id, doc, TRY_CAST(doc AS JSON) AS j FROM fx_metadata),
c AS (SELECT table_id, doc, j -> 'metadata' AS m, CASE WHEN trim(coalesce(doc, '')) = '' THEN 'missing'
        WHEN j IS NULL OR json_type(j) <> 'OBJECT' OR ((j -> 'metadata' ->> 'format-version') IS NOT NULL
          AND TRY_CAST((j -> 'metadata' ->> 'format-version') AS BIGINT) IS NULL) THEN 'malformed'
        WHEN (j -> 'metadata') IS NULL THEN 'no_metadata' ELSE 'ok' END AS status FROM a),
d AS (SELECT table_id, m FROM c WHERE status = 'ok')
"""
_DOC = _ALL.rstrip()


@query("table_detail", _DOC + """
SELECT table_id, m ->> 'location' AS location, 'iceberg/v' || (m ->> 'format-version') AS format,
  CAST(m ->> 'current-snapshot-id' AS BIGINT) AS current_snapshot_id,
  CAST(len(json_keys(m, '$.properties')) AS INTEGER) AS n_properties FROM d""")
def q_table_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table_detail(fixture(spark, sf_dir, "fx_metadata"))


@query("table_columns", _DOC + """,
s AS (SELECT table_id, CAST(m ->> 'current-schema-id' AS BIGINT) AS cur, CAST(m -> 'schemas' AS JSON[]) AS schemas FROM d),
p AS (SELECT table_id, COALESCE(list_filter(schemas, lambda x: CAST(x ->> 'schema-id' AS BIGINT) = cur)[1], schemas[1]) AS sch FROM s),
f AS (SELECT table_id, CAST(sch -> 'fields' AS JSON[]) AS fields FROM p),
e AS (SELECT table_id, fields, unnest(range(1, len(fields) + 1)) AS i FROM f)
SELECT table_id, CAST(i - 1 AS INTEGER) AS pos, fields[i] ->> 'name' AS name,
  COALESCE(fields[i] -> 'type' ->> 'type', fields[i] ->> 'type') AS type,
  NOT COALESCE(CAST(fields[i] ->> 'required' AS BOOLEAN), false) AS nullable,
  COALESCE(fields[i] ->> 'doc', '') AS doc FROM e""")
def q_table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table_columns(fixture(spark, sf_dir, "fx_metadata"))


@query("partition_fields", _DOC + """,
f AS (SELECT table_id, CAST(m -> 'partition-specs' -> 0 -> 'fields' AS JSON[]) AS fields FROM d)
SELECT table_id, CAST(i - 1 AS INTEGER) AS pos, fields[i] ->> 'name' AS name
FROM (SELECT table_id, fields, unnest(range(1, len(fields) + 1)) AS i FROM f)""")
def q_partition_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.partition_fields(fixture(spark, sf_dir, "fx_metadata"))


@query("table_properties", _DOC + """
SELECT table_id, k AS property, json_extract_string(m, '$.properties."' || k || '"') AS value
FROM (SELECT table_id, m, unnest(json_keys(m, '$.properties')) AS k FROM d)""")
def q_table_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table_properties(fixture(spark, sf_dir, "fx_metadata"))


@query("table_history", """
WITH s AS (SELECT table_id, snapshot_id, epoch_us(committed_at) // 1000 AS ms, operation FROM fx_snapshots),
o AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY ms DESC, snapshot_id DESC) AS position,
        lead(ms) OVER (PARTITION BY table_id ORDER BY ms DESC, snapshot_id DESC) AS older FROM s)
SELECT table_id, snapshot_id, CAST(position AS INTEGER) AS position,
  CASE WHEN ms <= 0 THEN '—' ELSE strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M:%S') || ' UTC' END AS ts_text,
  COALESCE(NULLIF(operation, ''), '—') AS operation, position = 1 AS current, ms - older AS gap_ms FROM o""")
def q_table_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fixture(spark, sf_dir, "fx_snapshots")
    snaps = s.select("table_id", "snapshot_id", C.millis_of(F.col("committed_at")).alias("timestamp_ms"), "operation")
    return C.table_history(snaps)


@query("metadata_history", _DOC + """,
e AS (SELECT table_id, CAST(m ->> 'current-snapshot-id' AS BIGINT) AS cur, unnest(CAST(m -> 'snapshots' AS JSON[])) AS s FROM d),
o AS (SELECT table_id, CAST(s ->> 'snapshot-id' AS BIGINT) AS snapshot_id, CAST(s ->> 'timestamp-ms' AS BIGINT) AS ms,
        COALESCE(s -> 'summary' ->> 'operation', '') AS operation, cur FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY ms DESC, snapshot_id DESC) AS position,
        lead(ms) OVER (PARTITION BY table_id ORDER BY ms DESC, snapshot_id DESC) AS older FROM o)
SELECT table_id, snapshot_id, CAST(position AS INTEGER) AS position,
  CASE WHEN ms <= 0 THEN '—' ELSE strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M:%S') || ' UTC' END AS ts_text,
  COALESCE(NULLIF(operation, ''), '—') AS operation, snapshot_id = cur AS current, ms - older AS gap_ms FROM r""")
def q_metadata_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table_history(C.snapshots_of(fixture(spark, sf_dir, "fx_metadata")))


@query("metadata_quarantine", _ALL + "SELECT table_id, doc, status FROM c WHERE status <> 'ok'")
def q_metadata_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.quarantine(fixture(spark, sf_dir, "fx_metadata"))


@query("catalog_tree", _ALL + """,
s AS (SELECT list_filter(string_split(regexp_replace(m ->> 'location', '^[A-Za-z0-9+.-]+://[^/]*', ''), '/'), lambda x: x <> '') AS s FROM d),
n AS (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM s)
SELECT array_to_string(s[1:i], '/') AS node_id, CASE WHEN i > 1 THEN array_to_string(s[1:i - 1], '/') ELSE '' END AS parent_id,
  s[i] AS label, CAST(i AS INTEGER) AS depth,
  CASE WHEN bool_or(i = len(s)) THEN 'table' WHEN i = 1 THEN 'catalog' ELSE 'namespace' END AS kind, count(*) AS tables
FROM n GROUP BY s[1:i], s[1:i - 1], s[i], i""")
def q_catalog_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.location_tree(fixture(spark, sf_dir, "fx_metadata"))
