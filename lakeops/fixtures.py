"""Fixture views derived from the supplied tables.

Each fixture is one SQL text that both Spark and DuckDB run with identical
results, so the Spark operators and the DuckDB oracle start from the same
rows.  Every fixture reads a whole supplied table (no id subsets), so the
work grows with the scale factor.  ``{TS:...}`` marks a timezone-free
timestamp literal, rendered per dialect.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# The permission ladders, lowest level first (rank = position).
LADDERS = {
    "cluster": ["attach", "manage"],
    "notebook": ["view", "run", "edit", "manage"],
    "table": ["read", "write", "manage"],
}

FIXTURES: dict[str, str] = {
    "fx_ladders": """
SELECT * FROM (VALUES ('cluster','attach',0),('cluster','manage',1),('notebook','view',0),('notebook','run',1),
 ('notebook','edit',2),('notebook','manage',3),('table','read',0),('table','write',1),('table','manage',2)) AS t(object_type, level, rnk)
""",
    # Directory: every customer outside the HOUSEHOLD segment has an account.
    "fx_principals": """
SELECT concat('user', CAST(c_custkey AS VARCHAR(20))) AS username, c_custkey % 25 = 0 AS admin,
 concat('group', CAST(CAST(floor(c_custkey / 100) AS BIGINT) AS VARCHAR(20))) AS group_a,
 concat('group', CAST(CAST(floor(c_custkey / 13) AS BIGINT) AS VARCHAR(20))) AS group_b
FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'
""",
    "fx_grants": """
SELECT o_orderkey AS grant_seq, o_orderdate AS created_at,
 CASE o_orderkey % 3 WHEN 0 THEN 'cluster' WHEN 1 THEN 'notebook' ELSE 'table' END AS object_type,
 CAST(o_custkey AS VARCHAR(20)) AS object_id,
 CASE WHEN o_orderkey % 101 = 7 THEN 'team' WHEN o_custkey % 2 = 0 THEN 'user' ELSE 'group' END AS principal_type,
 CASE WHEN o_orderkey % 103 = 9 THEN '' WHEN o_custkey % 2 = 0 THEN concat('user', CAST(CAST(floor(o_custkey / (CASE WHEN o_orderkey % 5 < 3 THEN 7 ELSE 9 END)) AS BIGINT) AS VARCHAR(20)))
  ELSE concat('group', CAST(CAST(floor(o_custkey / (CASE WHEN o_orderkey % 5 < 3 THEN 700 ELSE 91 END)) AS BIGINT) AS VARCHAR(20))) END AS principal_id,
 CASE WHEN o_orderpriority = '1-URGENT' THEN 'manage' WHEN o_orderpriority = '5-LOW' THEN 'bogus'
  WHEN o_orderkey % 3 = 0 THEN 'attach'
  WHEN o_orderkey % 3 = 1 THEN CASE o_orderpriority WHEN '2-HIGH' THEN 'edit' WHEN '3-MEDIUM' THEN 'run' ELSE 'view' END
  ELSE CASE o_orderpriority WHEN '2-HIGH' THEN 'write' ELSE 'read' END END AS level FROM orders
""",
    "fx_requests": """
SELECT event_id AS request_id, ts, concat('user', CAST(user_id AS VARCHAR(20))) AS username,
 CASE event_id % 3 WHEN 0 THEN 'cluster' WHEN 1 THEN 'notebook' ELSE 'table' END AS object_type,
 CAST(user_id * 7 + event_id % 7 AS VARCHAR(20)) AS object_id,
 concat('user', CAST(CASE WHEN event_id % 9 = 0 THEN user_id ELSE CAST(floor((user_id * 7 + event_id % 7) / 11) AS BIGINT) END AS VARCHAR(20))) AS owner,
 CASE WHEN event_type = 'error' THEN 'bogus' WHEN event_type = 'signup' THEN 'manage' WHEN event_id % 3 = 0 THEN 'attach'
  WHEN event_id % 3 = 1 THEN CASE event_type WHEN 'purchase' THEN 'edit' WHEN 'click' THEN 'run' ELSE 'view' END
  ELSE CASE event_type WHEN 'purchase' THEN 'write' ELSE 'read' END END AS required FROM events
""",
    "fx_clusters": """
SELECT c_custkey AS id, c_name AS name, concat('qs-', CAST(c_custkey AS VARCHAR(20))) AS cr_name,
 concat('user', CAST(CAST(floor(c_custkey / 30) AS BIGINT) AS VARCHAR(20))) AS owner,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'Ready' WHEN 'AUTOMOBILE' THEN 'Not-Ready' WHEN 'MACHINERY' THEN 'Failed' WHEN 'HOUSEHOLD' THEN '' ELSE 'Running' END AS phase,
 CASE WHEN c_custkey % 4 = 0 THEN 'Stopped' ELSE 'Running' END AS desired_state, c_custkey % 7 = 0 AS pinned,
 CASE WHEN c_custkey % 11 = 0 THEN '{}' ELSE concat('{"idle_minutes": ', CAST((c_custkey % 3) * 600 AS VARCHAR(20)), '}') END AS config,
 {TS:2024-01-01 00:00:00} AS created_at FROM customer
""",
    # Live custom resources: customers in debt have none (their CR is gone).
    "fx_live": """
SELECT c_custkey AS id, concat('qs-', CAST(c_custkey AS VARCHAR(20))) AS cr_name,
 CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Not Ready' WHEN 2 THEN 'Ready' WHEN 3 THEN 'Running' ELSE 'FailedState' END AS live_phase
FROM customer WHERE c_acctbal >= 0
""",
    "fx_configs": """
SELECT c_custkey AS id, concat('{"name":" ', c_name, ' "', CASE c_custkey % 3 WHEN 0 THEN ',"worker_min":-1,"worker_max":0' WHEN 1 THEN ',"worker_min":2,"worker_max":5' ELSE '' END,
 CASE WHEN c_custkey % 2 = 0 THEN ',"driver":{"cpu_request":"2","cpu_limit":""}' ELSE '' END, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ',"spark_conf":{"a":"1"," b ":"2","":"x"}' END,
 CASE WHEN c_custkey % 4 = 0 THEN ',"idle_minutes":-5' ELSE '' END, ',"tags":{"team":"data"}}') AS config FROM customer
""",
    "fx_activity": """
SELECT event_id, user_id AS cluster_id, ts, event_type AS action FROM events
""",
    "fx_cluster_events": """
SELECT event_id, concat('qs-', CAST(user_id AS VARCHAR(20)), CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '-server' ELSE '-exec-1' END) AS object,
 CASE WHEN event_type = 'error' THEN 'Warning' ELSE 'Normal' END AS type, event_type AS reason, props AS message,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 9 END AS cnt, ts AS last_seen FROM events
""",
    # Event times as text: mostly RFC 3339 in UTC, some with an offset, some none at all.
    "fx_event_times": """
SELECT event_id, CASE event_id % 10 WHEN 3 THEN 'not a time' WHEN 4 THEN '' WHEN 5 THEN NULL
 WHEN 6 THEN concat(replace(CAST(ts AS VARCHAR(30)), ' ', 'T'), '+02:00') ELSE concat(replace(CAST(ts AS VARCHAR(30)), ' ', 'T'), 'Z') END AS seen FROM events
""",
    "fx_log_lines": """
SELECT user_id AS cluster_id, event_id AS line_no, concat(event_type, ' ', props) AS line FROM events
""",
    "fx_notebooks": """
SELECT page_id AS notebook_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path,
 CASE WHEN page_id % 3 = 0 THEN '  ' ELSE concat(' nb', CAST(page_id AS VARCHAR(20)), ' ') END AS name, concat('user', CAST(CAST(floor(page_id / 5) AS BIGINT) AS VARCHAR(20))) AS owner,
 CASE WHEN page_id % 4 = 0 THEN NULL ELSE page_id * 7 END AS attached_cluster_id, CAST(floor(page_id / 2) AS BIGINT) AS folder_id,
 CASE WHEN page_id % 5 = 0 THEN {TS:2024-02-01 00:00:00} END AS trashed_at FROM pages
""",
    "fx_revisions": """
SELECT conv_id AS notebook_id, turn AS rev, text AS source, role AS author, CASE WHEN role = 'user' THEN 'code' ELSE 'markdown' END AS cell_type FROM conversations
""",
    "fx_folders": """
SELECT p_partkey AS folder_id, CASE WHEN p_partkey = 0 THEN NULL ELSE CAST(floor(p_partkey / 3) AS BIGINT) END AS parent_id FROM part
""",
    "fx_runs": """
SELECT event_id AS run_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE props END AS stdout, CASE WHEN event_type = 'error' THEN 'Traceback' ELSE '' END AS error FROM events
""",
    "fx_pairs": """
SELECT user_id AS map_id, event_id AS pos, CASE WHEN event_id % 7 = 0 THEN '  ' ELSE concat(' ', event_type) END AS k, CAST(event_id AS VARCHAR(20)) AS v FROM events
""",
    "fx_metadata": """
SELECT s_suppkey AS table_id, CASE WHEN s_suppkey % 17 = 3 THEN concat('{"metadata":{"location":"file:///lake/torn_', CAST(s_suppkey AS VARCHAR(20)), '"')
 WHEN s_suppkey % 17 = 5 THEN '{"error":{"code":404}}' WHEN s_suppkey % 17 = 8 THEN '' WHEN s_suppkey % 17 = 11 THEN NULL
 WHEN s_suppkey % 17 = 13 THEN '{"metadata":{"format-version":"two","location":"file:///lake/odd"}}'
 ELSE concat('{"metadata":{"format-version":', CAST(1 + s_suppkey % 2 AS VARCHAR(20)), ',"location":"file:///lake/nation_', CAST(s_nationkey AS VARCHAR(20)), '/sales/', CASE WHEN s_suppkey % 2 = 0 THEN 'open/' ELSE '' END, 'orders_', CAST(s_suppkey AS VARCHAR(20)), '","properties":{"team":"sales","tier":"', CAST(s_suppkey % 4 AS VARCHAR(20)), '"},"current-snapshot-id":', CAST(7000 + 2 * s_suppkey AS VARCHAR(20)), ',"current-schema-id":', CAST(s_suppkey % 3 AS VARCHAR(20)),
 ',"schemas":[{"schema-id":1,"fields":[{"name":"order_key","required":true,"type":"int"},{"name":"lines","required":false,"type":{"type":"list","element":"double"}},{"name":"note","required":false,"type":"string","doc":"free text"}]},{"schema-id":0,"fields":[{"name":"order_key","required":true,"type":"int","doc":"order number"}]}],"partition-specs":[{"fields":[{"name":"sales_area"},{"name":"order_month"}]}],"snapshots":[{"snapshot-id":', CAST(6999 + 2 * s_suppkey AS VARCHAR(20)), ',"timestamp-ms":1655555555000,"summary":{"operation":"append"}},{"snapshot-id":', CAST(7000 + 2 * s_suppkey AS VARCHAR(20)), ',"timestamp-ms":1666666666000,"summary":{"operation":"overwrite"}}]}}') END AS doc FROM supplier
""",
    "fx_snapshots": """
SELECT user_id AS table_id, event_id AS snapshot_id, ts AS committed_at,
 CASE event_type WHEN 'click' THEN 'append' WHEN 'view' THEN 'append' WHEN 'purchase' THEN 'overwrite' WHEN 'error' THEN 'delete' ELSE '' END AS operation FROM events
""",
    "fx_claims": """
SELECT c_custkey AS claim_id, concat('{', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('"preferred_username":"user', CAST(c_custkey AS VARCHAR(20)), '",') END, '"sub":"s', CAST(c_custkey AS VARCHAR(20)), '"',
 CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 13 = 4 THEN ',"realm_access":{"roles":"viewer"}' WHEN c_custkey % 13 = 6 THEN ',"realm_access":{"roles":["viewer",5]}'
  WHEN c_custkey % 13 = 9 THEN ',"realm_access":"none"' WHEN c_custkey % 13 = 11 THEN ',"realm_access":{}'
  ELSE concat(',"realm_access":{"roles":["viewer"', CASE WHEN c_custkey % 2 = 0 THEN ',"workspace_admin"' ELSE '' END, ']}') END,
 CASE WHEN c_custkey % 4 = 0 THEN '' ELSE ',"groups":["group1","group2"]' END, '}') AS claims FROM customer
""",
}

_TS = re.compile(r"\{TS:([^}]*)\}")


def render(sql: str, dialect: str) -> str:
    """Render dialect placeholders (``spark`` or ``duckdb``)."""
    kw = "TIMESTAMP_NTZ" if dialect == "spark" else "TIMESTAMP"
    return _TS.sub(lambda m: f"{kw} '{m.group(1)}'", sql).strip()


_SCHEMAS: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table as a DataFrame.

    The Parquet schema is read once per path and then given to the reader,
    so repeated queries skip the footer-reading job of schema inference.
    """
    path = f"{sf_dir}/{name}.parquet"
    schema = _SCHEMAS.get(path)
    if schema is None:
        df = spark.read.parquet(path)
        _SCHEMAS[path] = df.schema
    else:
        df = spark.read.schema(schema).parquet(path)
    return df


def load_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register the supplied parquet tables as temp views."""
    for t in names:
        table(spark, sf_dir, t).createOrReplaceTempView(t)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named fixture as a DataFrame over the tables in ``sf_dir``.

    Source tables are registered under unique ``lakeops_src_<table>_<id>``
    names for the moment the SQL is analysed, then dropped: the analysed plan
    already holds the tables, a caller's own temp views are never replaced,
    and concurrent calls cannot see each other's sources.
    """
    sql = render(FIXTURES[name], "spark")
    views = []
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            view = f"lakeops_src_{t}_{uuid.uuid4().hex[:12]}"
            table(spark, sf_dir, t).createOrReplaceTempView(view)
            views.append(view)
            sql = re.sub(rf"\b{t}\b", view, sql)
    try:
        return spark.sql(sql)
    finally:
        for v in views:
            spark.catalog.dropTempView(v)


def with_fixtures(sql: str) -> str:
    """Prefix DuckDB SQL with the fixture CTEs it references."""
    used = [n for n in FIXTURES if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    ctes = ",\n".join(f"{n} AS ({render(FIXTURES[n], 'duckdb')})" for n in used)
    body = sql.strip()
    if re.match(r"WITH\s+RECURSIVE\b", body, re.I):
        return f"WITH RECURSIVE {ctes},\n{re.sub(r'^WITH\s+RECURSIVE\s+', '', body, flags=re.I)}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
