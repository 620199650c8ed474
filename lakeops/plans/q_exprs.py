"""Registered expression queries: S5-S16, O3, R6 over whole fixture tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeops.fixtures import fixture, table
from lakeops.functions import exprs as X
from lakeops.plans.catalogue import query

# Platform (catalog) Spark conf merged under every user conf,
# the default executor count, and the annotation prefix for tags.
BASE_CONF = {
    "spark.sql.catalog.lake.type": "rest",
    "a": "0",
    "spark.dynamicAllocation.enabled": "false",
}
DEFAULT_EXECUTORS = 1
TAG_PREFIX = "lakeops/"
REQUIRED_ROLE = "workspace_admin"


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixture(spark, sf_dir, "fx_configs")
    return X.normalize_configs(c, "config", "cfg").select("id", "cfg")


# DuckDB: the same normalisation written against the JSON text.
_NORM = """
WITH raw AS (
  SELECT id, config,
    COALESCE(TRY_CAST(json_extract_string(config, '$.worker_min') AS DOUBLE), 1) AS wmin_raw,
    TRY_CAST(json_extract_string(config, '$.worker_max') AS DOUBLE) AS wmax_raw,
    COALESCE(TRY_CAST(json_extract_string(config, '$.idle_minutes') AS DOUBLE), 30) AS idle_raw
  FROM fx_configs),
n1 AS (SELECT *, greatest(0, CAST(trunc(wmin_raw) AS BIGINT)) AS worker_min FROM raw),
n AS (
  SELECT id, config, worker_min,
    greatest(worker_min, CAST(trunc(COALESCE(wmax_raw, greatest(worker_min, 2))) AS BIGINT)) AS worker_max,
    greatest(0, CAST(trunc(idle_raw) AS BIGINT)) AS idle_minutes,
    CASE WHEN json_type(config, '$.name') = 'VARCHAR'
         THEN regexp_replace(json_extract_string(config, '$.name'), '^\\s+|\\s+$', '', 'g') ELSE '' END AS name,
    trim(COALESCE(json_extract_string(config, '$.image'), '')) AS image,
    trim(COALESCE(json_extract_string(config, '$.driver.cpu_request'), '500m')) AS d_cpu_req,
    trim(COALESCE(json_extract_string(config, '$.driver.cpu_limit'), '1')) AS d_cpu_lim,
    trim(COALESCE(json_extract_string(config, '$.driver.memory_request'), '1Gi')) AS d_mem_req,
    trim(COALESCE(json_extract_string(config, '$.driver.memory_limit'), '2Gi')) AS d_mem_lim,
    trim(COALESCE(json_extract_string(config, '$.executor.cpu_request'), '500m')) AS e_cpu_req,
    trim(COALESCE(json_extract_string(config, '$.executor.cpu_limit'), '1')) AS e_cpu_lim,
    trim(COALESCE(json_extract_string(config, '$.executor.memory_request'), '1Gi')) AS e_mem_req,
    trim(COALESCE(json_extract_string(config, '$.executor.memory_limit'), '2Gi')) AS e_mem_lim
  FROM n1),
conf AS (
  SELECT id, trim(k) AS key, json_extract_string(config, '$.spark_conf."' || k || '"') AS value
  FROM (SELECT id, config, unnest(json_keys(config, '$.spark_conf')) AS k FROM fx_configs) WHERE trim(k) <> ''),
tags AS (
  SELECT id, trim(k) AS key, json_extract_string(config, '$.tags."' || k || '"') AS value
  FROM (SELECT id, config, unnest(json_keys(config, '$.tags')) AS k FROM fx_configs) WHERE trim(k) <> '')
"""


def _entries_sql(cte: str) -> str:
    return (f"(SELECT string_agg(key || '=' || value, ',' ORDER BY key) FROM {cte} x WHERE x.id = n.id)")


@query("config_normalize", _NORM + f"""
SELECT id, name, worker_min, worker_max, idle_minutes, image, d_cpu_req, d_cpu_lim, d_mem_req, d_mem_lim,
  e_cpu_req, e_cpu_lim, e_mem_req, e_mem_lim,
  COALESCE({_entries_sql('conf')}, '') AS spark_conf, COALESCE({_entries_sql('tags')}, '') AS tags
FROM n""")
def q_config_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("cfg")
    return normalized(spark, sf_dir).select(
        "id", c["name"].alias("name"), c["worker_min"].alias("worker_min"), c["worker_max"].alias("worker_max"),
        c["idle_minutes"].alias("idle_minutes"), c["image"].alias("image"),
        c["driver"]["cpu_request"].alias("d_cpu_req"), c["driver"]["cpu_limit"].alias("d_cpu_lim"),
        c["driver"]["memory_request"].alias("d_mem_req"), c["driver"]["memory_limit"].alias("d_mem_lim"),
        c["executor"]["cpu_request"].alias("e_cpu_req"), c["executor"]["cpu_limit"].alias("e_cpu_lim"),
        c["executor"]["memory_request"].alias("e_mem_req"), c["executor"]["memory_limit"].alias("e_mem_lim"),
        X.entries_text(c["spark_conf"]).alias("spark_conf"), X.entries_text(c["tags"]).alias("tags"))


@query("resource_summary", _NORM + """
SELECT id,
 COALESCE(NULLIF(d_cpu_req, ''), '—') || '→' || COALESCE(NULLIF(d_cpu_lim, ''), '—') || ' · ' ||
 COALESCE(NULLIF(d_mem_req, ''), '—') || '→' || COALESCE(NULLIF(d_mem_lim, ''), '—') AS driver,
 COALESCE(NULLIF(e_cpu_req, ''), '—') || '→' || COALESCE(NULLIF(e_cpu_lim, ''), '—') || ' · ' ||
 COALESCE(NULLIF(e_mem_req, ''), '—') || '→' || COALESCE(NULLIF(e_mem_lim, ''), '—') AS executor
FROM n""")
def q_resource_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = normalized(spark, sf_dir)
    return n.select("id", X.resource_summary(F.col("cfg.driver")).alias("driver"),
                    X.resource_summary(F.col("cfg.executor")).alias("executor"))


def _base_values_sql() -> str:
    return ", ".join(f"{{'key': '{k}', 'value': '{v}'}}" for k, v in BASE_CONF.items())


@query("conf_merge", _NORM + f""",
inst AS (SELECT id, worker_max, CASE WHEN worker_min > 0 THEN worker_min ELSE {DEFAULT_EXECUTORS} END AS inst FROM n),
base AS (SELECT id, e.key, e.value FROM (SELECT id, unnest([{_base_values_sql()}]) AS e FROM n)),
merged AS (
  SELECT id, key, value FROM conf
  UNION ALL
  SELECT b.id, b.key, b.value FROM base b WHERE NOT EXISTS (SELECT 1 FROM conf u WHERE u.id = b.id AND u.key = b.key)),
derived AS (
  SELECT id, d.key, d.value FROM (
    SELECT id, unnest([{{'key': 'spark.dynamicAllocation.enabled', 'value': 'true'}},
                       {{'key': 'spark.dynamicAllocation.shuffleTracking.enabled', 'value': 'true'}},
                       {{'key': 'spark.dynamicAllocation.minExecutors', 'value': CAST(inst AS VARCHAR)}},
                       {{'key': 'spark.dynamicAllocation.maxExecutors', 'value': CAST(worker_max AS VARCHAR)}}]) AS d
    FROM inst WHERE worker_max > 0 AND worker_max > inst) t
  WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.id = t.id AND m.key = t.d.key))
SELECT * FROM merged UNION ALL SELECT * FROM derived""")
def q_conf_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = normalized(spark, sf_dir)
    base = F.create_map(*[F.lit(x) for kv in BASE_CONF.items() for x in kv])
    m = X.conf_merge(base, F.col("cfg.spark_conf"), F.col("cfg.worker_min"), F.col("cfg.worker_max"),
                     F.lit(DEFAULT_EXECUTORS))
    return n.select("id", F.explode(m).alias("key", "value"))


@query("prefix_keys", _NORM + f"""
SELECT id, '{TAG_PREFIX}' || key AS key, value FROM tags""")
def q_prefix_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = normalized(spark, sf_dir)
    return n.select("id", F.explode(X.prefix_keys(F.col("cfg.tags"), TAG_PREFIX)).alias("key", "value"))


@query("prune_blank", _NORM + """
SELECT id, e.section, e.key, e.value FROM (
  SELECT id, unnest([{'section': 'requests', 'key': 'cpu', 'value': d_cpu_req},
                     {'section': 'requests', 'key': 'memory', 'value': d_mem_req},
                     {'section': 'limits', 'key': 'cpu', 'value': d_cpu_lim},
                     {'section': 'limits', 'key': 'memory', 'value': d_mem_lim}]) AS e FROM n)
WHERE e.value <> ''""")
def q_prune_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = normalized(spark, sf_dir).select("id", X.resource_requirements(F.col("cfg.driver")).alias("r"))
    req = n.select("id", F.lit("requests").alias("section"), F.explode("r.requests").alias("key", "value"))
    lim = n.select("id", F.lit("limits").alias("section"), F.explode("r.limits").alias("key", "value"))
    return req.unionByName(lim)


@query("sorted_entries", _NORM + """
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY key) - 1 AS INTEGER) AS pos, key, value FROM conf""")
def q_sorted_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = normalized(spark, sf_dir)
    return n.select("id", F.posexplode(X.sorted_entries(F.col("cfg.spark_conf"))).alias("pos", "e")).select(
        "id", "pos", F.col("e.key").alias("key"), F.col("e.value").alias("value"))


_SLUG_IN = """
WITH inp AS (SELECT id, 'short' AS kind, name AS input FROM fx_clusters
             UNION ALL SELECT id, 'long', repeat(name, 3) FROM fx_clusters),
s1 AS (SELECT *, regexp_replace(regexp_replace(lower(input), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM inp),
s2 AS (SELECT *, CASE WHEN s = '' THEN 'cluster' ELSE s END AS s0 FROM s1),
s3 AS (SELECT *, CASE WHEN length(s0) > 51 THEN regexp_replace(s0[1:51], '-+$', '') ELSE s0 END AS slug FROM s2)
"""


@query("slug", _SLUG_IN + """
SELECT id, kind, slug, 'qs-' || slug || '-' || sha256(CAST(id AS VARCHAR))[1:8] AS cr_name FROM s3""")
def q_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixture(spark, sf_dir, "fx_clusters")
    inp = (c.select("id", F.lit("short").alias("kind"), F.col("name").alias("input"))
           .unionByName(c.select("id", F.lit("long").alias("kind"), F.repeat("name", 3).alias("input"))))
    return inp.select("id", "kind", X.slug("input").alias("slug"), X.cr_name(F.col("input"), F.col("id")).alias("cr_name"))


@query("display_name", """
WITH t AS (SELECT notebook_id, regexp_replace(name, '^\\s+|\\s+$', '', 'g') AS n,
  list_filter(string_split(path, '/'), lambda x: x <> '')[-1] AS tail FROM fx_notebooks)
SELECT notebook_id, CASE WHEN n <> '' THEN n
  WHEN COALESCE(regexp_replace(tail, '^\\s+|\\s+$', '', 'g'), '') <> '' THEN tail ELSE 'Untitled' END AS display_name
FROM t""")
def q_display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    nb = fixture(spark, sf_dir, "fx_notebooks")
    return nb.select("notebook_id", X.display_name("name", "path").alias("display_name"))


@query("cell_text", """
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, CAST(ts AS VARCHAR) AS ts,
 event_type, CAST(value AS VARCHAR) AS value, props FROM events""")
def q_cell_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return X.cell_text_frame(ev)


@query("blank_null", """
SELECT id, NULLIF(live_phase, '') AS stored, COALESCE(NULLIF(live_phase, ''), '') AS read_back FROM fx_live""")
def q_blank_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    lv = fixture(spark, sf_dir, "fx_live")
    stored = X.blank_to_null("live_phase")
    return lv.select("id", stored.alias("stored"), X.null_to_blank(stored).alias("read_back"))


@query("principals", f"""
WITH t AS (
  SELECT claim_id, claims, json_type(claims, '$.realm_access') AS ra_t, json_type(claims, '$.realm_access.roles') AS ro_t,
    json_extract(claims, '$.realm_access.roles[*]') AS ro, json_extract(claims, '$.groups[*]') AS gr FROM fx_claims),
s AS (
  SELECT *, CASE WHEN ra_t IS NULL THEN 'invalid:realm_access missing'
    WHEN ra_t <> 'OBJECT' THEN 'invalid:realm_access not an object'
    WHEN ro_t IS NULL THEN 'invalid:roles missing'
    WHEN ro_t <> 'ARRAY' THEN 'invalid:roles not an array'
    WHEN len(list_filter(ro, lambda x: json_type(x) <> 'VARCHAR')) > 0 THEN 'invalid:roles contains non-string element'
    WHEN NOT list_contains(list_transform(ro, lambda x: json_extract_string(x, '$')), '{REQUIRED_ROLE}') THEN 'missing_role'
    ELSE 'ok' END AS status FROM t)
SELECT claim_id, status,
  CASE WHEN json_type(claims, '$.preferred_username') = 'VARCHAR' AND json_extract_string(claims, '$.preferred_username') <> ''
       THEN json_extract_string(claims, '$.preferred_username')
       WHEN json_type(claims, '$.sub') = 'VARCHAR' THEN json_extract_string(claims, '$.sub') ELSE '' END AS username,
  CASE WHEN status = 'ok' OR status = 'missing_role' THEN array_to_string(list_transform(ro, lambda x: json_extract_string(x, '$')), ',') END AS roles,
  COALESCE(array_to_string(list_transform(list_filter(gr, lambda x: json_type(x) = 'VARCHAR'), lambda x: json_extract_string(x, '$')), ','), '') AS groups
FROM s""")
def q_principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeops.operators.claims import principals_from_claims
    p = principals_from_claims(fixture(spark, sf_dir, "fx_claims"), REQUIRED_ROLE)
    return p.select("claim_id", "status", "username", F.array_join("roles", ",").alias("roles"),
                    F.coalesce(F.array_join("groups", ","), F.lit("")).alias("groups"))
