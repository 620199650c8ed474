"""Registered access queries: A1-A3, A5, A7, J2, J3, W3 on grants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeops.fixtures import fixture, table
from lakeops.functions import exprs as X
from lakeops.operators import access as A
from lakeops.plans.catalogue import query
from lakeops.session import shared_dir
from lakeops.sources import keyed as K

SERVICE_USER = "service"


def principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixture(spark, sf_dir, "fx_principals")
    return p.select("username", "admin", F.array("group_a", "group_b").alias("groups"))


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current grant table: the validated grant log reduced per grant key.

    Reduced in the same job that uses it; the planner sizes the join against
    it (broadcast under the threshold, otherwise a shuffle join that AQE can
    convert from the measured size of the reduced table).
    """
    return A.current_grants(fixture(spark, sf_dir, "fx_grants"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = fixture(spark, sf_dir, "fx_requests").select("request_id", "username", "object_type", "object_id",
                                                         "owner", "required")
    return A.authorize(req, principals(spark, sf_dir), current(spark, sf_dir))


def authorize_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: allowed / denied request counts over the whole access log."""
    return (decisions(spark, sf_dir).groupBy("allowed")
            .agg(F.count(F.lit(1)).alias("requests")))


# DuckDB: validated grants -> latest per key -> candidate keys per request.
_CUR = """
vg AS (
  SELECT g.*, l.rnk FROM fx_grants g JOIN fx_ladders l ON l.object_type = g.object_type AND l.level = g.level
  WHERE g.principal_type IN ('user', 'group') AND g.principal_id <> ''),
cur AS (
  SELECT object_type, object_id, principal_type, principal_id, arg_max(level, grant_seq) AS level,
         arg_max(rnk, grant_seq) AS rnk, max(grant_seq) AS grant_seq, min(created_at) AS created_at
  FROM vg GROUP BY object_type, object_id, principal_type, principal_id),
mem AS (SELECT username, group_a AS g FROM fx_principals UNION SELECT username, group_b FROM fx_principals),
tops AS (SELECT object_type, max(rnk) AS top FROM fx_ladders GROUP BY object_type)
"""

_DECISIONS = "WITH " + _CUR + """,
cand AS (
  SELECT r.request_id, r.object_type, r.object_id, 'user' AS principal_type, r.username AS principal_id FROM fx_requests r
  UNION ALL
  SELECT r.request_id, r.object_type, r.object_id, 'group', m.g FROM fx_requests r JOIN mem m ON m.username = r.username),
best AS (
  SELECT c.request_id, max(cur.rnk) AS rnk FROM cand c
  JOIN cur ON cur.object_type = c.object_type AND cur.object_id = c.object_id
   AND cur.principal_type = c.principal_type AND cur.principal_id = c.principal_id
  GROUP BY c.request_id),
dec AS (
  SELECT r.request_id, r.username, r.object_type, r.object_id, r.required, COALESCE(p.admin, false) AS admin,
    CASE WHEN COALESCE(p.admin, false) OR (r.owner <> '' AND r.owner = r.username) THEN t.top ELSE b.rnk END AS eff_rnk,
    w.rnk AS want_rnk
  FROM fx_requests r LEFT JOIN fx_principals p ON p.username = r.username
  LEFT JOIN best b ON b.request_id = r.request_id
  LEFT JOIN tops t ON t.object_type = r.object_type
  LEFT JOIN fx_ladders w ON w.object_type = r.object_type AND w.level = r.required),
decided AS (
  SELECT request_id, username, object_type, object_id, required, admin, eff_rnk,
         COALESCE(want_rnk IS NOT NULL AND eff_rnk >= want_rnk, false) AS allowed FROM dec)
"""


@query("authorize", _DECISIONS + "SELECT * FROM decided")
def q_authorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).select("request_id", "username", "object_type", "object_id",
                                           "required", "admin", "eff_rnk", "allowed")


@query("authorize_summary", _DECISIONS +
       "SELECT allowed, count(*) AS requests FROM decided GROUP BY allowed")
def q_authorize_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authorize_summary(spark, sf_dir)


@query("access_matrix", _DECISIONS + """
SELECT object_type, required, CAST(sum(CAST(allowed AS INTEGER)) AS BIGINT) AS allowed, count(*) AS total
FROM decided GROUP BY ROLLUP (object_type, required)""")
def q_access_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.access_matrix(decisions(spark, sf_dir))


_PAIRS = "WITH " + _CUR + """,
pairs AS (SELECT DISTINCT username, object_type, object_id, owner FROM fx_requests),
cand AS (
  SELECT p.*, 'user' AS principal_type, p.username AS principal_id FROM pairs p
  UNION ALL
  SELECT p.*, 'group', m.g FROM pairs p JOIN mem m ON m.username = p.username),
best AS (
  SELECT c.username, c.object_type, c.object_id, c.owner, max(cur.rnk) AS rnk FROM cand c
  JOIN cur ON cur.object_type = c.object_type AND cur.object_id = c.object_id
   AND cur.principal_type = c.principal_type AND cur.principal_id = c.principal_id
  GROUP BY ALL),
eff AS (
  SELECT p.*, CASE WHEN COALESCE(d.admin, false) OR (p.owner <> '' AND p.owner = p.username) THEN t.top ELSE b.rnk END AS eff_rnk
  FROM pairs p LEFT JOIN fx_principals d ON d.username = p.username
  LEFT JOIN best b ON b.username = p.username AND b.object_type = p.object_type AND b.object_id = p.object_id AND b.owner = p.owner
  LEFT JOIN tops t ON t.object_type = p.object_type)
"""


@query("effective_level", _PAIRS + """
SELECT e.username, e.object_type, e.object_id, e.owner, l.level
FROM eff e LEFT JOIN fx_ladders l ON l.object_type = e.object_type AND l.rnk = e.eff_rnk""")
def q_effective_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fixture(spark, sf_dir, "fx_requests").select("username", "object_type", "object_id", "owner")
    return A.effective_level(pairs, principals(spark, sf_dir), current(spark, sf_dir))


@query("authorized_view", _PAIRS + """
SELECT username, object_type, object_id, owner FROM eff WHERE eff_rnk >= 0""")
def q_authorized_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    objs = fixture(spark, sf_dir, "fx_requests").select("username", "object_type", "object_id", "owner").distinct()
    return A.authorized_view(objs, principals(spark, sf_dir), current(spark, sf_dir))


@query("grants_upsert", "WITH " + _CUR + """
SELECT object_type, object_id, principal_type, principal_id, level, grant_seq, created_at FROM cur""")
def q_grants_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current(spark, sf_dir).select("object_type", "object_id", "principal_type", "principal_id",
                                         "level", "grant_seq", "created_at")


#: Grant changes before that day make the base of ``grants_revoked``, the others its log.
BASE_UNTIL = "1995-06-01 00:00:00"
_KEY = "object_type, object_id, principal_type, principal_id"


def _live_sql(name: str, rows: str) -> str:
    """CTEs: the rows of ``rows`` after their key's last revocation, reduced to the current grant (``name``)."""
    return f"""
{name}_live AS (
  SELECT r.* FROM {rows} r LEFT JOIN (SELECT {_KEY}, max(grant_seq) AS ended FROM {rows} WHERE gone GROUP BY ALL) e
    ON e.object_type = r.object_type AND e.object_id = r.object_id AND e.principal_type = r.principal_type
   AND e.principal_id = r.principal_id
  WHERE NOT r.gone AND (e.ended IS NULL OR r.grant_seq > e.ended)),
{name} AS (
  SELECT {_KEY}, arg_max(level, grant_seq) AS level, max(grant_seq) AS grant_seq, min(created_at) AS created_at
  FROM {name}_live GROUP BY {_KEY})"""


_REVOKED = f"""
WITH chg AS (
  SELECT g.*, o.o_totalprice < 90000 AS gone FROM fx_grants g JOIN orders o ON o.o_orderkey = g.grant_seq
  LEFT JOIN fx_ladders l ON l.object_type = g.object_type AND l.level = g.level
  WHERE g.principal_type IN ('user', 'group') AND g.principal_id <> '' AND (l.rnk IS NOT NULL OR o.o_totalprice < 90000)),
before AS (SELECT * FROM chg WHERE created_at < TIMESTAMP '{BASE_UNTIL}'),
{_live_sql('base', 'before')},
log AS (SELECT {_KEY}, level, grant_seq, created_at, false AS gone FROM base
        UNION ALL SELECT {_KEY}, level, grant_seq, created_at, gone FROM chg WHERE created_at >= TIMESTAMP '{BASE_UNTIL}'),
{_live_sql('cur', 'log')}
SELECT {_KEY}, level, grant_seq, created_at FROM cur"""


def grant_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grant log with ``gone``: cheap orders take the grant of their key away."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("grant_seq"), (F.col("o_totalprice") < 90000).alias("gone"))
    return fixture(spark, sf_dir, "fx_grants").join(orders, "grant_seq")


@query("grants_revoked", _REVOKED)
def q_grants_revoked(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes, day = grant_changes(spark, sf_dir), X.ntz(BASE_UNTIL)
    cols = [*A.GRANT_KEY, "level", "grant_seq", "created_at"]
    base = A.current_grants(changes.filter(F.col("created_at") < day), revoked=F.col("gone")).select(*cols)
    return A.current_grants(changes.filter(F.col("created_at") >= day), revoked=F.col("gone"), base=base).select(*cols)


#: Parts of the registered keyed table.
PARTS = 32


@query("upsert_parts", _REVOKED)
def q_upsert_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``grants_revoked``, on a base kept in parts: the changes are upserted into the parts they touch."""
    changes, day = grant_changes(spark, sf_dir), X.ntz(BASE_UNTIL)
    cols = [*A.GRANT_KEY, "level", "grant_seq", "created_at"]
    base = A.current_grants(changes.filter(F.col("created_at") < day), revoked=F.col("gone")).select(*cols)
    path = shared_dir(spark, "upsert_parts")
    K.create(base, path, A.GRANT_KEY, PARTS)
    checked = A.validate_grants(changes.filter(F.col("created_at") >= day))
    log = checked.filter(F.col("reason").isNull() | (F.col("gone") & (F.col("reason") == "bad_level")))
    K.upsert(log.select(*cols, "gone"), path, base.schema, A.GRANT_KEY, PARTS, "grant_seq", gone=F.col("gone"))
    return K.read(spark, path, base.schema)


@query("grants_valid", """
SELECT g.object_type, CASE WHEN g.principal_type NOT IN ('user', 'group') THEN 'bad_principal_type'
  WHEN g.principal_id = '' THEN 'missing_principal_id' WHEN l.rnk IS NULL THEN 'bad_level' ELSE 'ok' END AS status,
  count(*) AS n
FROM fx_grants g LEFT JOIN fx_ladders l ON l.object_type = g.object_type AND l.level = g.level
GROUP BY ALL""")
def q_grants_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = A.validate_grants(fixture(spark, sf_dir, "fx_grants"))
    return (checked.groupBy("object_type", F.coalesce("reason", F.lit("ok")).alias("status"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("membership", """
SELECT username, 'user' AS principal_type, username AS principal_id FROM fx_principals
UNION SELECT username, 'group', group_a FROM fx_principals
UNION SELECT username, 'group', group_b FROM fx_principals""")
def q_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.membership(principals(spark, sf_dir))


@query("read_attribution", f"""
SELECT COALESCE(NULLIF(CASE WHEN required = 'bogus' THEN '' WHEN required = 'manage' THEN '  ' ELSE username END, ''), '{SERVICE_USER}') AS reader,
 count(*) AS reads FROM fx_requests GROUP BY 1""")
def q_read_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixture(spark, sf_dir, "fx_requests")
    # Malformed requests (unknown level) arrive without a caller name, some with one of spaces.
    log = log.withColumn("username", F.when(F.col("required") == "bogus", F.lit("")).when(F.col("required") == "manage", F.lit("  "))
                         .otherwise(F.col("username")))
    return A.read_attribution(log, SERVICE_USER)
