"""Registered registry queries: R1-R5 reads and W1-W12 mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeops.fixtures import fixture, table
from lakeops.functions import exprs as X
from lakeops.operators import access as A, registry as G
from lakeops.plans.catalogue import query

# Fixed parameters of the mutation queries.
CUTOFF = "1996-01-01 00:00:00"
UPDATED_AT = "2024-02-01 00:00:00"
TRASHED_AT = "2024-03-01 00:00:00"

_VALID = """
WITH vg AS (
  SELECT g.* FROM fx_grants g JOIN fx_ladders l ON l.object_type = g.object_type AND l.level = g.level
  WHERE g.principal_type IN ('user', 'group') AND g.principal_id <> '')
"""


def _valid_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = A.split_valid(A.validate_grants(fixture(spark, sf_dir, "fx_grants")))
    return valid.drop("rnk", "reason")


@query("lookup", """
WITH k AS (SELECT DISTINCT attached_cluster_id AS id FROM fx_notebooks WHERE attached_cluster_id IS NOT NULL)
SELECT k.id, c.id IS NOT NULL AS found, c.cr_name FROM k LEFT JOIN fx_clusters c ON c.id = k.id""")
def q_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = (fixture(spark, sf_dir, "fx_notebooks").filter(F.col("attached_cluster_id").isNotNull())
            .select(F.col("attached_cluster_id").alias("id")).distinct())
    clusters = fixture(spark, sf_dir, "fx_clusters").select("id", "cr_name")
    return G.lookup_keys(clusters, keys, ["id"]).select("id", "found", "cr_name")


@query("list_ordered", "SELECT grant_seq, created_at, object_type, object_id FROM fx_grants")
def q_list_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = fixture(spark, sf_dir, "fx_grants").select("grant_seq", "created_at", "object_type", "object_id")
    return G.list_ordered(g, ("created_at", "grant_seq"))


@query("list_active", "SELECT notebook_id, path FROM fx_notebooks WHERE trashed_at IS NULL")
def q_list_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.list_active(fixture(spark, sf_dir, "fx_notebooks")).select("notebook_id", "path")


@query("list_revisions", "SELECT notebook_id, rev, author FROM fx_revisions")
def q_list_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.list_revisions(fixture(spark, sf_dir, "fx_revisions"))


@query("list_grants", _VALID + """
SELECT object_type, object_id, principal_type, principal_id, arg_max(level, grant_seq) AS level
FROM vg GROUP BY ALL""")
def q_list_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    cur = A.current_grants(fixture(spark, sf_dir, "fx_grants"))
    return G.list_grants(cur).select(*A.GRANT_KEY, "level")


@query("insert_unique", _VALID + f""",
base AS (SELECT object_type, object_id, principal_type, principal_id, arg_max(level, grant_seq) AS level,
           max(grant_seq) AS grant_seq FROM vg WHERE created_at < TIMESTAMP '{CUTOFF}' GROUP BY ALL),
new AS (SELECT object_type, object_id, principal_type, principal_id, level, grant_seq FROM vg
        WHERE created_at >= TIMESTAMP '{CUTOFF}'),
tagged AS (
  SELECT n.*, CASE
    WHEN EXISTS (SELECT 1 FROM base b WHERE b.object_type = n.object_type AND b.object_id = n.object_id
                 AND b.principal_type = n.principal_type AND b.principal_id = n.principal_id)
      THEN 'exists:object_type+object_id+principal_type+principal_id'
    WHEN n.grant_seq > (SELECT min(m.grant_seq) FROM new m WHERE m.object_type = n.object_type AND m.object_id = n.object_id
                 AND m.principal_type = n.principal_type AND m.principal_id = n.principal_id)
      THEN 'duplicate:object_type+object_id+principal_type+principal_id'
    ELSE 'inserted' END AS status FROM new n)
SELECT *, 'existing' AS status FROM base UNION ALL SELECT * FROM tagged""")
def q_insert_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    vg = _valid_grants(spark, sf_dir).select(*A.GRANT_KEY, "level", "grant_seq", "created_at")
    cutoff = X.ntz(CUTOFF)
    base = G.upsert_latest(None, vg.filter(F.col("created_at") < cutoff), A.GRANT_KEY, "grant_seq").drop("created_at")
    new = vg.filter(F.col("created_at") >= cutoff).drop("created_at")
    tagged = G.tag_conflicts(base, new, [A.GRANT_KEY], "grant_seq")
    cols = [*A.GRANT_KEY, "level", "grant_seq"]
    return (base.select(*cols, F.lit("existing").alias("status"))
            .unionByName(tagged.select(*cols, F.coalesce("reason", F.lit("inserted")).alias("status"))))


_TWO_KEYS = """
WITH RECURSIVE o AS (
  SELECT o_orderkey AS id, o_custkey AS a, CAST(floor(o_totalprice) AS BIGINT) AS b, o_orderstatus = 'P' AS old FROM orders),
new AS (SELECT id, a, CASE WHEN b < 20000 THEN NULL ELSE b END AS b,
          a IN (SELECT a FROM o WHERE old) AS ea, b >= 20000 AND b IN (SELECT b FROM o WHERE old) AS eb FROM o WHERE NOT old),
st(id, a, b, ea, eb, status, it) AS (
  SELECT id, a, b, ea, eb, CASE WHEN ea OR eb THEN 2 ELSE 0 END, 0 FROM new
  UNION ALL
  SELECT id, a, b, ea, eb, CASE WHEN status <> 0 THEN status WHEN f THEN 1
    WHEN bool_or(f) OVER (PARTITION BY a) OR (b IS NOT NULL AND bool_or(f) OVER (PARTITION BY b)) THEN 2 ELSE 0 END, it + 1
  FROM (SELECT *, status = 0 AND id = min(CASE WHEN status = 0 THEN id END) OVER (PARTITION BY a)
          AND (b IS NULL OR id = min(CASE WHEN status = 0 THEN id END) OVER (PARTITION BY b)) AS f,
          bool_or(status = 0) OVER () AS more FROM st)
  WHERE more),
done AS (SELECT id, a, b, ea, eb, max(status) AS status FROM st GROUP BY ALL)
SELECT d.id, d.a AS customer, d.b AS price, CASE WHEN status = 1 THEN 'inserted' WHEN ea THEN 'exists:customer'
  WHEN EXISTS (SELECT 1 FROM done x WHERE x.status = 1 AND x.a = d.a AND x.id < d.id) THEN 'duplicate:customer'
  WHEN eb THEN 'exists:price' ELSE 'duplicate:price' END AS status
FROM done d"""


@query("insert_two_keys", _TWO_KEYS)
def q_insert_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order per customer and per price (cheap ones have no price key), in order, beside those in process."""
    price = F.floor("o_totalprice").cast("long")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"),
                                              F.when(price >= 20000, price).alias("price"), "o_orderstatus")
    old = F.col("o_orderstatus") == "P"
    base, new = o.filter(old).drop("o_orderstatus"), o.filter(~old).drop("o_orderstatus")
    table_, conflicts = G.insert_unique(base, new, [["customer"], ["price"]], "id")
    free = table_.join(base.select("id"), "id", "left_anti").withColumn("status", F.lit("inserted"))
    return free.unionByName(conflicts.withColumnRenamed("reason", "status"))


_UPD_SQL = f"""
WITH ch AS (SELECT DISTINCT attached_cluster_id AS id, 'Running' AS desired_state, true AS pinned
            FROM fx_notebooks WHERE attached_cluster_id IS NOT NULL)
SELECT c.id, c.phase, COALESCE(ch.desired_state, c.desired_state) AS desired_state, COALESCE(ch.pinned, c.pinned) AS pinned,
  CASE WHEN ch.id IS NOT NULL THEN TIMESTAMP '{UPDATED_AT}' END AS updated_at,
  CASE WHEN ch.id IS NOT NULL THEN 'updated' ELSE 'unchanged' END AS status
FROM fx_clusters c LEFT JOIN ch ON ch.id = c.id
UNION ALL
SELECT ch.id, NULL, NULL, NULL, NULL, 'unknown' FROM ch WHERE ch.id NOT IN (SELECT id FROM fx_clusters)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pin and keep running every cluster a notebook is attached to.

    Dangling attachments (ids the registry does not have) are the unknown keys.
    """
    nb = fixture(spark, sf_dir, "fx_notebooks").filter(F.col("attached_cluster_id").isNotNull())
    return nb.select(F.col("attached_cluster_id").alias("id")).distinct().select(
        "id", F.lit("Running").alias("desired_state"), F.lit(True).alias("pinned"))


@query("update_by_key", _UPD_SQL)
def q_update_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = fixture(spark, sf_dir, "fx_clusters").select("id", "phase", "desired_state", "pinned")
    table, unknown = G.update_by_key(base, _changes(spark, sf_dir), ["id"], at=X.ntz(UPDATED_AT))
    status = F.when(F.col("updated_at").isNotNull(), "updated").otherwise("unchanged")
    nul = F.lit(None)
    return (table.withColumn("status", status)
            .unionByName(unknown.select("id", nul.cast("string").alias("phase"), nul.cast("string").alias("desired_state"),
                                        nul.cast("boolean").alias("pinned"), nul.cast("timestamp_ntz").alias("updated_at"),
                                        F.lit("unknown").alias("status"))))


@query("delete_by_key", """
WITH k AS (SELECT DISTINCT attached_cluster_id AS id FROM fx_notebooks
           WHERE trashed_at IS NOT NULL AND attached_cluster_id IS NOT NULL)
SELECT id, 'kept' AS status FROM fx_clusters WHERE id NOT IN (SELECT id FROM k)
UNION ALL SELECT id, 'unmatched' FROM k WHERE id NOT IN (SELECT id FROM fx_clusters)""")
def q_delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = fixture(spark, sf_dir, "fx_clusters")
    # Clean-up: delete the clusters that trashed notebooks were attached to.
    nb = fixture(spark, sf_dir, "fx_notebooks")
    keys = (nb.filter(F.col("trashed_at").isNotNull() & F.col("attached_cluster_id").isNotNull())
            .select(F.col("attached_cluster_id").alias("id")).distinct())
    table, unmatched = G.delete_by_key(base, keys, ["id"])
    return (table.select("id", F.lit("kept").alias("status"))
            .unionByName(unmatched.select("id", F.lit("unmatched").alias("status"))))


@query("soft_delete", f"""
WITH k AS (SELECT n.notebook_id FROM fx_notebooks n JOIN fx_clusters c ON c.id = n.attached_cluster_id
           WHERE c.desired_state = 'Stopped'
           UNION ALL SELECT DISTINCT r.notebook_id FROM fx_revisions r
           WHERE r.author = 'system' AND r.notebook_id NOT IN (SELECT notebook_id FROM fx_notebooks))
SELECT notebook_id, CASE WHEN notebook_id IN (SELECT notebook_id FROM k) THEN TIMESTAMP '{TRASHED_AT}' ELSE trashed_at END AS trashed_at,
  'row' AS status FROM fx_notebooks
UNION ALL SELECT notebook_id, NULL, 'unmatched' FROM k WHERE notebook_id NOT IN (SELECT notebook_id FROM fx_notebooks)""")
def q_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    nb = fixture(spark, sf_dir, "fx_notebooks")
    # Trash every notebook attached to a stopped cluster, plus any notebook a
    # system-authored revision names (unknown ones are reported back).
    stopped = fixture(spark, sf_dir, "fx_clusters").filter(F.col("desired_state") == "Stopped")
    keys = (nb.join(stopped.select(F.col("id").alias("attached_cluster_id")), "attached_cluster_id")
            .select("notebook_id")
            .unionByName(fixture(spark, sf_dir, "fx_revisions").filter(F.col("author") == "system")
                         .select("notebook_id").distinct()
                         .join(nb.select("notebook_id"), "notebook_id", "left_anti")))
    table, unmatched = G.soft_delete(nb, keys, ["notebook_id"], X.ntz(TRASHED_AT))
    return (table.select("notebook_id", "trashed_at", F.lit("row").alias("status"))
            .unionByName(unmatched.select("notebook_id", F.lit(None).cast("timestamp_ntz").alias("trashed_at"),
                                          F.lit("unmatched").alias("status"))))


@query("cascade_delete", """
SELECT r.notebook_id, r.rev FROM fx_revisions r
WHERE r.notebook_id IN (SELECT notebook_id FROM fx_notebooks WHERE trashed_at IS NULL)""")
def q_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = fixture(spark, sf_dir, "fx_notebooks").filter(F.col("trashed_at").isNull())
    rev = fixture(spark, sf_dir, "fx_revisions")
    return G.cascade_delete(kept, rev, "notebook_id", "notebook_id").select("notebook_id", "rev")


@query("set_null_fk", """
SELECT n.notebook_id, CASE WHEN c.id IS NOT NULL THEN n.attached_cluster_id END AS attached_cluster_id
FROM fx_notebooks n LEFT JOIN fx_clusters c ON c.id = n.attached_cluster_id""")
def q_set_null_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    nb = fixture(spark, sf_dir, "fx_notebooks").select("notebook_id", "attached_cluster_id")
    return G.set_null_fk(nb, fixture(spark, sf_dir, "fx_clusters"), "attached_cluster_id", "id")


@query("folder_closure", """
WITH RECURSIVE closure(ancestor_id, folder_id, depth) AS (
  SELECT folder_id, folder_id, 0 FROM fx_folders
  UNION ALL
  SELECT f.parent_id, c.folder_id, c.depth + 1 FROM closure c JOIN fx_folders f ON f.folder_id = c.ancestor_id
  WHERE f.parent_id IS NOT NULL)
SELECT ancestor_id, folder_id, depth FROM closure""")
def q_folder_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.folder_closure(fixture(spark, sf_dir, "fx_folders"))


@query("cascade_folders", """
WITH RECURSIVE closure(ancestor_id, folder_id) AS (
  SELECT folder_id, folder_id FROM fx_folders
  UNION ALL
  SELECT f.parent_id, c.folder_id FROM closure c JOIN fx_folders f ON f.folder_id = c.ancestor_id
  WHERE f.parent_id IS NOT NULL),
deleted AS (SELECT DISTINCT n.folder_id FROM fx_notebooks n JOIN fx_folders f ON f.folder_id = n.folder_id
            WHERE n.trashed_at IS NOT NULL AND f.parent_id IS NOT NULL)
SELECT folder_id, parent_id FROM fx_folders
WHERE folder_id NOT IN (SELECT c.folder_id FROM closure c JOIN deleted d ON d.folder_id = c.ancestor_id)""")
def q_cascade_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Deleting the folders that hold trashed notebooks removes their subtrees;
    # the root folder (no parent) is never deleted.
    folders = fixture(spark, sf_dir, "fx_folders")
    deleted = (fixture(spark, sf_dir, "fx_notebooks").filter(F.col("trashed_at").isNotNull()).select("folder_id")
               .join(folders.filter(F.col("parent_id").isNotNull()).select("folder_id"), "folder_id", "left_semi"))
    return G.cascade_delete_tree(folders, deleted)


@query("unique_audit", """
SELECT path, count(*) AS n FROM fx_notebooks WHERE path IS NOT NULL GROUP BY path HAVING count(*) > 1""")
def q_unique_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.unique_audit(fixture(spark, sf_dir, "fx_notebooks"), ["path"])


@query("orphan_audit", """
SELECT notebook_id, attached_cluster_id FROM fx_notebooks n
WHERE attached_cluster_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fx_clusters c WHERE c.id = n.attached_cluster_id)""")
def q_orphan_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    nb = fixture(spark, sf_dir, "fx_notebooks").select("notebook_id", "attached_cluster_id")
    return G.orphan_audit(nb, fixture(spark, sf_dir, "fx_clusters"), "attached_cluster_id", "id")


@query("clone_rows", """
WITH p AS (SELECT c.*, COALESCE(NULLIF(trim(CASE WHEN desired_state = 'Stopped' THEN '  ' ELSE 'copy of ' || name END), ''),
             name || '-clone') AS nn FROM fx_clusters c WHERE pinned),
s1 AS (SELECT *, regexp_replace(regexp_replace(lower(nn), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM p),
s2 AS (SELECT *, CASE WHEN s = '' THEN 'cluster' ELSE s END AS s0 FROM s1),
s3 AS (SELECT *, CASE WHEN length(s0) > 51 THEN regexp_replace(s0[1:51], '-+$', '') ELSE s0 END AS slug FROM s2)
SELECT id AS source_id, nn AS name, 'qs-' || slug || '-' || sha256(concat_ws('/', CAST(id AS VARCHAR), nn))[1:8] AS cr_name,
  owner, config FROM s3""")
def q_clone_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixture(spark, sf_dir, "fx_clusters")
    # Clone every pinned cluster; stopped ones are cloned without a new name.
    picks = c.filter(F.col("pinned")).select(
        "id", F.when(F.col("desired_state") == "Stopped", F.lit("  "))
        .otherwise(F.concat(F.lit("copy of "), "name")).alias("new_name"))
    return G.clone_rows(c, picks).select("source_id", "name", "cr_name", "owner", "config")


@query("add_columns", """
SELECT id, name, CASE WHEN desired_state = 'Stopped' THEN '{}' ELSE config END AS config,
  CASE WHEN desired_state = 'Stopped' THEN false ELSE pinned END AS pinned,
  CASE WHEN desired_state = 'Stopped' THEN 'Running' ELSE desired_state END AS desired_state,
  CASE WHEN desired_state = 'Stopped' THEN '' ELSE owner END AS owner FROM fx_clusters""")
def q_add_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixture(spark, sf_dir, "fx_clusters")
    # Stopped clusters' rows were written before the columns existed.
    old = c.filter(F.col("desired_state") == "Stopped").select("id", "name")
    new = c.filter(F.col("desired_state") != "Stopped").select("id", "name", "config", "pinned", "desired_state", "owner")
    both = old.unionByName(new, allowMissingColumns=True)
    return G.add_columns(both, {"config": "{}", "pinned": False, "desired_state": "Running", "owner": ""})
