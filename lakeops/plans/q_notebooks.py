"""Registered notebook queries: K1-K8, J5, J6, N1, N4, A6, O2."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeops.fixtures import fixture, table
from lakeops.functions import exprs as X
from lakeops.operators import notebooks as N
from lakeops.plans.catalogue import query

SAVED_AT = "2024-02-15 00:00:00"
RESTORE_REV = 1


def cells_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as notebook cells (notebook_id, pos, type, source)."""
    r = fixture(spark, sf_dir, "fx_revisions")
    return r.select("notebook_id", F.col("rev").alias("pos"), F.col("cell_type").alias("type"), "source")


def notebooks_with_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    nb = fixture(spark, sf_dir, "fx_notebooks")
    content = N.notebook_content(cells_source(spark, sf_dir))
    return N.notebook_defaults(nb.join(content, "notebook_id", "left"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.notebook_cells(notebooks_with_content(spark, sf_dir))


_CELLS = """
WITH c AS (
  SELECT n.notebook_id, CAST(row_number() OVER (PARTITION BY r.notebook_id ORDER BY r.rev) - 1 AS INTEGER) AS pos,
    'cell-' || CAST(row_number() OVER (PARTITION BY r.notebook_id ORDER BY r.rev) AS VARCHAR) AS cell_id,
    CASE WHEN r.cell_type = 'markdown' THEN 'markdown' ELSE 'code' END AS type, COALESCE(r.source, '') AS source
  FROM fx_notebooks n JOIN fx_revisions r ON r.notebook_id = n.notebook_id
  UNION ALL
  SELECT notebook_id, 0, 'cell-1', 'code', '' FROM fx_notebooks n
  WHERE NOT EXISTS (SELECT 1 FROM fx_revisions r WHERE r.notebook_id = n.notebook_id))
"""


@query("notebook_cells", _CELLS + "SELECT * FROM c")
def q_notebook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir)


@query("runnable_cells", _CELLS + "SELECT * FROM c WHERE type = 'code'")
def q_runnable_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.runnable_cells(cells(spark, sf_dir))


@query("export_script", _CELLS + """
SELECT notebook_id, string_agg(
  CASE WHEN type = 'markdown'
       THEN '# %% [markdown]' || chr(10) || array_to_string(list_transform(string_split(source, chr(10)), lambda l: '# ' || l || chr(10)), '')
       ELSE '# %' || '%' || chr(10) || source || CASE WHEN suffix(source, chr(10)) THEN '' ELSE chr(10) END END || chr(10),
  '' ORDER BY pos) AS script
FROM c GROUP BY notebook_id""")
def q_export_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.export_script(cells(spark, sf_dir))


@query("export_ipynb", _CELLS + """
SELECT notebook_id, '{"cells":[' || string_agg(
  CASE WHEN type = 'markdown' THEN '{"cell_type":"markdown","source":' || CAST(to_json([source]) AS VARCHAR) || ',"metadata":{}}'
       ELSE '{"cell_type":"code","source":' || CAST(to_json([source]) AS VARCHAR) ||
            ',"metadata":{},"outputs":[],"execution_count":null}' END, ',' ORDER BY pos)
  || '],"metadata":{"language_info":{"name":"python"}},"nbformat":4,"nbformat_minor":5}' AS ipynb
FROM c GROUP BY notebook_id""")
def q_export_ipynb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.export_ipynb(cells(spark, sf_dir))


@query("run_frames", """
SELECT run_id, 0 AS pos, 'stdout' AS type, stdout AS text FROM fx_runs WHERE stdout <> ''
UNION ALL
SELECT run_id, CASE WHEN stdout <> '' THEN 1 ELSE 0 END, 'error', error FROM fx_runs WHERE error <> ''""")
def q_run_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.run_frames(fixture(spark, sf_dir, "fx_runs"))


@query("workspace_tree", """
WITH a AS (
  SELECT notebook_id, name, path, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs
  FROM fx_notebooks WHERE trashed_at IS NULL),
b AS (SELECT *, list_slice(segs, 1, greatest(len(segs) - 1, 0)) AS folders,
        regexp_replace(name, '^\\s+|\\s+$', '', 'g') AS n, segs[-1] AS tail FROM a),
f AS (SELECT DISTINCT 'dir:/' || array_to_string(list_slice(folders, 1, d), '/') AS node_id,
        CASE WHEN d = 1 THEN '' ELSE 'dir:/' || array_to_string(list_slice(folders, 1, d - 1), '/') END AS parent_id,
        'folder' AS kind, folders[d] AS label, CAST(d AS INTEGER) AS depth
      FROM (SELECT folders, unnest(range(1, len(folders) + 1)) AS d FROM b))
SELECT * FROM f
UNION ALL
SELECT 'nb:' || CAST(notebook_id AS VARCHAR), CASE WHEN len(folders) = 0 THEN '' ELSE 'dir:/' || array_to_string(folders, '/') END,
  'notebook', CASE WHEN n <> '' THEN n WHEN COALESCE(regexp_replace(tail, '^\\s+|\\s+$', '', 'g'), '') <> '' THEN tail
  ELSE 'Untitled' END, CAST(len(folders) + 1 AS INTEGER) FROM b""")
def q_workspace_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nb = fixture(spark, sf_dir, "fx_notebooks").filter(F.col("trashed_at").isNull())
    return N.workspace_tree(nb)


@query("save_revision", f"""
SELECT n.notebook_id, 'autosave' AS message, n.owner AS author, TIMESTAMP '{SAVED_AT}' AS created_at,
  CAST((SELECT count(*) FROM fx_revisions r WHERE r.notebook_id = n.notebook_id) AS INTEGER) AS n_cells
FROM fx_notebooks n WHERE n.attached_cluster_id IS NOT NULL""")
def q_save_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    nb = notebooks_with_content(spark, sf_dir)
    # Autosave every notebook that is attached to a cluster.
    picks = nb.filter(F.col("attached_cluster_id").isNotNull()).select("notebook_id", F.lit("autosave").alias("message"))
    rev = N.save_revision(nb, picks, X.ntz(SAVED_AT))
    n_cells = F.size(F.from_json("snapshot", N.CONTENT_SCHEMA)["cells"])
    return rev.select("notebook_id", "message", "author", "created_at", n_cells.alias("n_cells"))


@query("notebook_defaults", """
SELECT notebook_id, CASE WHEN trim(path) = '' THEN '/' || name ELSE path END AS path,
  NOT EXISTS (SELECT 1 FROM fx_revisions r WHERE r.notebook_id = n.notebook_id) AS default_content
FROM fx_notebooks n""")
def q_notebook_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    nb = notebooks_with_content(spark, sf_dir)
    return nb.select("notebook_id", "path", (F.col("content") == N.EMPTY_CONTENT).alias("default_content"))


@query("resolve_target", """
SELECT n.notebook_id,
  CASE WHEN n.attached_cluster_id IS NULL THEN 'no_cluster' WHEN c.id IS NULL THEN 'cluster_error' ELSE 'ok' END AS outcome,
  CASE WHEN c.id IS NOT NULL THEN 'sc://' || c.cr_name || '-server:15002' END AS connect_url
FROM fx_notebooks n LEFT JOIN fx_clusters c ON c.id = n.attached_cluster_id""")
def q_resolve_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.resolve_target(fixture(spark, sf_dir, "fx_notebooks"), fixture(spark, sf_dir, "fx_clusters"))


@query("restore_revision", f"""
WITH p AS (SELECT notebook_id, CAST({RESTORE_REV} AS BIGINT) AS rev FROM fx_notebooks WHERE trashed_at IS NULL),
hit AS (SELECT p.notebook_id, p.rev, r.source FROM p JOIN fx_revisions r ON r.notebook_id = p.notebook_id AND r.rev = p.rev)
SELECT n.notebook_id, CASE WHEN h.notebook_id IS NOT NULL THEN 'restored' ELSE 'unchanged' END AS status,
  h.rev AS restored_rev, h.source AS content FROM fx_notebooks n LEFT JOIN hit h ON h.notebook_id = n.notebook_id
UNION ALL
SELECT p.notebook_id, 'unknown_revision', p.rev, NULL FROM p
WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.notebook_id = p.notebook_id)""")
def q_restore_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    nb = notebooks_with_content(spark, sf_dir).select("notebook_id", "content")
    revs = fixture(spark, sf_dir, "fx_revisions").select("notebook_id", "rev", F.col("source").alias("snapshot"))
    # Every notebook not in the trash goes back to its first revision; those
    # without one are reported.
    picks = (fixture(spark, sf_dir, "fx_notebooks").filter(F.col("trashed_at").isNull())
             .select("notebook_id", F.lit(RESTORE_REV).cast("long").alias("rev")))
    restored, unknown = N.restore_revision(nb, revs, picks)
    done = F.col("restored_rev").isNotNull()
    return (restored.select("notebook_id", F.when(done, "restored").otherwise("unchanged").alias("status"),
                            "restored_rev", F.when(done, F.col("content")).alias("content"))
            .unionByName(unknown.select("notebook_id", F.lit("unknown_revision").alias("status"),
                                        F.col("rev").alias("restored_rev"),
                                        F.lit(None).cast("string").alias("content"))))


@query("latest_revision", """
SELECT notebook_id, arg_max(rev, rev) AS rev, arg_max(source, rev) AS source, arg_max(author, rev) AS author,
  arg_max(cell_type, rev) AS cell_type FROM fx_revisions GROUP BY notebook_id""")
def q_latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.latest_revision(fixture(spark, sf_dir, "fx_revisions"))


@query("entries_to_map", """
SELECT map_id, trim(k) AS key, arg_max(v, pos) AS value FROM fx_pairs WHERE trim(k) <> '' GROUP BY map_id, trim(k)""")
def q_entries_to_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = N.entries_to_map(fixture(spark, sf_dir, "fx_pairs"))
    return m.select("map_id", F.explode("entries").alias("key", "value"))


@query("markdown_blocks", r"""
WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS arr FROM documents),
l AS (SELECT doc_id, i, arr[i + 1] AS line FROM (SELECT doc_id, arr, unnest(range(len(arr))) AS i FROM s)),
f AS (SELECT *, regexp_matches(trim(line), '^```') AS fence FROM l),
n AS (SELECT *, sum(CAST(fence AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS nf FROM f),
c AS (SELECT *, CASE WHEN nf % 2 = 1 OR fence THEN 'code' WHEN trim(line) = '' THEN 'blank'
    WHEN regexp_matches(line, '^(#{1,6})\s+(.*)$') THEN 'heading' WHEN regexp_matches(line, '^\s*[-*]\s+') THEN 'ul'
    WHEN regexp_matches(line, '^\s*\d+\.\s+') THEN 'ol' ELSE 'p' END AS cls, fence AND nf % 2 = 1 AS opening FROM n),
p AS (SELECT *, lag(cls) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM c),
b AS (SELECT *, sum(CASE WHEN cls <> 'blank' AND (opening OR cls = 'heading' OR prev IS NULL OR prev <> cls) THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS block_no FROM p),
t AS (SELECT *, CASE WHEN cls = 'heading' THEN trim(regexp_extract(line, '^(#{1,6})\s+(.*)$', 2))
    WHEN cls = 'ul' THEN regexp_replace(line, '^\s*[-*]\s+', '') WHEN cls = 'ol' THEN regexp_replace(line, '^\s*\d+\.\s+', '')
    WHEN cls = 'code' AND fence THEN NULL ELSE line END AS x FROM b WHERE cls <> 'blank')
SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, any_value(cls) AS kind,
  CAST(max(CASE WHEN cls = 'heading' THEN length(regexp_extract(line, '^(#{1,6})\s+(.*)$', 1)) END) AS INTEGER) AS level,
  COALESCE(CASE WHEN any_value(cls) = 'p' THEN string_agg(x, ' ' ORDER BY i) ELSE string_agg(x, chr(10) ORDER BY i) END, '') AS text
FROM t GROUP BY doc_id, block_no""")
def q_markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return N.markdown_blocks(docs)


# Three cells over the whole events table: a temp view, an aggregate that
# reads it, a failing cell, then a cell that still sees the view.
SQL_CELLS = [
    "CREATE OR REPLACE TEMP VIEW {cells} AS SELECT event_type, value FROM {events}",
    "SELECT event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,4))) AS total FROM {cells} GROUP BY event_type "
    "ORDER BY event_type",
    "SELECT no_such_column FROM {cells}",
    "SELECT count(*) AS big FROM {cells} WHERE value > 100",
]


@query("run_sql_cells", """
WITH t AS (SELECT event_type, CAST(count(*) AS VARCHAR) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS VARCHAR) AS total FROM events GROUP BY event_type)
SELECT 0 AS cell, 'result' AS type, '' AS columns, CAST(NULL AS INTEGER) AS row_no, CAST(NULL AS VARCHAR) AS cells
UNION ALL SELECT 1, 'result', 'event_type,n,total', CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER), event_type || '|' || n || '|' || total FROM t
UNION ALL SELECT 2, 'error', NULL, NULL, 'AnalysisException'
UNION ALL SELECT 3, 'result', 'big', 0, CAST(count(*) AS VARCHAR) FROM events WHERE value > 100""")
def q_run_sql_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells' frames taken apart: a row for each row of a result, and the kind of an error."""
    from lakeops.operators.cells import frames, run_sql_cells
    names = {k: f"lakeops_{k}_{uuid.uuid4().hex[:12]}" for k in ("events", "cells")}
    table(spark, sf_dir, "events").createOrReplaceTempView(names["events"])
    try:
        shown = frames(spark, run_sql_cells(spark, [c.format(**names) for c in SQL_CELLS]))
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)
    body = F.from_json("text", "columns array<string>, rows array<array<string>>")
    rows = shown.withColumn("r", F.when(F.col("type") == "result", body)).select(
        "cell", "type", "text", "r.columns", F.posexplode_outer("r.rows").alias("row_no", "values"))
    return rows.select("cell", "type", F.array_join("columns", ",").alias("columns"), "row_no", F.when(
        F.col("type") == "error", F.regexp_extract("text", "^([A-Za-z]+)", 1)).otherwise(F.array_join("values", "|")).alias("cells"))
