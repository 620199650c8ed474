"""Notebook collections: cells, exports, revisions, restore, folder tree, blocks.

K1-K8, J5, J6, N1, N4, A6, O2.  A notebook's content is one JSON document
``{"cells": [{"type", "source"}]}``; cells are exploded with their position
so every per-cell rule is a column expression, and per-notebook texts are
reassembled with one ordered ``collect_list`` per notebook (a notebook is a
bounded document).  Tree building, latest-per-key and block detection use
exploded prefixes, hash aggregates and running window sums instead of
recursive or row-by-row code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lakeops.functions import exprs as X

# Empty content, markers of the script export, connect URL form,
# and the markdown line patterns (heading, bullet item, numbered item, fence).
EMPTY_CONTENT = '{"cells":[]}'
SCRIPT_CELL = "# %%\n"
SCRIPT_MARKDOWN_CELL = "# %% [markdown]\n"
SCRIPT_COMMENT = "# "
CONNECT_PREFIX = "sc://"
CONNECT_SUFFIX = "-server:15002"
IPYNB_METADATA = '{"language_info":{"name":"python"}}'
IPYNB_FORMAT = 4
IPYNB_MINOR = 5
_HEADING = r"^(#{1,6})\s+(.*)$"
_UL = r"^\s*[-*]\s+"
_OL = r"^\s*\d+\.\s+"
_FENCE = r"^```"

CONTENT_SCHEMA = T.StructType([T.StructField("cells", T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("source", T.StringType()),
])))])


def notebook_content(cells: DataFrame, key: str = "notebook_id", pos: str = "pos",
                     type_col: str = "type", source_col: str = "source") -> DataFrame:
    """(key, content): cells rows folded into one content JSON per notebook."""
    agg = cells.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        F.col(pos).alias("p"), F.col(type_col).alias("type"), F.col(source_col).alias("source")))).alias("_c"))
    body = F.struct(F.transform("_c", lambda c: F.struct(c["type"].alias("type"),
                                                         c["source"].alias("source"))).alias("cells"))
    return agg.select(key, F.to_json(body).alias("content"))


def notebook_cells(notebooks: DataFrame, key: str = "notebook_id", content_col: str = "content") -> DataFrame:
    """(key, pos, cell_id, type, source): ordered cells of each notebook (K1).

    Type other than ``markdown`` -> ``code``; missing source -> ''; a notebook
    without cells (or with unreadable content) gets one empty code cell.  A
    cell without an id gets ``cell-<pos + 1>`` (deterministic, unlike a
    random editor id, so reruns agree).
    """
    parsed = F.from_json(F.col(content_col), CONTENT_SCHEMA)
    cells = F.coalesce(parsed["cells"], F.array().cast(CONTENT_SCHEMA["cells"].dataType))
    empty = F.array(F.struct(F.lit(None).cast("string").alias("id"), F.lit("code").alias("type"),
                             F.lit("").alias("source")))
    cells = F.when(F.size(cells) == 0, empty).otherwise(cells)
    ex = notebooks.select(key, F.posexplode(cells).alias("pos", "c"))
    cell_id = F.when(F.coalesce(X.js_trim(F.col("c.id")), F.lit("")) != "", F.col("c.id")).otherwise(
        F.concat(F.lit("cell-"), (F.col("pos") + 1).cast("string")))
    return ex.select(key, "pos", cell_id.alias("cell_id"),
                     F.when(F.col("c.type") == "markdown", "markdown").otherwise("code").alias("type"),
                     F.coalesce(F.col("c.source"), F.lit("")).alias("source"))


def runnable_cells(cells: DataFrame, cell_id: str | None = None, key: str = "notebook_id") -> DataFrame:
    """Code cells in order, all of them or one chosen cell (K2)."""
    c = cells.filter(F.col("type") == "code")
    if cell_id is not None:
        c = c.filter(F.col("cell_id") == cell_id)
    return c.orderBy(key, "pos")


def cell_script_text(type_col: Column, source: Column) -> Column:
    """One cell rendered for the ``# %%`` script export, blank line included."""
    md = F.concat(F.lit(SCRIPT_MARKDOWN_CELL),
                  F.array_join(F.transform(F.split(source, "\n", -1),
                                           lambda ln: F.concat(F.lit(SCRIPT_COMMENT), ln, F.lit("\n"))), ""))
    code = F.concat(F.lit(SCRIPT_CELL), source, F.when(source.endswith("\n"), F.lit("")).otherwise(F.lit("\n")))
    return F.concat(F.when(type_col == "markdown", md).otherwise(code), F.lit("\n"))


def _ordered_concat(cells: DataFrame, key: str, text: Column, sep: str = "") -> DataFrame:
    agg = cells.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("p"),
                                                                       text.alias("t")))).alias("_x"))
    return agg.select(key, F.array_join(F.transform("_x", lambda x: x["t"]), sep).alias("_text"))


def export_script(cells: DataFrame, key: str = "notebook_id") -> DataFrame:
    """(key, script): every notebook as a ``# %%`` Python script (K3)."""
    return _ordered_concat(cells, key, cell_script_text(F.col("type"), F.col("source"))) \
        .withColumnRenamed("_text", "script")


def export_ipynb(cells: DataFrame, key: str = "notebook_id") -> DataFrame:
    """(key, ipynb): nbformat 4.5 JSON per notebook (K4).

    Code cells carry ``outputs: []`` and ``execution_count: null``; markdown
    cells carry neither.
    """
    meta = F.create_map().cast(T.MapType(T.StringType(), T.StringType()))
    src = F.array(F.col("source"))
    code = F.to_json(F.struct(F.lit("code").alias("cell_type"), src.alias("source"), meta.alias("metadata"),
                              F.array().cast("array<string>").alias("outputs"),
                              F.lit(None).cast("int").alias("execution_count")),
                     {"ignoreNullFields": "false"})
    md = F.to_json(F.struct(F.lit("markdown").alias("cell_type"), src.alias("source"), meta.alias("metadata")))
    text = F.when(F.col("type") == "markdown", md).otherwise(code)
    j = _ordered_concat(cells, key, text, ",")
    doc = F.concat(F.lit('{"cells":['), F.col("_text"), F.lit('],"metadata":'), F.lit(IPYNB_METADATA),
                   F.lit(f',"nbformat":{IPYNB_FORMAT},"nbformat_minor":{IPYNB_MINOR}}}'))
    return j.select(key, doc.alias("ipynb"))


def run_frames(results: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, pos, type, text): stdout frame if non-empty, then error frame (K5)."""
    frames = F.filter(F.array(F.struct(F.lit("stdout").alias("type"), F.col("stdout").alias("text")),
                              F.struct(F.lit("error").alias("type"), F.col("error").alias("text"))),
                      lambda f: F.coalesce(f["text"], F.lit("")) != "")
    return results.select(key, F.posexplode(frames).alias("pos", "f")).select(
        key, "pos", F.col("f.type").alias("type"), F.col("f.text").alias("text"))


def workspace_tree(notebooks: DataFrame, key: str = "notebook_id") -> DataFrame:
    """Folder and notebook nodes of the workspace, in display order (K6, O2).

    Columns: node_id (``dir:/a/b`` or ``nb:<id>``), parent_id ('' at the top),
    kind, label, depth.  One pass over the notebooks: each row becomes its
    leaf node plus one folder node per proper prefix of its path (blank
    segments ignored); a hash aggregate de-duplicates the folders (leaf ids
    are unique already).  The final global sort puts folders before
    notebooks, each by label under a case-insensitive Unicode collation, and
    range-partitions so a crowded folder spans many tasks.
    """
    segs = X.path_segments(F.col("path"))
    base = notebooks.select(key, segs.alias("_segs"), X.display_name("name", "path").alias("_label"))
    folders_of = F.slice("_segs", 1, F.greatest(F.size("_segs") - 1, F.lit(0)))
    base = base.withColumn("_folders", folders_of)

    def dir_id(parts: Column) -> Column:
        return F.concat(F.lit("dir:/"), F.array_join(parts, "/"))

    def node(node_id: Column, parent: Column, kind: str, label: Column, depth: Column) -> Column:
        return F.struct(node_id.alias("node_id"), parent.alias("parent_id"), F.lit(kind).alias("kind"),
                        label.alias("label"), depth.cast("int").alias("depth"))

    n_folders = F.size("_folders")
    leaf = node(F.concat(F.lit("nb:"), F.col(key).cast("string")),
                F.when(n_folders == 0, F.lit("")).otherwise(dir_id(F.col("_folders"))),
                "notebook", F.col("_label"), n_folders + 1)
    folder_nodes = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(n_folders, F.lit(1))), lambda d: d <= n_folders),
        lambda d: node(dir_id(F.slice("_folders", 1, d)),
                       F.when(d == 1, F.lit("")).otherwise(dir_id(F.slice("_folders", 1, d - 1))),
                       "folder", F.element_at("_folders", d), d))
    tree = (base.select(F.explode(F.concat(F.array(leaf), folder_nodes)).alias("n"))
            .select("n.*").distinct())
    kind_rank = F.when(F.col("kind") == "folder", 0).otherwise(1)
    # Case-insensitive Unicode collation, as a locale-aware label compare sorts.
    return tree.orderBy("parent_id", kind_rank, F.collate(F.col("label"), "UNICODE_CI"), "node_id")


def save_revision(notebooks: DataFrame, picks: DataFrame, at: Column, key: str = "notebook_id") -> DataFrame:
    """New revision rows: current content, author = notebook owner (K7).

    ``picks`` has ``key`` and ``message``.  The author is the owner, not the
    caller, as the workspace records it.
    """
    j = notebooks.select(key, "content", "owner").join(picks.select(key, "message"), key)
    return j.select(key, F.col("content").alias("snapshot"), F.coalesce("message", F.lit("")).alias("message"),
                    F.col("owner").alias("author"), at.alias("created_at"))


def notebook_defaults(df: DataFrame) -> DataFrame:
    """Blank path -> '/' + name; missing content -> empty cell list (K8)."""
    path = F.when(X.js_trim(F.coalesce(F.col("path"), F.lit(""))) == "", F.concat(F.lit("/"), F.col("name"))) \
        .otherwise(F.col("path"))
    content = F.col("content") if "content" in df.columns else F.lit(None).cast("string")
    return df.withColumns({"path": path, "content": F.coalesce(content, F.lit(EMPTY_CONTENT))})


def resolve_target(notebooks: DataFrame, clusters: DataFrame, key: str = "notebook_id",
                   fk: str = "attached_cluster_id") -> DataFrame:
    """(key, outcome, connect_url) per notebook.

    No attached cluster -> ``no_cluster``; attached id not in the registry ->
    ``cluster_error``; else ``ok`` with the Spark Connect URL.
    """
    cl = clusters.select(F.col("id").alias(fk), "cr_name")
    j = notebooks.select(key, fk).join(cl, fk, "left")
    blank = F.coalesce(F.col(fk).cast("string"), F.lit("")) == ""
    outcome = F.when(blank, "no_cluster").when(F.col("cr_name").isNull(), "cluster_error").otherwise("ok")
    url = F.when(outcome == "ok", F.concat(F.lit(CONNECT_PREFIX), F.col("cr_name"), F.lit(CONNECT_SUFFIX)))
    return j.select(key, outcome.alias("outcome"), url.alias("connect_url"))


def restore_revision(notebooks: DataFrame, revisions: DataFrame, picks: DataFrame,
                     key: str = "notebook_id", rev: str = "rev") -> tuple[DataFrame, DataFrame]:
    """Notebook content := picked revision's snapshot.

    ``picks`` has ``key`` and ``rev``; the revision must belong to that
    notebook (joined on both keys).  Returns ``(notebooks, unknown_picks)``.
    """
    snap = revisions.select(key, rev, F.col("snapshot").alias("_snap"))
    hit = picks.select(key, rev).join(snap, [key, rev])
    unknown = picks.select(key, rev).join(snap, [key, rev], "left_anti")
    j = notebooks.join(hit.select(key, "_snap", F.col(rev).alias("restored_rev")), key, "left")
    return (j.withColumn("content", F.coalesce("_snap", "content")).drop("_snap"), unknown)


def latest_revision(revisions: DataFrame, key: str = "notebook_id", order_col: str = "rev") -> DataFrame:
    """Newest revision per notebook (N1), as a partial+final hash aggregate."""
    rest = [c for c in revisions.columns if c != key]
    agg = revisions.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order_col)).alias("_r"))
    return agg.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def entries_to_map(pairs: DataFrame, group: str = "map_id", pos: str = "pos",
                   k: str = "k", v: str = "v") -> DataFrame:
    """(group, entries map): trimmed keys, blank keys dropped, last row wins."""
    last = (pairs.withColumn("_k", X.js_trim(F.col(k))).filter(F.col("_k") != "")
            .groupBy(group, "_k").agg(F.max_by(F.col(v), F.col(pos)).alias("_v")))
    return last.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(F.col("_k"), F.col("_v"))))).alias("entries"))


# --- N4: markdown blocks ------------------------------------------------------------



def markdown_blocks(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, block_no, kind, level, text) block structure of markdown texts.

    Lines are classified with regexes; the ``` fence state is a running sum
    of fence lines (odd = inside code); a new block starts where the class
    changes, at each heading and at each opening fence, and block numbers are
    the running count of starts (gaps and islands).  List items are joined
    with newlines, paragraph lines with spaces, code lines verbatim.

    Plan: the documents are hash-partitioned by ``key`` once, before their
    text is split into lines; the line rows keep that partitioning, so every
    window below (all ``partitionBy(key)``) and the final per-block aggregate
    run without another shuffle.  A document's lines come from a single row,
    so no window partition holds more than one stored text.
    """
    w = Window.partitionBy(key).orderBy("i")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = docs.select(key, text_col).repartition(key).select(
        key, F.posexplode(F.split(F.regexp_replace(F.col(text_col), r"\r\n?", "\n"), "\n", -1)).alias("i", "line"))
    lines = lines.withColumn("_fence", X.js_trim(F.col("line")).rlike(_FENCE))
    lines = lines.withColumn("_nf", F.sum(F.col("_fence").cast("int")).over(run))
    in_code = (F.col("_nf") % 2 == 1) | F.col("_fence")
    cls = (F.when(in_code, "code")
           .when(X.js_trim(F.col("line")) == "", "blank")
           .when(F.col("line").rlike(_HEADING), "heading")
           .when(F.col("line").rlike(_UL), "ul")
           .when(F.col("line").rlike(_OL), "ol")
           .otherwise("p"))
    lines = lines.withColumn("_cls", cls).withColumn("_open", F.col("_fence") & (F.col("_nf") % 2 == 1))
    lines = lines.withColumn("_prev", F.lag("_cls").over(w))
    start = (F.col("_cls") != "blank") & (F.col("_open") | (F.col("_cls") == "heading")
                                          | ~F.coalesce(F.col("_prev") == F.col("_cls"), F.lit(False)))
    lines = lines.withColumn("block_no", F.sum(start.cast("int")).over(run)).filter(F.col("_cls") != "blank")
    payload = (F.when(F.col("_cls") == "heading", X.js_trim(F.regexp_extract("line", _HEADING, 2)))
               .when(F.col("_cls") == "ul", F.regexp_replace("line", _UL, ""))
               .when(F.col("_cls") == "ol", F.regexp_replace("line", _OL, ""))
               .when((F.col("_cls") == "code") & F.col("_fence"), F.lit(None))
               .otherwise(F.col("line")))
    level = F.when(F.col("_cls") == "heading", F.length(F.regexp_extract("line", _HEADING, 1)))
    agg = lines.groupBy(key, "block_no").agg(
        F.first("_cls").alias("kind"), F.max(level).alias("level"),
        F.array_sort(F.collect_list(F.struct("i", payload.alias("t")))).alias("_parts"))
    texts = F.transform(F.filter("_parts", lambda x: x["t"].isNotNull()), lambda x: x["t"])
    text = F.when(F.col("kind") == "p", F.array_join(texts, " ")).otherwise(F.array_join(texts, "\n"))
    return agg.select(key, "block_no", "kind", F.col("level").cast("int").alias("level"), text.alias("text"))
