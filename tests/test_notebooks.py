"""Notebook cells, exports, tree, revisions, markdown blocks, key/value maps."""

import json

from pyspark.sql import functions as F

from lakeops.operators import notebooks as N


def nb(spark, rows):
    return spark.createDataFrame(rows, "notebook_id long, content string")


def test_cells_normalized(spark):
    rows = [(1, '{"cells":[{"type":"markdown","source":"# t"},{"type":"sql"},{"source":"x"}]}'),
            (2, '{"cells":[]}'), (3, None), (4, "not json")]
    cells = N.notebook_cells(nb(spark, rows))
    got = [(r.notebook_id, r.pos, r.type, r.source) for r in cells.orderBy("notebook_id", "pos").collect()]
    assert got == [(1, 0, "markdown", "# t"), (1, 1, "code", ""), (1, 2, "code", "x"),
                   (2, 0, "code", ""), (3, 0, "code", ""), (4, 0, "code", "")]
    with_id = N.notebook_cells(nb(spark, [(5, '{"cells":[{"id":"a1","type":"code","source":"q"},{"source":"r"}]}')]))
    assert [(r.cell_id, r.source) for r in with_id.orderBy("pos").collect()] == [("a1", "q"), ("cell-2", "r")]
    assert [r.source for r in N.runnable_cells(with_id, "cell-2").collect()] == ["r"]


def test_export_script(spark):
    cells = N.notebook_cells(nb(spark, [(1, json.dumps({"cells": [
        {"type": "markdown", "source": "Title\nline"}, {"type": "code", "source": "x = 1"},
        {"type": "code", "source": "y = 2\n"}]})), ]))
    script = N.export_script(cells).first().script
    assert script == "# %% [markdown]\n# Title\n# line\n\n# %%\nx = 1\n\n# %%\ny = 2\n\n"


def test_export_ipynb(spark):
    cells = N.notebook_cells(nb(spark, [(1, '{"cells":[{"type":"markdown","source":"m"},{"type":"code","source":"c"}]}')]))
    doc = json.loads(N.export_ipynb(cells).first().ipynb)
    assert doc["nbformat"] == 4 and doc["nbformat_minor"] == 5
    assert doc["metadata"] == {"language_info": {"name": "python"}}
    assert doc["cells"][0] == {"cell_type": "markdown", "source": ["m"], "metadata": {}}
    assert doc["cells"][1] == {"cell_type": "code", "source": ["c"], "metadata": {}, "outputs": [],
                               "execution_count": None}


def test_run_frames(spark):
    r = spark.createDataFrame([(1, "out", ""), (2, "", "boom"), (3, "o", "e"), (4, "", "")],
                              "run_id long, stdout string, error string")
    got = [(x.run_id, x.pos, x.type) for x in N.run_frames(r).orderBy("run_id", "pos").collect()]
    assert got == [(1, 0, "stdout"), (2, 0, "error"), (3, 0, "stdout"), (3, 1, "error")]


def tree(spark, rows):
    df = spark.createDataFrame(rows, "notebook_id string, name string, path string")
    return N.workspace_tree(df).collect()


def brute_tree(rows):
    """Folder and notebook nodes by the rule: one folder for each proper prefix of a path, one leaf for each notebook."""
    nodes = set()
    for key, name, path in rows:
        steps = [p for p in path.split("/") if p.strip()]
        for d in range(1, len(steps)):
            nodes.add(("dir:/" + "/".join(steps[:d]), "dir:/" + "/".join(steps[:d - 1]) if d > 1 else "", "folder", steps[d - 1], d))
        label = name.strip() or (steps[-1] if steps else None)
        nodes.add((f"nb:{key}", "dir:/" + "/".join(steps[:-1]) if len(steps) > 1 else "", "notebook", label, max(len(steps), 1)))
    return nodes


def test_tree_of_random_paths(spark):
    import random
    rnd = random.Random(21)
    steps = ["ore", "Tin", "iron", "Zinc", "lead"]
    rows = [(f"k{i}", rnd.choice(["", "  ", f"own {i}"]), rnd.choice(["", "/", "//"]) + "/".join(rnd.choices(steps, k=rnd.randint(1, 4))) + f"/leaf{i}")
            for i in range(60)]
    rows += [("flat", "", "lonely"), ("twin1", "", "/ore/same"), ("twin2", "", "/ore/same")]
    got = tree(spark, rows)
    assert {(r.node_id, r.parent_id, r.kind, r.label, r.depth) for r in got} == brute_tree(rows) and len(got) == len(brute_tree(rows))
    for parent in {r.parent_id for r in got}:
        shown = [(r.kind == "notebook", r.label.casefold()) for r in got if r.parent_id == parent]
        assert shown == sorted(shown)
    assert tree(spark, []) == []


def test_defaults_and_resolve(spark):
    df = spark.createDataFrame([(1, "a", " ", None, None), (2, "b", "/x/b", "{}", 5), (3, "c", "/c", None, 9)],
                               "notebook_id long, name string, path string, content string, attached_cluster_id long")
    d = {r.notebook_id: (r.path, r.content) for r in N.notebook_defaults(df).collect()}
    assert d[1] == ("/a", N.EMPTY_CONTENT) and d[2] == ("/x/b", "{}")
    cl = spark.createDataFrame([(5, "qs-5")], "id long, cr_name string")
    out = {r.notebook_id: (r.outcome, r.connect_url) for r in N.resolve_target(df, cl).collect()}
    assert out == {1: ("no_cluster", None), 2: ("ok", "sc://qs-5-server:15002"), 3: ("cluster_error", None)}


def test_revisions_restore_and_save(spark):
    notebooks = spark.createDataFrame([(1, "v2", "owner1"), (2, "w1", "owner2")],
                                      "notebook_id long, content string, owner string")
    revs = spark.createDataFrame([(1, 1, "v1"), (1, 2, "v2"), (2, 1, "w1")], "notebook_id long, rev long, snapshot string")
    picks = spark.createDataFrame([(1, 1), (2, 1), (2, 7)], "notebook_id long, rev long")
    restored, unknown = N.restore_revision(notebooks, revs, picks.filter("rev < 5"))
    assert {r.notebook_id: r.content for r in restored.collect()} == {1: "v1", 2: "w1"}
    _, unknown = N.restore_revision(notebooks, revs, picks)
    assert [(r.notebook_id, r.rev) for r in unknown.collect()] == [(2, 7)]
    saved = N.save_revision(notebooks, spark.createDataFrame([(1, "m")], "notebook_id long, message string"),
                            F.lit(None).cast("timestamp_ntz")).first()
    assert (saved.author, saved.snapshot, saved.message) == ("owner1", "v2", "m")
    latest = {r.notebook_id: r.rev for r in N.latest_revision(revs).collect()}
    assert latest == {1: 2, 2: 1}


def test_entries_to_map(spark):
    pairs = spark.createDataFrame([(1, 1, " a ", "x"), (1, 2, "a", "y"), (1, 3, "  ", "z"), (1, 0, "b", "w")],
                                  "map_id long, pos long, k string, v string")
    assert N.entries_to_map(pairs).first().entries == {"a": "y", "b": "w"}


MD = """# Title
para one
continues here

- item a
* item b
1. first
2. second
```
code line

more code
```
## Sub
text"""


def test_markdown_blocks(spark):
    df = spark.createDataFrame([(1, MD), (2, "plain\r\nlines"), (3, "```\nunterminated")], "doc_id long, text string")
    got = [(r.doc_id, r.kind, r.level, r.text) for r in N.markdown_blocks(df).orderBy("doc_id", "block_no").collect()]
    assert got == [
        (1, "heading", 1, "Title"), (1, "p", None, "para one continues here"), (1, "ul", None, "item a\nitem b"),
        (1, "ol", None, "first\nsecond"), (1, "code", None, "code line\n\nmore code"), (1, "heading", 2, "Sub"),
        (1, "p", None, "text"), (2, "p", None, "plain lines"), (3, "code", None, "unterminated")]
