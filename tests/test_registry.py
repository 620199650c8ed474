"""Registry mutations as table rewrites."""


import pytest

from lakeops.functions import exprs as X
from lakeops.operators import registry as G


def clusters(spark):
    return spark.createDataFrame([(1, "a", "qs-a", "Running", None), (2, "b", "qs-b", "Running", 10),
                                  (3, "c", "qs-c", "Stopped", 99)],
                                 "id long, name string, cr_name string, desired_state string, workspace_id long")


def test_insert_unique_conflicts(spark):
    base = clusters(spark)
    new = spark.createDataFrame([(4, "d", "qs-a", "Running", None), (5, "e", "qs-e", "Running", None),
                                 (6, "f", "qs-e", "Running", None), (7, "g", None, "Running", None),
                                 (8, "h", None, "Running", None)], base.schema)
    table, bad = G.insert_unique(base, new, [["cr_name"]], "id")
    assert sorted(r.id for r in table.collect()) == [1, 2, 3, 5, 7, 8]
    assert sorted((r.id, r.reason) for r in bad.collect()) == [(4, "exists:cr_name"), (6, "duplicate:cr_name")]


def test_update_delete_soft_delete(spark):
    base = clusters(spark)
    ch = spark.createDataFrame([(2, "Stopped"), (9, "Stopped")], "id long, desired_state string")
    table, unknown = G.update_by_key(base, ch, ["id"], at=X.ntz("2024-01-01 00:00:00"))
    rows = {r.id: (r.desired_state, r.updated_at is not None) for r in table.collect()}
    assert rows == {1: ("Running", False), 2: ("Stopped", True), 3: ("Stopped", False)}
    assert [r.id for r in unknown.collect()] == [9]
    kept, missing = G.delete_by_key(base, ch, ["id"])
    assert sorted(r.id for r in kept.collect()) == [1, 3] and [r.id for r in missing.collect()] == [9]
    nb = spark.createDataFrame([(1, None), (2, None)], "id long, trashed_at timestamp_ntz")
    t, _ = G.soft_delete(nb, spark.createDataFrame([(2,)], "id long"), ["id"], X.ntz("2024-02-01 00:00:00"))
    assert {r.id: r.trashed_at is not None for r in t.collect()} == {1: False, 2: True}


def test_cascade_set_null_orphans(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id long")
    child = spark.createDataFrame([(10, 1), (11, 3), (12, None)], "cid long, pid long")
    assert sorted(r.cid for r in G.cascade_delete(parents, child, "pid", "id").collect()) == [10]
    assert {r.cid: r.pid for r in G.set_null_fk(child, parents, "pid", "id").collect()} == {10: 1, 11: None, 12: None}
    assert [r.cid for r in G.orphan_audit(child, parents, "pid", "id").collect()] == [11]


def test_folder_closure_and_unique_audit(spark):
    f = spark.createDataFrame([(0, None), (1, 0), (2, 1), (3, 0)], "folder_id long, parent_id long")
    got = sorted(tuple(r) for r in G.folder_closure(f).collect())
    assert got == sorted([(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 1, 1), (1, 2, 1), (0, 2, 2), (0, 3, 1)])
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "path string")
    assert [(r.path, r.n) for r in G.unique_audit(df, ["path"]).collect()] == [("a", 2)]


def test_cycles_of_folders_are_named_before_anything_grows(spark):
    f = spark.createDataFrame([(0, None), (1, 0), (2, 3), (3, 2), (4, 2), (5, 5), (6, 99)], "folder_id long, parent_id long")
    with pytest.raises(ValueError, match=r"cycle: \[2, 3, 5\]"):
        G.folder_closure(f)
    ring = spark.range(3000).selectExpr("id as folder_id", "(id + 1) % 3000 as parent_id")
    with pytest.raises(ValueError, match="cycle"):
        G.folder_closure(ring)
    ok = spark.createDataFrame([(6, 99), (7, 6), (7, 6)], "folder_id long, parent_id long").distinct()
    assert sorted(tuple(r) for r in G.folder_closure(ok).collect()) == [(6, 6, 0), (6, 7, 1), (7, 7, 0), (99, 6, 1), (99, 7, 2)]


def in_order(base, rows, keys):
    taken = [{tuple(r[c] for c in k) for r in base if None not in [r[c] for c in k]} for k in keys]
    old = [set(t) for t in taken]
    out = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        reason = None
        values = [tuple(r[c] for c in k) for k in keys]
        for k, v, t, o in zip(keys, values, taken, old):
            if None not in v and v in t:
                reason = ("exists:" if v in o else "duplicate:") + "+".join(k)
                break
        out[r["id"]] = reason
        if reason is None:
            for v, t in zip(values, taken):
                if None not in v:
                    t.add(v)
    return out


@pytest.mark.parametrize("group", [50_000, 6])
def test_insert_with_several_keys_goes_in_order(spark, monkeypatch, group):
    """Components decided by one task, and (with a small bound) those that go through the steps again."""
    import random
    monkeypatch.setattr(G, "GROUP", group)
    rnd = random.Random(11)
    pick = lambda n: rnd.choice([None, *[f"v{i}" for i in range(n)]])
    rows = [dict(id=i, a=pick(40), b=pick(30), c=rnd.randrange(12)) for i in range(120)]
    base, keys = rows[:15], [["a"], ["b", "c"]]
    new = rows[15:]
    rnd.shuffle(new)
    frame = lambda rs: spark.createDataFrame([(r["id"], r["a"], r["b"], r["c"]) for r in rs], "id long, a string, b string, c long")
    table, conflicts = G.insert_unique(frame(base), frame(new), keys, "id")
    want = in_order(base, new, keys)
    assert {r.id: r.reason for r in conflicts.collect()} == {i: r for i, r in want.items() if r}
    assert {r.id for r in table.collect()} == {r["id"] for r in base} | {i for i, r in want.items() if r is None}


def test_insert_decides_a_long_chain_in_few_rounds(spark, monkeypatch):
    """Row i shares a key with i - 1 and with i + 1: every other one is free, however long the chain."""
    n, rounds = 10_000, []
    pinned = G._pinned
    monkeypatch.setattr(G, "_pinned", lambda df, name: rounds.append(name) or pinned(df, name))
    new = spark.range(n).selectExpr("id", "(id + 1) div 2 as a", "id div 2 as b")
    base = spark.createDataFrame([], "id long, a long, b long")
    table, conflicts = G.insert_unique(base, new, [["a"], ["b"]], "id")
    assert [r.id for r in table.orderBy("id").collect()] == list(range(0, n, 2))
    assert conflicts.count() == n // 2 and len(rounds) < 60


def test_clone_and_add_columns(spark):
    base = clusters(spark)
    picks = spark.createDataFrame([(1, "  "), (2, "New Name")], "id long, new_name string")
    got = {r.source_id: (r.name, r.cr_name[:-9]) for r in G.clone_rows(base, picks).collect()}
    assert got == {1: ("a-clone", "qs-a-clone"), 2: ("New Name", "qs-new-name")}
    old = spark.createDataFrame([(1,)], "id long")
    out = G.add_columns(old.unionByName(spark.createDataFrame([(2, True)], "id long, pinned boolean"),
                                        allowMissingColumns=True), {"pinned": False, "config": "{}"})
    assert {r.id: (r.pinned, r.config) for r in out.collect()} == {1: (False, "{}"), 2: (True, "{}")}


def test_lookup_and_lists(spark):
    base = clusters(spark)
    assert G.exists(G.lookup(base, cr_name="qs-b")) and not G.exists(G.lookup(base, cr_name="nope"))
    assert [r.id for r in G.list_ordered(base, ["id"]).collect()] == [1, 2, 3]
    nb = spark.createDataFrame([(1, "/b", None), (2, "/a", None), (3, "/c", "x")], "id long, path string, trashed_at string")
    assert [r.id for r in G.list_active(nb).collect()] == [2, 1]
    revs = spark.createDataFrame([(1, 1, "u"), (1, 2, "v"), (2, 1, "w")], "notebook_id long, rev long, author string")
    assert [r.rev for r in G.list_revisions(revs, 1).collect()] == [2, 1]
    assert G.list_revisions(revs).count() == 3
    g = spark.createDataFrame([("t", "1", "user", "b"), ("t", "1", "group", "a"), ("t", "2", "user", "c")],
                              "object_type string, object_id string, principal_type string, principal_id string")
    assert [r.principal_id for r in G.list_grants(g, "t", "1").collect()] == ["a", "b"]


def test_cascade_delete_tree(spark):
    f = spark.createDataFrame([(0, None), (1, 0), (2, 1), (3, 0), (4, 3)], "folder_id long, parent_id long")
    d = spark.createDataFrame([(1,), (9,)], "folder_id long")
    assert sorted(r.folder_id for r in G.cascade_delete_tree(f, d).collect()) == [0, 3, 4]


def test_update_with_several_changes_per_key(spark):
    base = clusters(spark)
    ch = spark.createDataFrame([(2, "Stopped", 1), (2, "Running", 2), (1, "Stopped", 5)],
                               "id long, desired_state string, seq long")
    table, _ = G.update_by_key(base, ch, ["id"], order_col="seq")
    assert {r.id: r.desired_state for r in table.collect()} == {1: "Stopped", 2: "Running", 3: "Stopped"}
    assert table.count() == 3


def test_get_one_and_not_found(spark):
    import pytest
    base = clusters(spark)
    assert G.get_one(base, cr_name="qs-b").id == 2
    with pytest.raises(G.NotFound):
        G.get_one(base, cr_name="missing")


def test_upsert_keeps_base_rows_without_a_number(spark):
    base = spark.createDataFrame([("k1", "old"), ("k2", "run")], "id string, level string")
    changes = spark.createDataFrame([("k1", "new", 5), ("k1", "newer", 6), ("k3", "x", 1)], "id string, level string, seq long")
    got = G.upsert_latest(base, changes, ["id"], "seq", keep_first=())
    assert {r["id"]: r["level"] for r in got.collect()} == {"k1": "newer", "k2": "run", "k3": "x"}


def test_a_change_can_clear_a_column(spark):
    base = spark.createDataFrame([(1, 5, 6), (2, 7, 8)], "id int, a int, b int")
    changes = spark.createDataFrame([(1, None, 9, ["a"])], "id int, a int, b int, clear array<string>")
    got, _ = G.update_by_key(base, changes, ["id"], clear_col="clear")
    assert sorted((r["id"], r["a"], r["b"]) for r in got.collect()) == [(1, None, 9), (2, 7, 8)]


def test_refused_rows_do_not_block_later_ones(spark):
    base = spark.createDataFrame([(1, "taken")], "id int, name string")
    new = spark.createDataFrame([(9, "taken", 1), (9, "x", 2), (8, "x", 3), (8, "y", 4)], "id int, name string, seq int")
    table, bad = G.insert_unique(base, new, [["id"], ["name"]], "seq")
    assert sorted((r["id"], r["name"]) for r in table.collect()) == [(1, "taken"), (8, "y"), (9, "x")]
    assert sorted((r["seq"], r["reason"]) for r in bad.collect()) == [(1, "exists:name"), (3, "duplicate:name")]


def test_deep_and_cyclic_folders(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(300)], "folder_id long, parent_id long")
    closure = G.folder_closure(chain)
    assert closure.count() == 300 * 301 // 2
    assert closure.filter("depth <> folder_id - ancestor_id").count() == 0
    gone = spark.createDataFrame([(250,)], "folder_id long")
    assert sorted(r["folder_id"] for r in G.cascade_delete_tree(chain, gone).collect()) == list(range(250))
    ring = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, None)], "folder_id long, parent_id long")
    with pytest.raises(ValueError):
        G.folder_closure(ring)
    assert [r["folder_id"] for r in G.cascade_delete_tree(ring, spark.createDataFrame([(2,)], "folder_id long")).collect()] == [4]
