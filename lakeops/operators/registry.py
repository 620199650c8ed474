"""Keyed registry tables: lookups, listings and mutations as table rewrites.

R1-R5 read paths and W1-W12 mutations.  Parquet tables refuse DELETE /
UPDATE / MERGE, so every mutation is a pure ``DataFrame -> DataFrame``
function whose result the caller writes as the new table version
(``lakeops.sources.tables.replace_rows``).

Skew: "latest per key" and "first per key" use hash aggregates (``max_by`` /
``min``) rather than a window sort, so a key holding a third of the rows is
reduced map-side before the shuffle instead of being sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lakeops.functions import exprs as X
from lakeops.plans.strategy import hot_keys, salted_join
from lakeops.session import shared_dir


_FIXED_WIDTH = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                T.DateType, T.TimestampType, T.TimestampNTZType)


def _key_cond(keys: Sequence[str]) -> Column:
    return F.lit(True) if not keys else F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))


# --- R1-R5 ---------------------------------------------------------------------

def lookup(df: DataFrame, **key) -> DataFrame:
    """Rows matching every ``column=value`` pair (R1).  Empty -> not found."""
    cond = F.lit(True)
    for k, v in key.items():
        cond = cond & (F.col(k) == F.lit(v))
    return df.filter(cond)


def lookup_keys(df: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """R1 for many keys at once: each row of ``keys`` with ``found`` and the columns of its row in ``df``."""
    return keys.join(df.withColumn("found", F.lit(True)), list(key), "left").withColumn(
        "found", F.coalesce("found", F.lit(False)))


class NotFound(LookupError):
    """No row matches the key (the registry's not-found outcome)."""


def get_one(df: DataFrame, **key):
    """The single row for a key, fetched as at most one row; ``NotFound`` when none.

    A point lookup for callers that need the row itself (as an API handler
    does); whole-table work uses :func:`lookup` and joins instead.
    """
    rows = lookup(df, **key).limit(1).take(1)
    if not rows:
        raise NotFound(", ".join(f"{k}={v!r}" for k, v in key.items()))
    return rows[0]


def exists(df: DataFrame) -> bool:
    """Cheap emptiness probe: reads at most one row."""
    return len(df.limit(1).take(1)) > 0


def list_ordered(df: DataFrame, order_by: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """All rows by creation time, id as tiebreak (R2)."""
    return df.orderBy(*order_by)


def list_active(df: DataFrame, order_by: Sequence[str] = ("path",)) -> DataFrame:
    """Rows that are not soft-deleted, ordered by path."""
    return df.filter(F.col("trashed_at").isNull()).orderBy(*order_by)


def list_revisions(revisions: DataFrame, notebook_id=None,
                   cols: Sequence[str] = ("notebook_id", "rev", "author"), order_col: str = "rev") -> DataFrame:
    """Revisions newest first, snapshot body left out.

    With ``notebook_id`` one notebook's list; without, every notebook's list
    in one pass (ordered by notebook, then newest first).
    """
    r = revisions if notebook_id is None else revisions.filter(F.col("notebook_id") == F.lit(notebook_id))
    return r.select(*cols).orderBy("notebook_id", F.col(order_col).desc())


def list_grants(grants: DataFrame, object_type: str | None = None, object_id: str | None = None) -> DataFrame:
    """Grants of an object by principal type then id (R5); all objects when not given."""
    g = grants
    if object_type is not None:
        g = g.filter((F.col("object_type") == object_type) & (F.col("object_id") == object_id))
    return g.orderBy("object_type", "object_id", "principal_type", "principal_id")


# --- W1 ------------------------------------------------------------------------

def tag_conflicts(base: DataFrame, new: DataFrame, unique_keys: Sequence[Sequence[str]],
                  order_col: str) -> DataFrame:
    """``new`` plus ``reason``: why a row may not be inserted, NULL when free.

    For each unique key (non-NULL), a row conflicts when an existing row has
    it (``exists:<key>``) or an earlier row of the batch by ``order_col``
    does (``duplicate:<key>``).  "Earlier" is found with a per-key ``min``
    aggregate joined back, not a window sort, so a hot key stays cheap.
    """
    tagged = new.withColumn("_reason", F.lit(None).cast("string"))
    for key in unique_keys:
        key = list(key)
        name = "+".join(key)
        taken = base.filter(_key_cond(key)).select(*key).distinct().withColumn("_hit", F.lit(True))
        first = new.filter(_key_cond(key)).groupBy(*key).agg(F.min(order_col).alias("_first"))
        hit = tagged.join(taken, key, "left").join(first, key, "left")
        dup = F.col("_first").isNotNull() & (F.col(order_col) > F.col("_first"))
        reason = (F.when(F.col("_reason").isNotNull(), F.col("_reason"))
                  .when(F.coalesce(F.col("_hit"), F.lit(False)), F.lit(f"exists:{name}"))
                  .when(dup, F.lit(f"duplicate:{name}")))
        tagged = hit.withColumn("_reason", reason).drop("_hit", "_first")
    return tagged.withColumnRenamed("_reason", "reason")


#: Rows of a component of conflicts that one task decides in order.
GROUP = 50_000


def tag_in_order(base: DataFrame, new: DataFrame, unique_keys: Sequence[Sequence[str]],
                 order_col: str) -> DataFrame:
    """As :func:`tag_conflicts`, but only rows that are accepted block later ones.

    ``order_col`` is orderable, not NULL and tells the rows apart.  Rows that share no key with another one are free.  Of the others,
    those that are first for all their keys are accepted and what shares a key with them is refused; then
    the connected components of what is left (rows that share keys, directly or through others) are found in
    rounds that grow with the logarithm of a component's length, and each component is decided in
    order by one task, all of them in parallel.  A component of more than ``GROUP`` rows goes through these steps again.
    """
    keys = [list(k) for k in unique_keys]
    open_ = new
    for key in keys:
        open_ = open_.join(base.filter(_key_cond(key)).select(*key).distinct(), key, "left_anti")
    names = [f"_k{i}" for i in range(len(keys))]
    # a key as one value, NULL where the row has none of that key
    values = [F.when(_key_cond(k), F.struct(*[F.col(c) for c in k])).alias(n) for k, n in zip(keys, names)]
    open_ = _pinned(open_.select(F.col(order_col).alias("_id"), *values), "insert")
    accepted = []
    while not open_.isEmpty():
        first = _pinned(_first_of_all(open_, names), "insert")
        accepted.append(first)
        for n in names:
            open_ = open_.join(first.filter(F.col(n).isNotNull()).select(n), n, "left_anti")
        open_ = open_.join(first.select("_id"), "_id", "left_anti").select("_id", *names)
        labelled = _components(_pinned(open_, "insert"), names)
        sized = labelled.join(labelled.groupBy("_f").agg(F.count(F.lit(1)).alias("_n")), "_f")
        open_ = _pinned(sized.filter(F.col("_n") > GROUP).select("_id", *names), "insert")
        accepted.append(_pinned(_decided(sized.filter(F.col("_n") <= GROUP).drop("_n"), names), "insert"))
    taken = reduce(DataFrame.unionByName, accepted) if accepted else open_
    return _reasons(base, new, keys, order_col, taken.select(F.col("_id").alias("_taken"), *names))


def _first_of_all(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows that are the first for each key they have."""
    out = rows
    for n in names:
        least = rows.filter(F.col(n).isNotNull()).groupBy(n).agg(F.min("_id").alias("_first"))
        out = out.join(least, n, "left").filter(F.col("_first").isNull() | (F.col("_first") == F.col("_id"))).drop("_first")
    return out.select("_id", *names)


def _components(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with ``_f``, the least ``_id`` of those that a row shares keys with, directly or through others.

    Every row points to a row of its component (itself at first).  In a round the row pointed at is pointed on to the
    least that any row with a common key points at, and every pointer then skips a step, so a chain
    halves; the rounds end when no pointer moves.
    """
    state = _pinned(rows.withColumn("_f", F.col("_id")), "insert")
    hot = {n: _pinned(hot_keys(rows.filter(F.col(n).isNotNull()).withColumn("_one", F.lit(1)), [n], "_one"), "insert") for n in names}
    while True:
        seen = state.withColumn("_g", F.col("_f"))
        for n in names:
            least = state.filter(F.col(n).isNotNull()).groupBy(n).agg(F.min("_f").alias("_least"))
            seen = salted_join(seen, least, [n], hot[n], F.col("_id")).withColumn("_g", F.least("_g", "_least")).drop("_least")
        seen = _pinned(seen.select("_id", *names, "_f", "_g"), "insert")
        if seen.filter(F.col("_g") < F.col("_f")).isEmpty():
            # all rows with a common key point at one row; where that points on, pointers skip until they do not move
            if seen.join(seen.select(F.col("_id").alias("_f"), F.col("_f").alias("_up")), "_f").filter(F.col("_up") != F.col("_f")).isEmpty():
                return state
        moves = seen.select(F.col("_f").alias("_id"), "_g").unionAll(seen.select("_id", "_g"))
        moved = moves.groupBy("_id").agg(F.min("_g").alias("_f"))
        up = moved.select(F.col("_id").alias("_f"), F.col("_f").alias("_up"))
        skipped = moved.join(up, "_f").select("_id", F.col("_up").alias("_f"))
        state = _pinned(rows.join(skipped, "_id").select("_id", *names, "_f"), "insert")


def _decided(labelled: DataFrame, names: list[str]) -> DataFrame:
    """The rows accepted when each component ``_f`` is gone through in order."""
    schema = labelled.select("_id", *names).schema

    def accept(rows: pd.DataFrame) -> pd.DataFrame:
        taken, keep = [set() for _ in names], []
        rows = rows.sort_values("_id")
        for values in zip(*(rows[f"{n}_h"] for n in names)):
            free = all(v is None or v not in t for v, t in zip(values, taken))
            keep.append(free)
            if free:
                for v, t in zip(values, taken):
                    t.add(v)
        return rows.loc[keep, ["_id"]]

    # the values themselves as text: equal exactly when the keys are
    texts = labelled.select("_id", "_f", *[F.when(F.col(n).isNotNull(), F.to_json(n)).alias(f"{n}_h") for n in names])
    kept = texts.groupBy("_f").applyInPandas(accept, T.StructType([schema["_id"]]))
    return labelled.select("_id", *names).join(kept, "_id", "left_semi")


def _reasons(base: DataFrame, new: DataFrame, keys: list[list[str]], order_col: str, taken: DataFrame) -> DataFrame:
    """``new`` with ``reason``: the first key that ``base`` has (exists) or an earlier accepted row (duplicate); NULL: accepted."""
    tagged = new.withColumn("reason", F.lit(None).cast("string"))
    for i, key in enumerate(keys):
        name = "+".join(key)
        old = base.filter(_key_cond(key)).select(*key).distinct().withColumn("_hit", F.lit(True))
        got = taken.filter(F.col(f"_k{i}").isNotNull()).select("_taken", f"_k{i}.*")
        hit = tagged.join(old, key, "left").join(got, key, "left")
        reason = (F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("_hit"), F.lit(f"exists:{name}"))
                  .when(F.col("_taken") < F.col(order_col), F.lit(f"duplicate:{name}")))
        tagged = hit.withColumn("reason", reason).drop("_hit", "_taken")
    return tagged


def insert_unique(base: DataFrame, new: DataFrame, unique_keys: Sequence[Sequence[str]],
                  order_col: str) -> tuple[DataFrame, DataFrame]:
    """Append rows of ``new`` whose unique keys are free.

    Returns ``(table, conflicts)``; NULL keys never conflict, as in SQL.  See
    :func:`tag_conflicts` for the rule.
    """
    tagged = (tag_conflicts if len(unique_keys) == 1 else tag_in_order)(base, new, unique_keys, order_col)
    ok = tagged.filter(F.col("reason").isNull()).drop("reason")
    bad = tagged.filter(F.col("reason").isNotNull())
    return base.unionByName(ok.select(*base.columns)), bad


# --- W2, W3 ----------------------------------------------------------------------

def update_by_key(base: DataFrame, changes: DataFrame, key: Sequence[str], at: Column | None = None,
                  updated_col: str = "updated_at", order_col: str | None = None,
                  clear_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Overlay the non-NULL columns of ``changes`` onto matching rows.

    ``clear_col`` names a column of ``changes`` with the list of columns that a change sets to NULL.

    Matching rows get ``updated_col = at``.  Returns ``(table, unknown)`` where
    ``unknown`` lists change keys with no row.  ``changes`` holds one row per
    key; with ``order_col`` several changes per key are first reduced to the
    latest (W3), so the join can never multiply base rows.
    """
    key = list(key)
    if order_col is not None:
        changes = upsert_latest(None, changes, key, order_col, keep_first=()).drop(order_col)
    cols = [c for c in changes.columns if c not in key and c in base.columns]
    ch = changes.select(*key, *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_matched"),
                        (F.coalesce(F.col(clear_col), F.array()) if clear_col else F.array().cast("array<string>"))
                        .alias("_clear"))
    if updated_col not in base.columns:
        base = base.withColumn(updated_col, F.lit(None).cast("timestamp_ntz"))
    j = base.join(ch, key, "left")
    out = []
    for c in base.columns:
        if c in cols:
            cleared = F.coalesce(F.array_contains("_clear", c), F.lit(False))
            out.append(F.when(~cleared, F.coalesce(F.col(f"_new_{c}"), F.col(c))).alias(c))
        elif c == updated_col and at is not None:
            out.append(F.when(F.col("_matched"), at).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    unknown = changes.join(base.select(*key), key, "left_anti")
    return j.select(*out), unknown


def upsert_latest(base: DataFrame | None, changes: DataFrame, keys: Sequence[str], order_col: str,
                  keep_first: Sequence[str] = ("created_at",)) -> DataFrame:
    """Last write wins on the unique ``keys``.

    Every non-key column comes from the row with the highest ``order_col``;
    the ``keep_first`` columns keep their earliest value (a grant's first
    ``created_at`` survives re-grants).  One hash aggregate: partial
    aggregation shrinks a hot key on the map side.
    """
    keys = list(keys)
    rows = changes if base is None else base.unionByName(changes, allowMissingColumns=True)
    first = [c for c in keep_first if c in rows.columns]
    rest = [c for c in rows.columns if c not in keys and c not in first]
    # a base row without a sequence number comes before every change
    order = F.col(order_col)
    if isinstance(rows.schema[order_col].dataType, T.IntegralType):
        order = F.coalesce(order.cast("long"), F.lit(-(1 << 63)))
    elif base is not None:
        order = F.struct(order.isNotNull(), order)
    if all(isinstance(rows.schema[c].dataType, _FIXED_WIDTH) for c in rest):
        # Fixed-width values: one max_by per column keeps every aggregation
        # buffer fixed-width, so the plan is a hash aggregate.  ``order_col``
        # is unique within a key (a sequence), so all columns come from the
        # same row.
        agg = rows.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in rest],
                                      *[F.min(c).alias(c) for c in first])
        return agg.select(*keys, *rest, *first)
    agg = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), order).alias("_latest"),
        *[F.min(c).alias(c) for c in first])
    return agg.select(*keys, *[F.col(f"_latest.{c}").alias(c) for c in rest], *first)


def live_changes(changes: DataFrame, keys: Sequence[str], order_col: str, gone: Column) -> DataFrame:
    """The changes that no later tombstone undoes: what a log of upserts and deletes leaves to upsert.

    ``gone`` says of a row that it deletes its key.  Of each key the rows after its last delete stay, so
    a key granted anew starts anew (its first ``created_at`` is that of the new grant), and a key
    whose last row is a delete is absent.  Rows without a number come before all others.
    """
    keys = list(keys)
    marked = changes.withColumn("_gone", F.coalesce(gone, F.lit(False)))
    ended = (marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col("_gone"), F.col(order_col))).alias("_ended")))
    rows = salted_join(marked.filter(~F.col("_gone")), ended.filter(F.col("_ended").isNotNull()).drop("_n"), keys,
                       hot_keys(ended, keys, "_n"), F.col(order_col))
    return rows.filter(F.col("_ended").isNull() | (F.col(order_col) > F.col("_ended"))).select(*changes.columns)


# --- W4-W7 -----------------------------------------------------------------------

def delete_by_key(base: DataFrame, keys_df: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Remove matching rows (W4).  Returns ``(table, unmatched_keys)``."""
    key = list(key)
    k = keys_df.select(*key)
    return base.join(k, key, "left_anti"), k.join(base.select(*key), key, "left_anti")


def soft_delete(base: DataFrame, keys_df: DataFrame, key: Sequence[str], at: Column,
                col: str = "trashed_at") -> tuple[DataFrame, DataFrame]:
    """Stamp ``trashed_at = at`` on matching rows (W5).  Returns ``(table, unmatched)``."""
    key = list(key)
    k = keys_df.select(*key).distinct().withColumn("_hit", F.lit(True))
    j = base.join(k, key, "left")
    out = [F.when(F.col("_hit"), at).otherwise(F.col(c)).alias(c) if c == col else F.col(c) for c in base.columns]
    unmatched = keys_df.select(*key).join(base.select(*key), key, "left_anti")
    return j.select(*out), unmatched


def cascade_delete(parent_kept: DataFrame, child: DataFrame, fk: str, pk: str) -> DataFrame:
    """Children whose parent still exists (W6: ON DELETE CASCADE)."""
    return child.join(parent_kept.select(F.col(pk).alias(fk)).distinct(), fk, "left_semi")


def set_null_fk(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Dangling references become NULL (W7: ON DELETE SET NULL)."""
    p = parent.select(F.col(pk).alias(fk)).distinct().withColumn("_ok", F.lit(True))
    j = child.join(p, fk, "left")
    return j.select(*[F.when(F.col("_ok"), F.col(c)).alias(c) if c == fk else F.col(c) for c in child.columns])


# --- W8-W12 -----------------------------------------------------------------------

def folder_closure(folders: DataFrame, id_col: str = "folder_id", parent_col: str = "parent_id") -> DataFrame:
    """(ancestor_id, folder_id, depth) for every folder and each ancestor.

    depth 0 is the folder itself.  Pointers double: with all ancestors up to distance
    2^k - 1 and each folder's ancestor at distance 2^k, one join gives those up to
    2^(k+1) - 1, so a tree of depth d takes log2(d) rounds, each written to the shared folder.
    The pointers (a row per folder at most) are made first; if some still lead on after as many steps as there are
    folders, the parents form a cycle, which raises ``ValueError`` with folders of it before any ancestor is written.
    """
    nodes = folders.select(F.col(id_col).alias("id"), F.col(parent_col).alias("up"))
    jumps = _jumps(nodes)
    outside = nodes.filter(F.col("up").isNotNull()).join(nodes.select(F.col("id").alias("up")), "up", "left_anti")
    known = nodes.select(F.col("id").alias("ancestor_id"), F.col("id").alias("folder_id"), F.lit(0).alias("depth"))
    for k, jump in enumerate(jumps):
        far = known.join(jump, F.col("ancestor_id") == F.col("id")).select(
            F.col("up").alias("ancestor_id"), "folder_id", (F.col("depth") + (1 << k)).alias("depth"))
        known = _pinned(known.unionAll(far), "closure")
    # a parent that is no folder itself is still an ancestor of its children's subtrees
    return known.unionAll(known.join(outside, F.col("ancestor_id") == F.col("id")).select(
        F.col("up").alias("ancestor_id"), "folder_id", (F.col("depth") + 1).alias("depth")))


#: Folders of a cycle that an error names.
NAMED = 20


def _jumps(nodes: DataFrame) -> list[DataFrame]:
    """Each folder's ancestor 1, 2, 4, ... steps up, as long as there is one; ``ValueError`` names folders of a cycle."""
    jump = _pinned(nodes.filter(F.col("up").isNotNull()).join(nodes.select(F.col("id").alias("up")), "up", "left_semi")
                   .select("id", "up").distinct(), "closure")
    jumps, left = [], jump.count()
    first = left
    while left:
        jumps.append(jump)
        if 1 << (len(jumps) - 1) > first:
            # more steps than folders: who is still pointed at lies on a cycle
            on = [r["up"] for r in jump.select("up").distinct().orderBy("up").limit(NAMED).collect()]
            raise ValueError(f"the folders' parents form a cycle: {on}")
        further = jump.select(F.col("id").alias("up"), F.col("up").alias("_far"))
        jump = _pinned(jump.join(further, "up").select("id", F.col("_far").alias("up")), "closure")
        left = jump.count()
    return jumps


def _pinned(df: DataFrame, name: str) -> DataFrame:
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cascade_delete_tree(nodes: DataFrame, deleted: DataFrame, id_col: str = "folder_id",
                        parent_col: str = "parent_id") -> DataFrame:
    """Nodes left after deleting ``deleted`` and all their descendants (W6 over W8).

    A folder goes when it or any ancestor is deleted.  Each round a folder takes over the verdict of
    the folder its pointer reaches and then points twice as far, so log2(depth) rounds of one row
    per folder do; folders under a cycle of parents are decided too.
    """
    drop = deleted.select(F.col(id_col).alias("id")).distinct().withColumn("_gone", F.lit(True))
    state = _pinned(nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("up")).distinct()
                    .join(drop, "id", "left").select("id", "up", F.coalesce("_gone", F.lit(False)).alias("gone")), "cascade")
    count, step = state.count(), 1
    while step <= 2 * count and not state.filter("up is not null and not gone").isEmpty():
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("gone").alias("_gone"))
        state = _pinned(state.join(above, "up", "left").select(
            "id", F.col("_up").alias("up"), (F.col("gone") | F.coalesce("_gone", F.lit(False))).alias("gone")), "cascade")
        step *= 2
    return nodes.join(state.filter("gone").select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti")


def unique_audit(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; NULL keys are exempt."""
    keys = list(keys)
    return (df.filter(_key_cond(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def orphan_audit(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose non-NULL reference has no parent."""
    return (child.filter(F.col(fk).isNotNull())
            .join(parent.select(F.col(pk).alias(fk)).distinct(), fk, "left_anti"))


def clone_rows(df: DataFrame, picks: DataFrame, key: str = "id", name_col: str = "name",
               cr_col: str = "cr_name") -> DataFrame:
    """Copies of picked rows under a new name.

    ``picks`` has ``key`` and ``new_name``; a blank new name (after trim)
    becomes ``<name>-clone``.  The copy gets a deterministic id and CR name
    derived from the source key and the new name.
    """
    j = df.join(picks.select(key, "new_name"), key)
    name = F.coalesce(F.nullif(X.js_trim(F.col("new_name")), F.lit("")), F.concat(F.col(name_col), F.lit(X.CLONE_SUFFIX)))
    seed = F.concat_ws("/", F.col(key).cast("string"), name)
    out = j.withColumns({name_col: name, cr_col: X.cr_name(name, seed), "source_id": F.col(key)})
    return out.drop("new_name")


def add_columns(df: DataFrame, defaults: dict) -> DataFrame:
    """Additive evolution: missing columns appear, NULLs take the default."""
    out = df
    for name, default in defaults.items():
        lit = default if isinstance(default, Column) else F.lit(default)
        if name in out.columns:
            out = out.withColumn(name, F.coalesce(F.col(name), lit))
        else:
            out = out.withColumn(name, lit)
    return out
