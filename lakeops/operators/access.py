"""Access evaluation over whole grant tables and request logs.

J2 membership, A1 effective_level, A2 authorize, A3 validate_grants,
A5 read_attribution, A7 access_matrix, J3 authorized_view.

Plan shape (A1/A2): the requests are first reduced to their distinct (username, object) pairs.  Each
pair is expanded into the principal keys it can be matched by -- its own user
key plus one key per directory group -- and joined on the full grant key
``(object_type, object_id, principal_type, principal_id)``.  A current grant
table is unique on that key, so every expanded pair meets at most one grant:
the join never multiplies rows.  The best rank per pair is one hash aggregate
of pairs, and the requests take it over by a join on the pair.  An object that holds
more than 1/500 of the pairs, and a pair that holds more than 1/500 of the requests, are dealt to several
parts (``plans.strategy.salted_join``), since the other side of each join is an aggregate
on the join's own keys, whose partitions AQE does not split.

The permission ladders are a fixed, nine-entry configuration, so level ranks
are literal map lookups inside the projections (no join at all).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakeops.fixtures import LADDERS
from lakeops.plans.strategy import hot_keys, salted_join

GRANT_KEY = ["object_type", "object_id", "principal_type", "principal_id"]
PRINCIPAL_TYPES = ("user", "group")
Ladders = dict[str, list[str]]
_SEP = "\u001f"


def ladders_frame(spark: SparkSession, ladders: Ladders = LADDERS) -> DataFrame:
    """(object_type, level, rnk, top_rnk) for every ladder level; rnk 0 is the lowest."""
    rows = ", ".join(f"('{t}', '{lvl}', {i}, {len(levels) - 1})"
                     for t, levels in ladders.items() for i, lvl in enumerate(levels))
    return spark.sql(f"SELECT object_type, level, CAST(rnk AS INT) AS rnk, CAST(top_rnk AS INT) AS top_rnk "
                     f"FROM VALUES {rows} AS t(object_type, level, rnk, top_rnk)")


def _lit_map(pairs: list[tuple[str, object]]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def level_rank(object_type: Column, level: Column, ladders: Ladders = LADDERS) -> Column:
    """Rank of ``level`` on the object type's ladder; NULL when unknown."""
    m = _lit_map([(f"{t}{_SEP}{lvl}", i) for t, levels in ladders.items() for i, lvl in enumerate(levels)])
    return F.try_element_at(m, F.concat_ws(_SEP, object_type, level))


def top_rank(object_type: Column, ladders: Ladders = LADDERS) -> Column:
    """Highest rank of the object type's ladder (the owner/admin level)."""
    return F.try_element_at(_lit_map([(t, len(levels) - 1) for t, levels in ladders.items()]), object_type)


def rank_level(object_type: Column, rnk: Column, ladders: Ladders = LADDERS) -> Column:
    """Level name of a rank; NULL for no access."""
    m = _lit_map([(f"{t}{_SEP}{i}", lvl) for t, levels in ladders.items() for i, lvl in enumerate(levels)])
    return F.try_element_at(m, F.concat_ws(_SEP, object_type, rnk.cast("string")))


def validate_grants(grants: DataFrame, ladders: Ladders = LADDERS) -> DataFrame:
    """Grants with ``rnk`` and a ``reason`` (NULL when valid) column (A3).

    principal_type must be user or group, principal_id non-empty, and the level
    must be on the object type's ladder.
    """
    g = grants.withColumn("rnk", level_rank(F.col("object_type"), F.col("level"), ladders))
    reason = (F.when(~F.coalesce(F.col("principal_type").isin(*PRINCIPAL_TYPES), F.lit(False)), "bad_principal_type")
              .when(F.coalesce(F.col("principal_id"), F.lit("")) == "", "missing_principal_id")
              .when(F.col("rnk").isNull(), "bad_level"))
    return g.withColumn("reason", reason)


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) halves of :func:`validate_grants` output."""
    return checked.filter(F.col("reason").isNull()), checked.filter(F.col("reason").isNotNull())


def membership(principals: DataFrame) -> DataFrame:
    """(username, principal_type, principal_id) keys each principal matches.

    ``principals`` has ``username`` and an array ``groups``.
    """
    user = principals.select("username", F.lit("user").alias("principal_type"),
                             F.col("username").alias("principal_id"))
    grp = principals.select("username", F.lit("group").alias("principal_type"),
                            F.explode(F.array_distinct("groups")).alias("principal_id"))
    return user.unionByName(grp)


PAIR = ["username", "object_type", "object_id"]


def _best_per_pair(counted: DataFrame, principals: DataFrame, grants_ranked: DataFrame) -> DataFrame:
    """PAIR, ``admin`` and ``best_rnk`` of the pairs that have either.

    ``counted`` has one row per pair; ``grants_ranked`` has the grant key and ``rnk``.
    """
    p = principals.select("username", F.coalesce("admin", F.lit(False)).alias("admin"), F.col("groups").alias("_groups"))
    keys = F.concat(
        F.array(F.struct(F.lit("user").alias("principal_type"), F.col("username").alias("principal_id"))),
        F.transform(F.array_distinct(F.coalesce(F.col("_groups"), F.array().cast("array<string>"))),
                    lambda g: F.struct(F.lit("group").alias("principal_type"), g.alias("principal_id"))))
    exp = counted.join(p, "username", "left").select(
        *PAIR, F.coalesce("admin", F.lit(False)).alias("admin"), F.inline(keys))
    # The grant table grows with the data: the planner sizes this join.
    g = grants_ranked.select(*GRANT_KEY, F.col("rnk").alias("_rnk"))
    objects = hot_keys(counted.withColumn("_one", F.lit(1)), ["object_type", "object_id"], "_one")
    joined = salted_join(exp, g, GRANT_KEY, objects, F.col("username"))
    # ``admin`` belongs to the pair's user, so grouping by it as well keeps the buffer fixed-width.
    best = joined.groupBy(*PAIR, "admin").agg(F.max("_rnk").alias("best_rnk"))
    return best.filter(F.col("admin") | F.col("best_rnk").isNotNull())


def _with_best_rank(rows: DataFrame, id_cols: list[str], principals: DataFrame,
                    grants_ranked: DataFrame) -> DataFrame:
    """``rows`` plus ``admin`` and ``best_rnk`` (highest matching grant rank).

    ``rows`` needs username, object_type and object_id, and ``id_cols`` that tell its rows apart.  Rows that
    are told apart by the pair and its owner alone cannot be many per pair.
    """
    counted = rows.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_requests"))
    best = _best_per_pair(counted.select(*PAIR), principals, grants_ranked)
    if set(id_cols) <= {*PAIR, "owner"}:
        out = rows.join(best, PAIR, "left")
    else:
        out = salted_join(rows, best, PAIR, hot_keys(counted, PAIR, "_requests"), F.struct(*id_cols))
    return out.withColumn("admin", F.coalesce(F.col("admin"), F.lit(False)))


def current_grants(grants_log: DataFrame, ladders: Ladders = LADDERS, order_col: str = "grant_seq",
                   revoked: Column | None = None, base: DataFrame | None = None) -> DataFrame:
    """Validated grant log reduced to the latest level per grant key (A3 then W3).

    ``revoked`` says of a row of the log that it takes its key's grant away (its level does not matter); a key
    granted again later is there with that grant alone.  ``base`` is a current grant table to go on from.
    """
    from lakeops.operators.registry import live_changes, upsert_latest
    gone = F.lit(False) if revoked is None else F.coalesce(revoked, F.lit(False))
    checked = validate_grants(grants_log.withColumn("_revoked", gone), ladders)
    valid = checked.filter(F.col("reason").isNull() | (F.col("_revoked") & (F.col("reason") == "bad_level")))
    # The level travels as its rank (an int) so the reduction is a hash
    # aggregate; the name is restored from the ladder afterwards.
    log = valid.drop("level", "reason")
    if base is not None:
        start = base.withColumn("rnk", level_rank(F.col("object_type"), F.col("level"), ladders)).drop("level")
        log = start.withColumn("_revoked", F.lit(False)).unionByName(log, allowMissingColumns=True)
    if revoked is not None:
        log = live_changes(log, GRANT_KEY, order_col, F.col("_revoked"))
    cur = upsert_latest(None, log.drop("_revoked"), GRANT_KEY, order_col)
    return cur.withColumn("level", rank_level(F.col("object_type"), F.col("rnk"), ladders)).drop("rnk")


def effective_rank(rows: DataFrame, id_cols: list[str], principals: DataFrame, grants: DataFrame,
                   ladders: Ladders = LADDERS) -> DataFrame:
    """``rows`` plus ``eff_rnk``: admin or owner -> top rank, else best grant (A1).

    Blank owner never matches; unknown levels are ignored; no grant -> NULL.
    ``grants`` is a current grant table with ``level`` (ranked here).
    """
    ranked = (grants.withColumn("rnk", level_rank(F.col("object_type"), F.col("level"), ladders))
              .filter(F.col("rnk").isNotNull()))
    best = _with_best_rank(rows, id_cols, principals, ranked)
    owner = F.coalesce((F.col("owner") != "") & (F.col("owner") == F.col("username")), F.lit(False))
    eff = F.when(F.col("admin") | owner, top_rank(F.col("object_type"), ladders)).otherwise(F.col("best_rnk"))
    return best.withColumn("eff_rnk", eff)


def effective_level(pairs: DataFrame, principals: DataFrame, grants: DataFrame,
                    ladders: Ladders = LADDERS) -> DataFrame:
    """(username, object_type, object_id, owner, level) -- highest level held (A1).

    ``level`` is NULL when the principal has no access.
    """
    ids = ["username", "object_type", "object_id", "owner"]
    e = effective_rank(pairs.select(*ids).distinct(), ids, principals, grants, ladders)
    return e.select(*ids, rank_level(F.col("object_type"), F.col("eff_rnk"), ladders).alias("level"))


def authorize(requests: DataFrame, principals: DataFrame, grants: DataFrame, ladders: Ladders = LADDERS,
              id_col: str = "request_id") -> DataFrame:
    """Requests plus ``allowed`` (A2).

    Allowed iff rank(effective) >= rank(required).  An unknown required level
    denies, even for admins; a principal missing from the directory has no
    groups and no admin flag, so only its own user grants or ownership count.
    """
    e = effective_rank(requests, [id_col], principals, grants, ladders)
    want = level_rank(F.col("object_type"), F.col("required"), ladders)
    allowed = F.coalesce(want.isNotNull() & (F.col("eff_rnk") >= want), F.lit(False))
    return e.withColumn("allowed", allowed).drop("best_rnk")


def authorized_view(objects: DataFrame, principals: DataFrame, grants: DataFrame, ladders: Ladders = LADDERS,
                    min_rank: int = 0) -> DataFrame:
    """Rows of ``objects`` the caller holds at least ``min_rank`` on.

    ``objects`` has username, object_type, object_id, owner.  Implemented as a
    semi join against the effective ranks, so no per-row permission lookup.
    """
    ids = ["username", "object_type", "object_id", "owner"]
    e = effective_rank(objects.select(*ids).distinct(), ids, principals, grants, ladders)
    ok = e.filter(F.col("eff_rnk") >= min_rank).select(*[F.col(c).alias(f"_{c}") for c in ids])
    # a row without an owner is a row like any other
    same = reduce(lambda a, b: a & b, [objects[c].eqNullSafe(ok[f"_{c}"]) for c in ids])
    return objects.join(ok, same, "left_semi")


def read_attribution(log: DataFrame, service_user: str, user_col: str = "username") -> DataFrame:
    """Reads per user; a missing or empty caller is the service user (A5), a name of white space is a name."""
    who = F.coalesce(F.nullif(F.col(user_col), F.lit("")), F.lit(service_user))
    return log.groupBy(who.alias("reader")).agg(F.count(F.lit(1)).alias("reads"))


def access_matrix(decisions: DataFrame) -> DataFrame:
    """Allowed / total counts per object type x required level, with subtotals."""
    return (decisions.rollup("object_type", "required")
            .agg(F.sum(F.col("allowed").cast("long")).alias("allowed"),
                 F.count(F.lit(1)).alias("total")))


def access_report(requests: DataFrame, principals: DataFrame, grants: DataFrame, path: str,
                  ladders: Ladders = LADDERS) -> dict[str, DataFrame]:
    """Decisions plus the views built on them, computed once.

    The decisions are written to ``path`` (shared storage) in one job and the
    matrix and allow/deny summary read that table, so several views of one
    access log never re-run the evaluation, and a lost executor does not
    lose the shared intermediate.
    """
    from lakeops.plans.strategy import materialize
    decided = materialize(authorize(requests, principals, grants, ladders), path)
    return {
        "decisions": decided,
        "matrix": access_matrix(decided),
        "summary": decided.groupBy("allowed").agg(F.count(F.lit(1)).alias("requests")),
    }
