"""Positions within a key that stay parallel inside a hot key.

A window ``partitionBy(key)`` sends every row of a key to one task; when one
key holds a third of the data, that task holds a third of the data.
``positions`` computes the same ``row_number`` from bounded pieces: a global
sort (range partitioning splits a hot key across many tasks), positions
pinned by writing the sorted rows to shared storage, then per-(key, piece)
counts turned into offsets.  Only the small table of piece counts is
windowed per key.

``neighbours`` needs no such write: only keys that hold more than 1/500 of the rows are cut, at
quantiles of the ordering number, and the pieces meet through one boundary row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakeops.plans.strategy import hot_keys, materialize

_IDX_BITS = 33   # monotonically_increasing_id: partition id above, row index below


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], path: str,
              name: str = "position") -> DataFrame:
    """``df`` plus a 1-based ``name`` column: rank of each row within its key.

    ``order`` must be a total order within a key (add a unique tiebreak).
    ``path`` is a shared-storage location for the sorted rows.
    """
    keys = list(keys)
    ordered = df.orderBy(*[F.col(k) for k in keys], *order)
    tagged = ordered.withColumn("_mid", F.monotonically_increasing_id())
    pinned = materialize(tagged, path)
    pinned = (pinned.withColumn("_part", F.shiftrightunsigned("_mid", _IDX_BITS))
              .withColumn("_idx", F.col("_mid").bitwiseAND(F.lit((1 << _IDX_BITS) - 1))))
    pieces = pinned.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_idx").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    out = pinned.join(pieces.select(*keys, "_part", "_off", "_first"), [*keys, "_part"])
    return (out.withColumn(name, F.col("_off") + F.col("_idx") - F.col("_first") + 1)
            .drop("_mid", "_part", "_idx", "_off", "_first"))


#: Pieces that a hot key is cut into.
PIECES = 64


def neighbours(df: DataFrame, key: str, number: str, tiebreak: str, path: str, position: str = "position",
               older: str = "older") -> DataFrame:
    """``df`` plus ``position`` (1 = the greatest ``number``, ties by ``tiebreak``) and ``older``, the next row's ``number``.

    ``number`` and ``tiebreak`` are numeric, NULLs last.  A hot key's rows are cut into pieces at the quantiles of ``number``
    (rows of one number stay together); the cuts are pinned at ``path``, since quantiles are estimates.  One window per
    (key, piece) gives a row its place and neighbour within the piece; the pieces of the hot keys (their sizes
    and first numbers: at most ``PIECES`` rows for each of fewer than 500 keys) give what comes before
    and after a piece.  One shuffle of the rows, no join of the rows with themselves.
    """
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = hot_keys(counted, [key], "_n")
    quantiles = F.array(*[F.lit(i / PIECES) for i in range(1, PIECES)])
    cuts = materialize(df.join(F.broadcast(hot), key, "left_semi").groupBy(key).agg(
        F.array_distinct(F.percentile_approx(number, quantiles)).alias("_cuts")), path)
    # rows above all cuts are in piece 0; NULLs, the last ones, in the last piece
    piece = F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(F.coalesce(
        F.size(F.filter("_cuts", lambda c: c > F.col(number))), F.lit(0)) + F.when(F.col(number).isNull(), F.lit(PIECES)).otherwise(F.lit(0)))
    cut = df.join(F.broadcast(cuts), key, "left").withColumn("_piece", piece).withColumn("_hot", F.col("_cuts").isNotNull()).drop("_cuts")
    w = Window.partitionBy(key, "_piece").orderBy(F.col(number).desc_nulls_last(), F.col(tiebreak).desc())
    local = cut.withColumn("_row", F.row_number().over(w)).withColumn("_older", F.lead(number).over(w)).withColumn(
        "_last", F.lead(F.lit(True)).over(w).isNull())
    pieces = cut.filter("_hot").groupBy(key, "_piece").agg(F.count(F.lit(1)).alias("_n"), F.max(number).alias("_first"))
    by = Window.partitionBy(key).orderBy("_piece")
    pieces = pieces.select(key, "_piece", (F.sum("_n").over(by) - F.col("_n")).alias("_before"), F.lead("_first").over(by).alias("_next"))
    out = local.join(F.broadcast(pieces), [key, "_piece"], "left")
    return (out.withColumn(position, F.col("_row") + F.coalesce("_before", F.lit(0)))
            .withColumn(older, F.when(F.col("_last"), F.col("_next")).otherwise(F.col("_older")))
            .select(*df.columns, position, older))
