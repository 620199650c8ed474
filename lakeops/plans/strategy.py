"""Join-strategy policy shared by the operators.

Broadcasting is only safe for a side whose size is proven.  Joins carry no broadcast
hint, but for the table of hot keys, which its definition bounds (:func:`hot_keys`).  Their size check is Spark's own: the static planner broadcasts only below
``spark.sql.autoBroadcastJoinThreshold`` (from file statistics), also for stream-static
joins, and in batch AQE re-plans from the *measured* shuffle output
(``spark.sql.adaptive.autoBroadcastJoinThreshold``), keeping the shuffle join beyond it and
splitting skewed partitions (``spark.sql.adaptive.skewJoin.enabled``).  Fixed configuration
(the permission ladder) is not joined at all but looked up in a literal map.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: A key with more than this share of all rows is hot, so there are at most ``1 / HOT_SHARE`` of them.
HOT_SHARE = 1 / 500
#: Parts a hot key is dealt to.
SALTS = 64


def materialize(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Cut lineage by writing ``df`` to shared storage and reading it back.

    Survives executor loss (the data lives in the shared folder, not on an
    executor) and pins nondeterministic columns (positions) so that every
    later use sees the same values.
    """
    df.write.mode("overwrite").format(fmt).save(path)
    return df.sparkSession.read.format(fmt).load(path)


def hot_keys(counted: DataFrame, keys: Sequence[str], n: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold more than ``share`` of the sum of ``n``: fewer than ``1 / share`` rows at any input size.

    ``counted`` may have several rows per key.
    """
    total = counted.agg(F.sum(n).alias("total")).scalar()
    return (counted.groupBy(*keys).agg(F.sum(n).alias("_n")).filter(F.col("_n") > total * F.lit(share))
            .select(*keys))


def salted_join(rows: DataFrame, unique: DataFrame, keys: Sequence[str], hot: DataFrame, spread: Column,
                how: str = "left") -> DataFrame:
    """``rows`` joined with ``unique`` (one row per ``keys``), rows of hot keys dealt to ``SALTS`` parts.

    ``hot`` (see :func:`hot_keys`) is on some or all of ``keys``; rows of its keys get a part by a hash
    of ``spread``, and the few rows of ``unique`` with such a key are copied to every part.  Unlike AQE's
    skew split this also holds where ``unique`` comes straight from an aggregate on the same keys.
    """
    on = hot.columns
    marked = F.broadcast(hot.select(*on, F.lit(True).alias("_hot")))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(marked, on, "left").withColumn("_part", part).drop("_hot")
    right = unique.join(marked, on, "left").withColumn("_part", F.explode(parts)).drop("_hot")
    return left.join(right, [*keys, "_part"], how).drop("_part")
