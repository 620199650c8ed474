"""Skew-proof positions equal their window-function form."""

from pyspark.sql import Window, functions as F

from lakeops.plans import ordered
from lakeops.session import shared_dir


def test_positions_hot_key_spread_over_partitions(spark):
    # key 0 holds most rows; the sort spreads it over all 8 partitions
    df = spark.range(0, 5000).select((F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 10)).alias("k"),
                                     (F.col("id") * 7919 % 5000).alias("v"), "id")
    got = ordered.positions(df, ["k"], [F.col("v").desc(), F.col("id")], shared_dir(spark, "test_positions"))
    w = Window.partitionBy("k").orderBy(F.col("v").desc(), "id")
    want = df.withColumn("position", F.row_number().over(w))
    assert got.select("k", "id", "position").exceptAll(want.select("k", "id", "position")).count() == 0
    assert got.count() == 5000


def test_neighbours_equal_the_plain_window(spark):
    # one key has 70 % of the rows, some numbers are tied or missing
    df = spark.range(0, 6000).select((F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 1009)).alias("k"),
                                     F.when(F.col("id") % 41 > 0, F.col("id") * 7919 % 1500).alias("v"), "id", F.lit(0).alias("older_than"))
    got = ordered.neighbours(df, "k", "v", "id", shared_dir(spark, "test_neighbours"))
    w = Window.partitionBy("k").orderBy(F.col("v").desc_nulls_last(), F.col("id").desc())
    want = df.withColumn("position", F.row_number().over(w)).withColumn("older", F.lead("v").over(w))
    cols = ["k", "id", "v", "position", "older"]
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0 and got.count() == 6000
    assert got.columns == [*df.columns, "position", "older"]
    assert ordered.neighbours(df.limit(0), "k", "v", "id", shared_dir(spark, "test_neighbours")).count() == 0


def test_neighbours_cut_a_hot_key_without_a_self_join(spark):
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(old, ("false", "-1")):
            spark.conf.set(k, v)
        df = spark.range(0, 20000).select(F.lit(1).alias("k"), F.col("id").alias("v"), "id")
        got = ordered.neighbours(df, "k", "v", "id", shared_dir(spark, "test_neighbours"))
        per = got.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in per) < 20000 * 0.4
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
