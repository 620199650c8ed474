"""Large keyed tables in parts, of which an upsert rewrites only those it touches.

Rows are dealt to parts by a hash of their key.  A version of the table (``sources.versions``) lists the
folder of each part; an upsert reads the parts that its changes fall into, writes them anew and
commits a list that points to the new folders for these and to the old ones for all others.  A job that fails
leaves the old list; two writers of the same next version cannot both succeed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakeops.operators.registry import live_changes, upsert_latest
from lakeops.session import shared_dir
from lakeops.sources import versions

PART = "_part"
_PLACES = "part int, place string"
#: Tasks that write one part, so that the size of a part does not bound the parallelism.
WRITERS = 4


def part_of(keys: Sequence[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def _write(rows: DataFrame, keys: Sequence[str], parts: int) -> DataFrame:
    """Write ``rows`` by part into a new folder; returns (part, place) of the parts that have rows."""
    spark = rows.sparkSession
    place = shared_dir(spark, "parts")
    dealt = rows.withColumn(PART, part_of(keys, parts))
    writer = F.pmod(F.hash(*keys), F.lit(WRITERS))
    dealt.repartition(F.col(PART), writer).write.partitionBy(PART).parquet(place)
    there = spark.read.parquet(place).select(F.col(PART).alias("part")).distinct() if not rows.isEmpty() else spark.createDataFrame([], "part int")
    return there.withColumn("place", F.concat(F.lit(f"{place}/{PART}="), F.col("part").cast("string")))


def create(rows: DataFrame, path: str, keys: Sequence[str], parts: int) -> None:
    """The first version of a table at ``path``; ``rows`` has one row per key."""
    versions.add(_write(rows, keys, parts), path, 0)


def read(spark: SparkSession, path: str, schema, only: Sequence[int] | None = None) -> DataFrame:
    """The table (``schema``) as its newest version has it, or ``only`` some of its parts."""
    _, places = versions.newest(spark, path, _PLACES)
    chosen = places if only is None else places.filter(F.col("part").isin(list(only)))
    folders = [r["place"] for r in chosen.orderBy("part").collect()]   # one per part
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert(changes: DataFrame, path: str, schema, keys: Sequence[str], parts: int, order_col: str,
           gone: Column | None = None, keep_first: Sequence[str] = ("created_at",)) -> list[int]:
    """Upsert ``changes`` (``gone`` marks deletes) into the table; returns the parts that were rewritten."""
    spark = changes.sparkSession
    version, places = versions.newest(spark, path, _PLACES)
    touched = sorted(r[0] for r in changes.select(part_of(keys, parts)).distinct().collect())   # at most ``parts``
    mark = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
    rows = read(spark, path, schema, touched).withColumn("_gone", F.lit(False)).unionByName(
        changes.withColumn("_gone", mark), allowMissingColumns=True)
    if gone is not None:
        rows = live_changes(rows, keys, order_col, F.col("_gone"))
    cols = spark.createDataFrame([], schema).columns
    new = _write(upsert_latest(None, rows.drop("_gone"), keys, order_col, keep_first).select(*cols), keys, parts)
    versions.add(places.filter(~F.col("part").isin(touched)).unionByName(new), path, version + 1)
    return touched
