"""Versions of a data set in shared storage: data first, then one small file that makes them count.

A version is a folder ``_v=<number>`` with a single Parquet file, so Spark's commit (a rename of that file)
makes it appear at once or not at all.  Readers take the greatest number; the data that
a failed job wrote before it are never referred to.  Nothing is overwritten, so readers of an older
version go on undisturbed until it is expired.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def read_or_none(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The Parquet data under ``path``, or None if there is no such folder yet."""
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        return reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def newest(spark: SparkSession, path: str, schema: str) -> tuple[int, DataFrame] | None:
    """The greatest version under ``path`` and its rows, or None without any."""
    rows = read_or_none(spark, path, f"{schema}, _v long")
    top = rows.agg(F.max("_v")).first()[0] if rows is not None else None
    return None if top is None else (top, rows.filter(F.col("_v") == top).drop("_v"))


def add(rows: DataFrame, path: str, version: int) -> None:
    """Make ``rows`` (few: a list of places) the version ``version``; it must be a new number."""
    rows.coalesce(1).write.mode("error").parquet(f"{path}/_v={version}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file of the shared storage, if it is there."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
