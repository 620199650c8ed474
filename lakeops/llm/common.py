"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.session import shared_dir

#: The white space that separates words everywhere here: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text: maximal runs outside ``SPACES``; null and blank texts have none."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPLIT))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def pin(df: DataFrame, *name: str) -> DataFrame:
    """Write ``df`` to the shared folder of the session and read it back.

    Cuts the lineage and fixes a result that several later jobs read, in storage
    that outlives any executor.
    """
    path = shared_dir(df.sparkSession, *name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_system(path: str):
    """pyarrow's file system and the folder in it, for a task that reads or writes files of the shared folder itself."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
