"""Table DDL, writes, reads, sampling and write verification.

Tables are Parquet (no Iceberg/Delta jar is assumed); ``fmt`` is a parameter
so the same calls drive a lakehouse format where one is installed.  Paths
used by jobs live under the cluster's shared checkpoint folder
(``lakeops.session.shared_dir``), never a machine-local temp folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lakeops.functions import exprs as X
from lakeops.session import shared_dir

# Fixed value: rows a sample returns when no usable size is given.
DEFAULT_SAMPLE_ROWS = 100


def create_namespace(spark: SparkSession, ns: str) -> None:
    """Idempotent ``CREATE NAMESPACE``."""
    ident = ".".join(X.quote_ident(p) for p in ns.split("."))
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {ident}")


def create_table(spark: SparkSession, name: str, schema: T.StructType, partition_by: Sequence[str] = (),
                 fmt: str = "parquet", location: str | None = None) -> None:
    """Idempotent table creation with an explicit schema.

    The caller's schema is honoured.  Parquet tables report every column as
    nullable, so required (non-nullable) fields are also marked in the field
    metadata (``lakeops.required``), which the table keeps; see
    :func:`required_columns` and :func:`null_violations`.
    """
    empty = spark.createDataFrame([], mark_required(schema))
    w = empty.write.format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if location:
        w = w.option("path", location)
    try:
        w.mode("ignore").saveAsTable(name)
    except AnalysisException as e:   # another session made it meanwhile
        if e.getCondition() != "TABLE_OR_VIEW_ALREADY_EXISTS":
            raise


REQUIRED_KEY = "lakeops.required"


def mark_required(schema: T.StructType) -> T.StructType:
    """The schema with each non-nullable field flagged in its metadata."""
    return T.StructType([
        T.StructField(f.name, f.dataType, f.nullable,
                      {**(f.metadata or {}), REQUIRED_KEY: True} if not f.nullable else f.metadata)
        for f in schema.fields])


def required_columns(schema: T.StructType) -> list[str]:
    """Fields declared required: non-nullable, or flagged in metadata."""
    return [f.name for f in schema.fields if not f.nullable or (f.metadata or {}).get(REQUIRED_KEY)]


def null_violations(df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """(column, nulls) for every required column that holds NULLs.

    ``schema`` defaults to the table's own schema (with its metadata flags).
    One pass with a ``count_if`` per required column.
    """
    req = required_columns(schema if schema is not None else df.schema)
    if not req:
        return df.sparkSession.createDataFrame([], "column string, nulls long")
    counts = df.select([F.count_if(F.col(c).isNull()).alias(c) for c in req])
    stack = ", ".join(f"'{c}', `{c}`" for c in req)
    return counts.selectExpr(f"stack({len(req)}, {stack}) AS (column, nulls)").filter("nulls > 0")


def rows_to_view(spark: SparkSession, rows: list, schema: T.StructType | str, view: str) -> DataFrame:
    """Typed literal rows as a temp view (T3); for small, fixed inputs."""
    df = spark.createDataFrame(rows, schema)
    df.createOrReplaceTempView(view)
    return df


def replace_rows(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Replace the files under a path by ``df`` (T4).

    Spark deletes the old files before it writes; :func:`replace_table` keeps them until the new ones are complete.
    """
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_keyed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, fmt: str = "parquet",
                location: str | None = None) -> None:
    """Replace a catalog table, bucketed and sorted on its key.

    Registry tables are joined on their keys again and again (updates,
    upserts, deletes, audits).  Writing both sides bucketed by the same key
    into the same number of buckets lets those joins and per-key aggregates
    run without a shuffle (``spark.sql.sources.bucketing.enabled``).
    """
    w = df.write.mode("overwrite").format(fmt).bucketBy(buckets, *keys).sortBy(*keys)
    if location:
        w = w.option("path", location)
    w.saveAsTable(table)


def append_rows(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Insert by column name (T5): columns are matched to the table's order."""
    spark = df.sparkSession
    target = spark.read.format(fmt).load(path).columns
    df.select(*target).write.mode("append").format(fmt).save(path)


def _quoted(name: str) -> str:
    return ".".join(X.quote_ident(p) for p in name.split("."))


def _by_name(df: DataFrame, name: str) -> DataFrame:
    """``df`` in the table's column order and types; missing or unknown columns and NULLs in required ones raise ``ValueError``."""
    target = df.sparkSession.table(name).schema
    missing = [f.name for f in target.fields if f.name not in df.columns]
    unknown = [c for c in df.columns if c not in target.names]
    if missing or unknown:
        raise ValueError(f"{name}: missing columns {missing}, unknown columns {unknown}")
    return df.select(*[F.col(X.quote_ident(f.name)).cast(f.dataType).alias(f.name) for f in target.fields])


def _stage(df: DataFrame, name: str, place: str, fmt: str, partition_by: Sequence[str]) -> None:
    """Write the rows where no reader looks yet, and check them there."""
    spark = df.sparkSession
    schema = spark.table(name).schema
    w = _by_name(df, name).write.format(fmt)
    (w.partitionBy(*partition_by) if partition_by else w).save(place)
    bad = [(r["column"], r["nulls"]) for r in null_violations(spark.read.schema(schema).format(fmt).load(place), schema).collect()]
    if bad:
        raise ValueError(f"{name}: NULLs in required columns {bad}")


VERSIONS = "_versions"


def replace_table(df: DataFrame, name: str) -> str:
    """Replace all rows of the catalog table ``name`` (T4); returns the folder that the new rows were written to.

    The new rows are written beside the table, by column name and with its types, and checked; then the table's
    location is set to them, which is one change in the catalog.  A job that fails before it
    leaves the table as it was, and readers that began earlier keep their files.  Of a partitioned
    table, whose partitions have places of their own in the catalog, the checked rows are inserted with a
    dynamic overwrite, which moves complete partitions in when it commits; partitions without new rows
    are dropped after that.
    """
    spark = df.sparkSession
    about = describe(spark, name)
    home = about["location"].split(f"/{VERSIONS}/")[0].rstrip("/")
    place = f"{home}/{VERSIONS}/{uuid.uuid4().hex}"
    by = about["partitions"]
    if by:
        place = shared_dir(spark, "replace")
    _stage(df, name, place, about["provider"], ())
    if not by:
        spark.sql(f"ALTER TABLE {_quoted(name)} SET LOCATION '{place}'")
    else:
        staged = spark.read.schema(spark.table(name).schema).format(about["provider"]).load(place)
        old = spark.table(name).select(*by).distinct()
        same = reduce(lambda a, b: a & b, [old[c].eqNullSafe(staged[c]) for c in by])
        stale = old.join(staged.select(*by), same, "left_anti").collect()   # partitions, as the catalog lists them
        staged.write.option("partitionOverwriteMode", "dynamic").insertInto(name, overwrite=True)
        for row in stale:
            spec = ", ".join(f"{X.quote_ident(c)} = {_partition_value(row[c])}" for c in by)
            spark.sql(f"ALTER TABLE {_quoted(name)} DROP IF EXISTS PARTITION ({spec})")
    spark.catalog.refreshTable(name)
    return place


def _partition_value(value) -> str:
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return "null" if value is None else f"'{text}'"


def append_table(df: DataFrame, name: str) -> None:
    """Insert by column name into the catalog table ``name`` (T5).

    The rows are checked in a folder of their own first; the insert itself shows its files when the job commits.
    """
    spark = df.sparkSession
    about = describe(spark, name)
    place = shared_dir(spark, "append")
    _stage(df, name, place, about["provider"], ())
    staged = spark.read.schema(spark.table(name).schema).format(about["provider"]).load(place)
    view = f"lakeops_rows_{uuid.uuid4().hex[:12]}"
    staged.createOrReplaceTempView(view)
    try:
        spark.sql(f"INSERT INTO {_quoted(name)} BY NAME SELECT * FROM {view}")
    finally:
        spark.catalog.dropTempView(view)
    spark.catalog.refreshTable(name)


def describe(spark: SparkSession, name: str) -> dict:
    """location, provider and partition columns of a catalog table."""
    doc = json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {_quoted(name)} AS JSON").first()[0])
    return {"location": doc["location"], "provider": doc["provider"], "partitions": doc.get("partition_columns") or []}


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A fresh reader over a table path (no cached plan from the writer)."""
    return spark.read.format(fmt).load(path)


def named_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table by a caller-supplied name, bound as a parameter.

    ``IDENTIFIER(:name)`` keeps the name out of the SQL text, so a name with
    quotes or dots cannot change the statement.
    """
    return spark.sql("SELECT * FROM IDENTIFIER(:name)", args={"name": name})


def scan_ordered(df: DataFrame, cols: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Project then order the whole table (T6); the projection prunes the scan."""
    return df.select(*cols).orderBy(*order_by)


def sample_size(n) -> int:
    """Requested sample size: missing, unparsable or <= 0 -> 100; no upper cap."""
    try:
        v = int(str(n).strip())
    except (TypeError, ValueError):
        return DEFAULT_SAMPLE_ROWS
    return v if v > 0 else DEFAULT_SAMPLE_ROWS


def table_sample(df: DataFrame, n=DEFAULT_SAMPLE_ROWS, order_by: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows (T7/O1); columns survive when there are no rows.

    With ``order_by`` it plans as TakeOrderedAndProject (a per-task top-n then
    a final merge), so no full sort of the table happens.
    """
    k = sample_size(n)
    return (df.orderBy(*order_by) if order_by else df).limit(k)


def normalize_times(df: DataFrame) -> DataFrame:
    """Timestamps rendered as 'yyyy-MM-dd HH:mm:ss' text (S8) for comparison."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(X.ts_text(F.col(f"`{f.name}`")).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def verify_rows(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Differences between two tables after timestamp normalisation.

    Returns rows with ``side`` = ``missing`` (expected, not found) or
    ``unexpected`` (found, not expected); empty means the write verified.
    Multiset semantics in one shuffle: rows count +1 when expected and -1 when
    found, and what does not add up to zero differs that many times.
    """
    a = normalize_times(actual)
    e = normalize_times(expected).select(*a.columns)
    both = e.withColumn("_n", F.lit(1)).unionByName(a.withColumn("_n", F.lit(-1)))
    off = both.groupBy(*[F.col(f"`{c}`") for c in a.columns]).agg(F.sum("_n").alias("_n")).filter(F.col("_n") != 0)
    side = F.when(F.col("_n") > 0, F.lit("missing")).otherwise(F.lit("unexpected"))
    each = off.withColumn("side", side).withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_n"))))
    return each.drop("_n")


def roundtrip(df: DataFrame, path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Write ``df``, read it back with an independent reader, verify.

    Returns ``(read_back, differences)``.
    """
    replace_rows(df, path, fmt)
    back = read_table(df.sparkSession, path, fmt)
    return back, verify_rows(back, df)
