"""Catalog browsing: catalogs, namespaces, tables, metadata documents (M1-M9).

Live catalog listings come from Spark's own catalog commands.  Table metadata
documents (one JSON document per table, as a REST catalog returns them) are
parsed with ``from_json`` and an explicit schema, so a directory of metadata
files is read and flattened in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lakeops.functions import exprs as X

# Text of a missing time or operation, and the time format.
NO_VALUE = "—"
HISTORY_TS_FORMAT = "yyyy-MM-dd HH:mm:ss"

_FIELD = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("required", T.BooleanType()),
    T.StructField("type", T.StringType()),          # primitive name or nested JSON text
    T.StructField("doc", T.StringType()),
])
METADATA_SCHEMA = T.StructType([T.StructField("metadata", T.StructType([
    T.StructField("location", T.StringType()),
    T.StructField("format-version", T.LongType()),
    T.StructField("current-schema-id", T.LongType()),
    T.StructField("current-snapshot-id", T.LongType()),
    T.StructField("schemas", T.ArrayType(T.StructType([
        T.StructField("schema-id", T.LongType()),
        T.StructField("fields", T.ArrayType(_FIELD)),
    ]))),
    T.StructField("partition-specs", T.ArrayType(T.StructType([
        T.StructField("fields", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
    ]))),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("snapshots", T.ArrayType(T.StructType([
        T.StructField("snapshot-id", T.LongType()),
        T.StructField("timestamp-ms", T.LongType()),
        T.StructField("summary", T.MapType(T.StringType(), T.StringType())),
    ]))),
]))])


# --- M1-M3, M9: live catalog -----------------------------------------------------

def list_catalogs(spark: SparkSession) -> DataFrame:
    """(catalog, type) known to the session (M1); the type as configured, ``session`` for Spark's own, else blank."""
    names = spark.sql("SHOW CATALOGS")
    kinds = [(r["catalog"], spark.conf.get(f"spark.sql.catalog.{r['catalog']}.type", "session" if r["catalog"] == "spark_catalog" else ""))
             for r in names.collect()]
    return spark.createDataFrame(kinds, "catalog string, type string")


def list_namespaces(spark: SparkSession, catalog: str | None = None) -> DataFrame:
    """(namespace) names, nested parts joined by '.' (M2)."""
    sql = "SHOW NAMESPACES" + (f" IN {X.quote_ident(catalog)}" if catalog else "")
    return spark.sql(sql)


def list_tables(spark: SparkSession, ns: str | None = None) -> DataFrame:
    """(namespace, tableName, isTemporary) of a namespace (M3); all parts kept."""
    if ns is None:
        return spark.sql("SHOW TABLES")
    ident = ".".join(X.quote_ident(p) for p in ns.split("."))
    return spark.sql(f"SHOW TABLES IN {ident}")


def catalog_tree(spark: SparkSession, tables: DataFrame | None = None) -> DataFrame:
    """catalog -> namespace -> table as one flat (node_id, parent_id, kind, label, depth) (M9)."""
    cats = list_catalogs(spark).select(F.col("catalog").alias("label"))
    cur = spark.catalog.currentCatalog()
    nss = list_namespaces(spark).select(F.col("namespace").alias("label"))
    if tables is None:
        # One SHOW TABLES per namespace (catalog metadata, not data); session
        # temp views appear in each listing and are kept once.
        names = [r[0] for r in list_namespaces(spark).collect()]
        parts = [list_tables(spark, ns) for ns in names] or [list_tables(spark)]
        tables = parts[0]
        for p in parts[1:]:
            tables = tables.unionByName(p)
        tables = tables.distinct()
    tbl = tables
    c = cats.select(F.concat(F.lit("cat:"), "label").alias("node_id"), F.lit("").alias("parent_id"),
                    F.lit("catalog").alias("kind"), "label", F.lit(1).alias("depth"))
    n = nss.select(F.concat(F.lit(f"ns:{cur}."), "label").alias("node_id"), F.lit(f"cat:{cur}").alias("parent_id"),
                   F.lit("namespace").alias("kind"), "label", F.lit(2).alias("depth"))
    ns_of = F.when(F.col("namespace") == "", F.lit("<session>")).otherwise(F.col("namespace"))
    t = tbl.select(F.concat(F.lit(f"tbl:{cur}."), ns_of, F.lit("."), "tableName").alias("node_id"),
                   F.concat(F.lit(f"ns:{cur}."), ns_of).alias("parent_id"), F.lit("table").alias("kind"),
                   F.col("tableName").alias("label"), F.lit(3).alias("depth"))
    return c.unionByName(n).unionByName(t)


# --- M4, M5, M7, M8 for live session tables -------------------------------------------

LIVE_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("catalog_name", T.StringType()),
    T.StructField("namespace", T.ArrayType(T.StringType())),
    T.StructField("columns", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),      # nested JSON; its "name" is the kind
        T.StructField("nullable", T.BooleanType()),
        T.StructField("comment", T.StringType()),
    ]))),
    T.StructField("location", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("table_properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("partition_columns", T.ArrayType(T.StringType())),
])


def describe_tables(spark: SparkSession, names: list[str]) -> DataFrame:
    """(table, json_metadata) of live catalog tables via ``DESCRIBE ... AS JSON``.

    Each DESCRIBE is a catalog metadata command; the parsing below is one
    ``from_json`` over all of them.
    """
    frames = [spark.sql(f"DESCRIBE TABLE EXTENDED {'.'.join(X.quote_ident(p) for p in n.split('.'))} AS JSON")
              .select(F.lit(n).alias("table"), "json_metadata") for n in names]
    if not frames:
        return spark.createDataFrame([], "table string, json_metadata string")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def live_table_detail(desc: DataFrame) -> DataFrame:
    """(table, location, format, n_properties, namespace) of live tables (M4)."""
    d = desc.withColumn("m", F.from_json("json_metadata", LIVE_SCHEMA))
    return d.select("table", F.coalesce("m.location", F.lit("")).alias("location"),
                    F.coalesce("m.provider", F.lit("")).alias("format"),
                    F.coalesce(F.size("m.table_properties"), F.lit(0)).alias("n_properties"),
                    F.array_join("m.namespace", ".").alias("namespace"))


def live_table_columns(desc: DataFrame) -> DataFrame:
    """(table, pos, name, type, nullable, doc) of live tables (M5); nested types by kind."""
    d = desc.withColumn("m", F.from_json("json_metadata", LIVE_SCHEMA))
    ex = d.select("table", F.posexplode("m.columns").alias("pos", "c"))
    return ex.select("table", "pos", F.col("c.name").alias("name"),
                     F.get_json_object("c.type", "$.name").alias("type"),
                     F.coalesce("c.nullable", F.lit(True)).alias("nullable"),
                     F.coalesce("c.comment", F.lit("")).alias("doc"))


def live_partition_fields(desc: DataFrame) -> DataFrame:
    """(table, pos, name) partition columns of live tables (M7)."""
    d = desc.withColumn("m", F.from_json("json_metadata", LIVE_SCHEMA))
    return d.select("table", F.posexplode("m.partition_columns").alias("pos", "name"))


def live_table_properties(desc: DataFrame) -> DataFrame:
    """(table, property, value) of live tables (M8)."""
    d = desc.withColumn("m", F.from_json("json_metadata", LIVE_SCHEMA))
    return d.select("table", F.explode("m.table_properties").alias("property", "value"))


# --- M4-M8: metadata documents ----------------------------------------------------------

_CORRUPT = "_corrupt"
_STRICT = T.StructType([*METADATA_SCHEMA.fields, T.StructField(_CORRUPT, T.StringType())])


def check_metadata(docs: DataFrame, doc_col: str = "doc") -> DataFrame:
    """Adds ``m`` (the parsed ``metadata`` object) and ``status`` of each document.

    ``missing``: no text; ``malformed``: no JSON object, or a field of another type than it must have;
    ``no_metadata``: an object without ``metadata``; else ``ok``.
    """
    parsed = docs.withColumn("_p", F.from_json(F.col(doc_col), _STRICT, {"columnNameOfCorruptRecord": _CORRUPT}))
    blank = F.coalesce(F.trim(F.col(doc_col)), F.lit("")) == ""
    status = (F.when(blank, "missing").when(F.col("_p").isNull() | F.col(f"_p.{_CORRUPT}").isNotNull(), "malformed")
              .when(F.col("_p.metadata").isNull(), "no_metadata").otherwise("ok"))
    return parsed.withColumn("status", status).withColumn("m", F.col("_p.metadata")).drop("_p")


def quarantine(docs: DataFrame, doc_col: str = "doc") -> DataFrame:
    """The documents that cannot be used, with their ``status``, for repair; the others' operators leave them out."""
    return check_metadata(docs, doc_col).filter(F.col("status") != "ok").drop("m")


def parse_metadata(docs: DataFrame, doc_col: str = "doc") -> DataFrame:
    """The documents that can be used, with ``m``: their parsed ``metadata`` object."""
    return check_metadata(docs, doc_col).filter(F.col("status") == "ok").drop("status")


def location_tree(docs: DataFrame, doc_col: str = "doc") -> DataFrame:
    """The tree of catalogs, namespaces and tables that the documents' locations span (M9).

    One row per node: node_id (its path), parent_id ('' of a catalog), kind, label, depth (1 = catalog) and tables, the
    number of tables at or below it.  The first step of a location is its catalog, the last a table, all between are
    namespaces; a place that is both keeps the kind ``table``.  Every location is expanded into its steps (as many
    as it is deep) and counted per node with map-side aggregation, so the root is no hot group.
    """
    m = parse_metadata(docs, doc_col)
    path = F.regexp_replace(F.col("m.location"), "^[A-Za-z0-9+.-]+://[^/]*", "")
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    nodes = (m.select(steps.alias("s")).filter(F.size("s") > 0)
             .select("s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("depth"))
             .select(F.concat_ws("/", F.slice("s", F.lit(1), F.col("depth"))).alias("node_id"),
                     F.when(F.col("depth") > 1, F.concat_ws("/", F.slice("s", F.lit(1), F.col("depth") - 1))).otherwise("").alias("parent_id"),
                     F.element_at("s", F.col("depth")).alias("label"), "depth", (F.col("depth") == F.size("s")).alias("leaf")))
    kind = F.when(F.max("leaf"), "table").when(F.col("depth") == 1, "catalog").otherwise("namespace")
    return nodes.groupBy("node_id", "parent_id", "label", "depth").agg(kind.alias("kind"), F.count(F.lit(1)).alias("tables"))


def table_detail(docs: DataFrame, key: str = "table_id", doc_col: str = "doc") -> DataFrame:
    """(key, location, format, current_snapshot_id, n_properties) (M4)."""
    m = parse_metadata(docs, doc_col)
    fmt = F.concat(F.lit("iceberg/v"), F.coalesce(F.col("m.`format-version`"), F.lit(0)).cast("string"))
    return m.select(key, F.coalesce(F.col("m.location"), F.lit("")).alias("location"), fmt.alias("format"),
                    F.coalesce(F.col("m.`current-snapshot-id`"), F.lit(0)).alias("current_snapshot_id"),
                    F.coalesce(F.size(F.col("m.properties")), F.lit(0)).alias("n_properties"))


def type_kind(type_text: Column) -> Column:
    """Primitive type name, or the kind ('struct'/'list'/'map') of a nested type."""
    return F.coalesce(F.nullif(F.get_json_object(type_text, "$.type"), F.lit("")), type_text)


def table_columns(docs: DataFrame, key: str = "table_id", doc_col: str = "doc") -> DataFrame:
    """(key, pos, name, type, nullable, doc) of the current schema (M5).

    The schema whose id equals current-schema-id, else the first schema, else
    none.  Nested types show their kind; nullable = not required.
    """
    m = parse_metadata(docs, doc_col)
    schemas = F.coalesce(F.col("m.schemas"), F.array().cast(METADATA_SCHEMA["metadata"].dataType["schemas"].dataType))
    match = F.filter(schemas, lambda s: s["schema-id"] == F.col("m.`current-schema-id`"))
    chosen = F.coalesce(F.try_element_at(match, F.lit(1)), F.try_element_at(schemas, F.lit(1)))
    ex = m.select(key, F.posexplode(chosen["fields"]).alias("pos", "f"))
    return ex.select(key, "pos", F.col("f.name").alias("name"), type_kind(F.col("f.type")).alias("type"),
                     (~F.coalesce(F.col("f.required"), F.lit(False))).alias("nullable"),
                     F.coalesce(F.col("f.doc"), F.lit("")).alias("doc"))


def partition_fields(docs: DataFrame, key: str = "table_id", doc_col: str = "doc") -> DataFrame:
    """(key, pos, name) from the first partition spec, not the default spec (M7)."""
    m = parse_metadata(docs, doc_col)
    first = F.try_element_at(F.col("m.`partition-specs`"), F.lit(1))
    return m.select(key, F.posexplode(first["fields"]).alias("pos", "f")).select(
        key, "pos", F.col("f.name").alias("name"))


def table_properties(docs: DataFrame, key: str = "table_id", doc_col: str = "doc") -> DataFrame:
    """(key, key, value) one row per table property (M8)."""
    m = parse_metadata(docs, doc_col)
    return m.select(key, F.explode(F.col("m.properties")).alias("property", "value"))


def snapshots_of(docs: DataFrame, key: str = "table_id", doc_col: str = "doc") -> DataFrame:
    """(key, snapshot_id, timestamp_ms, operation, current_snapshot_id) from documents."""
    m = parse_metadata(docs, doc_col)
    ex = m.select(key, F.col("m.`current-snapshot-id`").alias("current_snapshot_id"),
                  F.explode(F.col("m.snapshots")).alias("s"))
    return ex.select(key, F.col("s.`snapshot-id`").alias("snapshot_id"), F.col("s.`timestamp-ms`").alias("timestamp_ms"),
                     F.coalesce(F.col("s.summary")["operation"], F.lit("")).alias("operation"), "current_snapshot_id")


def history_ts_text(ms: Column) -> Column:
    """Epoch millis as 'YYYY-MM-DD HH:MM:SS UTC'; millis <= 0 or missing -> '—'.

    Built on a TIMESTAMP_NTZ epoch so the text is UTC whatever the session zone.
    """
    t = F.timestamp_add("MILLISECOND", ms, X.ntz("1970-01-01 00:00:00"))
    return F.when(F.coalesce(ms, F.lit(0)) <= 0, F.lit(NO_VALUE)).otherwise(
        F.concat(F.date_format(t, HISTORY_TS_FORMAT), F.lit(" UTC")))


def millis_of(ts: Column) -> Column:
    """TIMESTAMP_NTZ -> epoch milliseconds (time-zone free)."""
    return F.timestamp_diff("MILLISECOND", X.ntz("1970-01-01 00:00:00"), ts)


def table_history(snapshots: DataFrame, key: str = "table_id", path: str | None = None) -> DataFrame:
    """Snapshot history per table, newest first.

    Columns: key, snapshot_id, position (1 = newest), ts_text, operation
    ('—' when blank), current (the table's current snapshot: the
    ``current_snapshot_id`` column when present, else the newest), gap_ms to
    the previous (older) snapshot.  Positions and neighbours come from pieces
    (``lakeops.plans.ordered.neighbours``), so a table with a huge history is
    spread over many tasks.
    """
    from lakeops.plans.ordered import neighbours
    from lakeops.session import shared_dir
    path = path or shared_dir(snapshots.sparkSession, "table_history")
    j = neighbours(snapshots, key, "timestamp_ms", "snapshot_id", path, older="_older")
    current = (F.col("snapshot_id") == F.col("current_snapshot_id")) if "current_snapshot_id" in snapshots.columns \
        else (F.col("position") == 1)
    return j.select(
        key, "snapshot_id", F.col("position").cast("int").alias("position"),
        history_ts_text(F.col("timestamp_ms")).alias("ts_text"),
        F.coalesce(F.nullif(F.col("operation"), F.lit("")), F.lit(NO_VALUE)).alias("operation"),
        F.coalesce(current, F.lit(False)).alias("current"), (F.col("timestamp_ms") - F.col("_older")).alias("gap_ms"))
