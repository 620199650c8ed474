"""Metadata documents and snapshot history."""

from pyspark.sql import functions as F

from lakeops.sources import catalog as C

DOC = ('{"metadata":{"format-version":1,"location":"file:///lake/sales","current-snapshot-id":42,"current-schema-id":3,'
       '"schemas":[{"schema-id":3,"fields":[{"name":"sku","required":true,"type":"string","doc":"stock number"},'
       '{"name":"tags","required":false,"type":{"type":"list","element":"string"}}]}],'
       '"partition-specs":[{"fields":[{"name":"month"}]}],"properties":{"team":"retail"},'
       '"snapshots":[{"snapshot-id":42,"timestamp-ms":1650000000000,"summary":{"operation":"overwrite"}}]}}')


def docs(spark, doc=DOC):
    return spark.createDataFrame([(1, doc)], "table_id long, doc string")


def test_detail_columns_partitions(spark):
    d = docs(spark)
    det = C.table_detail(d).first()
    assert (det.location, det.format, det.current_snapshot_id) == ("file:///lake/sales", "iceberg/v1", 42)
    cols = [(r.name, r.type, r.nullable, r.doc) for r in C.table_columns(d).orderBy("pos").collect()]
    assert cols == [("sku", "string", False, "stock number"), ("tags", "list", True, "")]
    assert [r.name for r in C.partition_fields(d).collect()] == ["month"]
    assert [(r.property, r.value) for r in C.table_properties(d).collect()] == [("team", "retail")]


def test_missing_schema_falls_back_to_first(spark):
    d = docs(spark, DOC.replace('"current-schema-id":3', '"current-schema-id":9'))
    assert [r.name for r in C.table_columns(d).orderBy("pos").collect()] == ["sku", "tags"]


def test_history_newest_first(spark):
    snaps = spark.createDataFrame([(1, 100, 1000, "append", 200), (1, 200, 2000, "overwrite", 200),
                                   (1, 300, 0, "", 200)],
                                  "table_id long, snapshot_id long, timestamp_ms long, operation string, "
                                  "current_snapshot_id long")
    rows = [(r.snapshot_id, r.position, r.ts_text, r.operation, r.current)
            for r in C.table_history(snaps).orderBy("position").collect()]
    assert rows == [(200, 1, "1970-01-01 00:00:02 UTC", "overwrite", True),
                    (100, 2, "1970-01-01 00:00:01 UTC", "append", False),
                    (300, 3, "—", "—", False)]


def test_metadata_snapshots(spark):
    h = C.table_history(C.snapshots_of(docs(spark))).first()
    assert (h.snapshot_id, h.current, h.ts_text) == (42, True, "2022-04-15 05:20:00 UTC")


def test_bad_documents_are_set_aside(spark):
    rows = [(1, DOC), (2, DOC[:-9]), (3, '{"error":{"code":404}}'), (4, ""), (5, None), (6, "  "), (7, "[1]"), (8, "nonsense"),
            (9, DOC.replace('"format-version":1', '"format-version":"one"')), (10, '{"metadata":null}'), (11, '{"metadata":{}}')]
    d = spark.createDataFrame(rows, "table_id long, doc string")
    assert {r.table_id: r.status for r in C.quarantine(d).collect()} == {
        2: "malformed", 3: "no_metadata", 4: "missing", 5: "missing", 6: "missing", 7: "malformed", 8: "malformed", 9: "malformed",
        10: "no_metadata"}
    assert {r.table_id: r.location for r in C.table_detail(d).collect()} == {1: "file:///lake/sales", 11: ""}
    assert {r.table_id for r in C.table_columns(d).collect()} == {1}


def test_location_tree(spark):
    places = ["file:///lake/a/b/t1", "s3://bucket/lake/a/t2", "/lake/a/b/t3", "/lake/a/b", "/solo", "", "/lake//a/b/t1/"]
    d = spark.createDataFrame([(i, DOC.replace("file:///lake/sales", p)) for i, p in enumerate(places)] + [(99, "torn")],
                              "table_id long, doc string")
    tree = {r.node_id: (r.parent_id, r.kind, r.depth, r.tables) for r in C.location_tree(d).collect()}
    assert tree == {"lake": ("", "catalog", 1, 5), "lake/a": ("lake", "namespace", 2, 5), "lake/a/b": ("lake/a", "table", 3, 4),
                    "lake/a/b/t1": ("lake/a/b", "table", 4, 2), "lake/a/b/t3": ("lake/a/b", "table", 4, 1),
                    "lake/a/t2": ("lake/a", "table", 3, 1), "solo": ("", "table", 1, 1)}
    assert all(p == "" or p in tree for p, *_ in tree.values())


def test_catalog_types(spark):
    spark.conf.set("spark.sql.catalog.spark_catalog.type", "hive")
    try:
        assert {r.catalog: r.type for r in C.list_catalogs(spark).collect()}["spark_catalog"] == "hive"
    finally:
        spark.conf.unset("spark.sql.catalog.spark_catalog.type")
    assert {r.catalog: r.type for r in C.list_catalogs(spark).collect()}["spark_catalog"] == "session"


def test_live_catalog_listing(spark):
    spark.range(1).createOrReplaceTempView("lakeops_probe")
    assert "spark_catalog" in [r.catalog for r in C.list_catalogs(spark).collect()]
    assert "default" in [r.namespace for r in C.list_namespaces(spark).collect()]
    names = [r.tableName for r in C.list_tables(spark).filter(F.col("isTemporary")).collect()]
    assert "lakeops_probe" in names
    kinds = {r.kind for r in C.catalog_tree(spark).collect()}
    assert kinds == {"catalog", "namespace", "table"}


def test_live_table_metadata(spark):
    from lakeops.session import shared_dir
    spark.sql("CREATE NAMESPACE IF NOT EXISTS lakeops_live")
    spark.sql("DROP TABLE IF EXISTS lakeops_live.t")
    spark.sql(f"CREATE TABLE lakeops_live.t (id BIGINT COMMENT 'pk', name STRING, tags MAP<STRING,STRING>) "
              f"USING parquet PARTITIONED BY (name) LOCATION '{shared_dir(spark, 'live_t')}' TBLPROPERTIES ('team'='x')")
    desc = C.describe_tables(spark, ["lakeops_live.t"])
    det = C.live_table_detail(desc).first()
    assert (det.format, det.namespace, det.n_properties >= 1) == ("parquet", "lakeops_live", True)
    cols = [(r.name, r.type, r.doc) for r in C.live_table_columns(desc).orderBy("pos").collect()]
    assert cols == [("id", "bigint", "pk"), ("tags", "map", ""), ("name", "string", "")]
    assert [r.name for r in C.live_partition_fields(desc).collect()] == ["name"]
    assert ("team", "x") in [(r.property, r.value) for r in C.live_table_properties(desc).collect()]
    tree = {(r.node_id, r.parent_id) for r in C.catalog_tree(spark).collect()}
    assert ("tbl:spark_catalog.lakeops_live.t", "ns:spark_catalog.lakeops_live") in tree
