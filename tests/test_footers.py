"""Schemas and row counts from footers, kept per file; the skip path that needs no job."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F, types as T

from assayer.plans import ingest as plan
from assayer.sources import footers, store
from assayer.sources.inventory import column_inventory, row_counts
from assayer.sources.readers import open_source


def jobs_of(spark, action):
    """How many jobs an action runs, and what it gives."""
    tracker, group = spark.sparkContext.statusTracker(), f"g{id(action)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        result = action()
        return len(tracker.getJobIdsForGroup(group)), result
    finally:
        spark.sparkContext._jsc.clearJobGroup()


@pytest.fixture
def folder(spark, tmp_path):
    root = f"file://{tmp_path}/wh"
    spark.range(30).selectExpr("id", "cast(id as string) as name").repartition(3).write.parquet(f"{root}/a")
    spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "n int, day string").write.partitionBy("day").parquet(f"{root}/b")
    return root


def counted(spark, source):
    return {r.table_name: (r.row_count, r.is_estimate) for r in row_counts(spark, source, exact=False).collect()}


def test_counts_and_schemas_without_a_scan(spark, folder):
    source = open_source(spark, "parquet", folder, database="wh")
    assert counted(spark, source) == {"a": (30, False), "b": (3, False)}
    assert "Scan parquet" not in row_counts(spark, source)._jdf.queryExecution().toString()
    assert source.read(source.tables[1]).where("day = 'y'").count() == 2
    columns = {(r.table_name, r.column_name): (r.normalized_type, r.ordinal_position) for r in column_inventory(spark, source).collect()}
    assert columns == {("a", "id"): ("integer", 1), ("a", "name"): ("string", 2), ("b", "n"): ("integer", 1), ("b", "day"): ("string", 2)}


def test_only_new_files_are_read_and_generations_merge(spark, folder, tmp_path):
    index = f"file://{tmp_path}/index"
    open_source(spark, "parquet", folder, database="wh", index=index).row_count
    first = open_source(spark, "parquet", folder, database="wh", index=index)
    assert counted(spark, first)["a"] == (30, False)
    kept = spark.read.schema(footers.INDEX_DDL).parquet(f"{index}/file_footers")
    n_files = kept.count()
    spark.range(5).selectExpr("cast(id as int) as id", "1.5D as rate").coalesce(1).write.mode("append").parquet(f"{folder}/a")
    second = open_source(spark, "parquet", folder, database="wh", index=index)
    assert second.listing() != first.listing()
    assert counted(spark, second)["a"] == (35, False)
    assert spark.read.schema(footers.INDEX_DDL).parquet(f"{index}/file_footers").count() == n_files + 1
    read = second.read(second.tables[0])
    assert [(f.name, f.dataType.simpleString()) for f in read.schema] == [("id", "bigint"), ("name", "string"), ("rate", "double")]
    assert read.agg(F.sum("id"), F.count("rate"), F.count("name")).first() == (435 + 10, 5, 30)
    third = open_source(spark, "parquet", folder, database="wh", index=index)
    counted(spark, third)
    assert third.listing() == second.listing() and spark.read.schema(footers.INDEX_DDL).parquet(f"{index}/file_footers").count() == n_files + 1


def test_types_are_those_of_sparks_reader(spark, tmp_path):
    table = pa.table({
        "a": pa.array([1], pa.int8()), "b": pa.array([1], pa.uint16()), "c": pa.array([1], pa.uint64()), "d": pa.array([1.0], pa.float32()),
        "e": pa.array([0], pa.date32()), "f": pa.array([0], pa.timestamp("us")), "g": pa.array([0], pa.timestamp("ms", tz="UTC")),
        "h": pa.array([[1]], pa.list_(pa.int64())), "i": pa.array([{"x": 1, "y": "z"}]), "j": pa.array(["q"]).dictionary_encode(),
        "k": pa.array([b"1"], pa.binary(3) if False else pa.binary()), "l": pa.array([None], pa.decimal128(12, 3)), "m": pa.array([[("k", 1)]], pa.map_(pa.string(), pa.int32())),
        "n": pa.array([True]), "o": pa.array(["x"], pa.large_string()),
    })
    path = tmp_path / "t.parquet"
    pq.write_table(table, path)
    n, schema = footers.read_footer(f"file:{path}")
    assert n == 1 and T.StructType.fromJson(__import__("json").loads(schema)) == spark.read.parquet(f"file://{path}").schema


def test_unreadable_footers_are_left_to_spark(spark, tmp_path, monkeypatch):
    spark.range(4).write.parquet(f"file://{tmp_path}/wh/t")
    real = footers.FooterIndex._load

    def as_if_unknown(self):
        monkeypatch.setattr(footers, "read_footers", lambda s, files: s.createDataFrame(
            [(f.path, f.size, f.changed, None, None) for f in files], footers.INDEX_DDL))
        return real(self)

    monkeypatch.setattr(footers.FooterIndex, "_load", as_if_unknown)
    source = open_source(spark, "parquet", f"file://{tmp_path}/wh", database="wh")
    assert source.row_count(source.tables[0]) is None
    assert row_counts(spark, source).first().row_count == 4 and source.read(source.tables[0]).columns == ["id"]
    assert counted(spark, source) == {"t": (None, True)}


def test_conflicting_types_are_named():
    def schema(ddl):
        return T.StructType.fromDDL(ddl)

    merged = footers.merged_schema(schema("a int, s struct<x: float>"), schema("b string, s struct<y: int, x: double>, a bigint"), "t")
    assert merged.simpleString() == "struct<a:bigint,s:struct<x:double,y:int>,b:string>"
    with pytest.raises(footers.SchemaConflict, match=r"t\.a is int in one file and string in another"):
        footers.merged_schema(schema("a int"), schema("a string"), "t")


def test_unchanged_files_skip_without_a_job(spark, folder, tmp_path):
    root = f"file://{tmp_path}/store"
    first = plan.ingest(spark, open_source(spark, "parquet", folder, database="wh", index=root), root)
    n_jobs, again = jobs_of(spark, lambda: plan.ingest(spark, open_source(spark, "parquet", folder, database="wh", index=root), root))
    assert n_jobs == 0 and again.skipped and (again.snapshot_id, again.captured_at) == (first.snapshot_id, first.captured_at)
    # more rows of the same structure: other files, still skipped; the new list is noted
    spark.range(5).selectExpr("id", "cast(id as string) as name").write.mode("append").parquet(f"{folder}/a")
    changed = plan.ingest(spark, open_source(spark, "parquet", folder, database="wh", index=root), root)
    assert changed.skipped and changed.snapshot_id == first.snapshot_id
    assert jobs_of(spark, lambda: plan.ingest(spark, open_source(spark, "parquet", folder, database="wh", index=root), root))[0] == 0
    # another column: a new snapshot
    spark.range(2).selectExpr("id", "id as other").write.mode("append").parquet(f"{folder}/a")
    assert not plan.ingest(spark, open_source(spark, "parquet", folder, database="wh", index=root), root).skipped
    assert not plan.ingest(spark, open_source(spark, "parquet", folder, database="wh", index=root), root, rule_version="rules-v9").skipped


def test_a_broken_mark_counts_as_none(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    assert store.read_mark(spark, root, "wh") is None
    store.write_mark(spark, root, "wh", {"a": 1})
    assert store.read_mark(spark, root, "wh") == {"a": 1}
    _, fs, path = store._mark_file(spark, root, "wh")
    stream = fs.create(path, True)
    stream.write(bytearray(b'{"a": '))
    stream.close()
    assert store.read_mark(spark, root, "wh") is None


def test_catalogue_statistics(spark, tmp_path):
    spark.sql(f"create database counted location 'file://{tmp_path}/counted'")
    spark.sql("create table counted.t using parquet as select id from range(7)")
    spark.sql("analyze table counted.t compute statistics")
    assert counted(spark, open_source(spark, "catalog", "counted")) == {"t": (7, True)}
