"""Metadata tables as append-only Parquet, partitioned by snapshot where one exists."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer.functions.jsons import encode_samples
from assayer.operators.validate import ground

# Column layouts of the stored tables.
SNAPSHOTS_DDL = "id string, captured_at timestamp_ntz, source_database string, scope_id string, rule_version string, fingerprint string"
TABLES_DDL = (
    "id string, snapshot_id string, database_name string, schema_name string, table_name string, "
    "primary_key_columns array<string>, row_count_estimate bigint, comment string"
)
COLUMNS_DDL = (
    "id string, snapshot_id string, table_id string, column_name string, normalized_type string, native_type string, "
    "is_nullable boolean, ordinal_position int, comment string, sample_values_json string, distinct_sample_count bigint"
)
DEFINITIONS_DDL = (
    "id string, name string, display_name string, description string, rationale string, evidence array<string>, "
    "confidence string, status string, proposed_by string, proposed_at timestamp_ntz, prompt_version string, "
    "model string, source_snapshot_id string, scope_id string, supersedes_id string, parent_id string"
)
# what tells two proposals of one name and time apart
DISTINCT_CONTENT = ["kind", "source_columns", "display_name", "description", "rationale", "evidence"]
LINKS_DDL = "id string, entity_id string, snapshot_column_id string"


def stable_id(*parts: str | Column) -> Column:
    """Ids derived from content, so that a retried task writes the same row again. Parts may hold any text or NULL."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.to_json(F.array(*[c.cast("string") for c in columns])))


def append(df: DataFrame, root: str, table: str, partition: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(f"{root}/{table}")


def read_table(spark: SparkSession, root: str, table: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).parquet(f"{root}/{table}")


def persist_snapshots(root: str, snapshots: DataFrame, tables: DataFrame, columns: DataFrame) -> None:
    """Append snapshots, their tables and their columns, keeping the given ids.

    tables:  snapshot_id, database_name, schema_name, table_name, primary_key_columns, row_count_estimate, comment
    columns: snapshot_id, database_name, schema_name, table_name, column_name, normalized_type, native_type,
             is_nullable, ordinal_position, comment, sample_values ARRAY<STRING>, distinct_sample_count
    Empty key and sample lists are stored as NULL. The snapshot row comes last: until
    it is there, readers do not see a half-written snapshot.
    """
    place = ["snapshot_id", "database_name", "schema_name", "table_name"]
    table_id = stable_id(*place)
    stored_tables = tables.select(
        table_id.alias("id"), "snapshot_id", "database_name", "schema_name", "table_name",
        F.when(F.size("primary_key_columns") > 0, F.col("primary_key_columns")).alias("primary_key_columns"),
        F.col("row_count_estimate").cast("bigint").alias("row_count_estimate"), "comment",
    )
    stored_columns = columns.select(
        stable_id(*place, "column_name").alias("id"), "snapshot_id", table_id.alias("table_id"), "column_name",
        "normalized_type", "native_type", "is_nullable", "ordinal_position", "comment",
        encode_samples(F.col("sample_values")).alias("sample_values_json"),
        F.col("distinct_sample_count").cast("bigint").alias("distinct_sample_count"),
    )
    append(stored_tables, root, "snapshot_tables", "snapshot_id")
    append(stored_columns, root, "snapshot_columns", "snapshot_id")
    append(snapshots.select(*[c.split()[0] for c in SNAPSHOTS_DDL.split(", ")]), root, "schema_snapshots")


def load_snapshots(spark: SparkSession, root: str, snapshot_id: str | None = None) -> DataFrame:
    """One row per stored table: its columns as an array in ordinal order, sample size 0 and not truncated.

    Empty if the snapshot does not exist. `snapshot_id` prunes partitions.
    """
    def chosen(df: DataFrame, column: str) -> DataFrame:
        return df if snapshot_id is None else df.where(F.col(column) == snapshot_id)

    snapshots = chosen(read_table(spark, root, "schema_snapshots", SNAPSHOTS_DDL), "id")
    tables = chosen(read_table(spark, root, "snapshot_tables", TABLES_DDL), "snapshot_id")
    columns = chosen(read_table(spark, root, "snapshot_columns", COLUMNS_DDL), "snapshot_id")
    sample = F.coalesce(F.from_json("sample_values_json", "array<string>"), F.array().cast("array<string>"))
    entry = F.struct(
        "ordinal_position", "column_name", "normalized_type", "native_type", "is_nullable", "comment",
        sample.alias("sample_values"), "distinct_sample_count",
    )
    # as many entries as the table has columns
    per_table = columns.groupBy("table_id").agg(F.sort_array(F.collect_list(entry)).alias("columns"))
    head = snapshots.select(F.col("id").alias("snapshot_id"), "captured_at", "source_database")
    return (
        tables.join(head, "snapshot_id").join(per_table, tables["id"] == per_table["table_id"], "left").select(
            "snapshot_id", "captured_at", "source_database", "database_name", "schema_name", "table_name",
            F.coalesce("primary_key_columns", F.array().cast("array<string>")).alias("primary_key_columns"),
            "row_count_estimate", "comment", "columns",
            F.lit(0).alias("sample_rows_returned"), F.lit(False).alias("sample_truncated"),
        )
    )


def stored_column_ids(spark: SparkSession, root: str) -> DataFrame:
    """(snapshot_id, schema_name, table_name, column_name, column_id) for grounding."""
    tables = read_table(spark, root, "snapshot_tables", TABLES_DDL).select(
        F.col("id").alias("table_id"), "schema_name", "table_name"
    )
    columns = read_table(spark, root, "snapshot_columns", COLUMNS_DDL)
    return columns.join(tables, "table_id").select(
        "snapshot_id", "schema_name", "table_name", "column_name", F.col("id").alias("column_id")
    )


def definition_rows(proposals: DataFrame, proposed_by: str = "system") -> DataFrame:
    """Proposals as definitions in status `proposed`; `proposed_by` is `system` or `user:<id>`.

    proposals: name, display_name, description, rationale, evidence, confidence,
               proposed_at, prompt_version, model, source_snapshot_id, scope_id
               [, supersedes_id, parent_id, kind, source_columns]
    """
    if proposed_by != "system" and not proposed_by.startswith("user:"):
        raise ValueError("proposed_by is 'system' or 'user:<id>'")
    for c in ("supersedes_id", "parent_id"):
        if c not in proposals.columns:
            proposals = proposals.withColumn(c, F.lit(None).cast("string"))
    filled = proposals.withColumn("status", F.lit("proposed")).withColumn("proposed_by", F.lit(proposed_by))
    filled = filled.withColumn("id", stable_id(
        "source_snapshot_id", "name", "proposed_at", *[F.to_json(F.struct(c)) for c in DISTINCT_CONTENT if c in proposals.columns]))
    return filled.select(*[c.split()[0] for c in DEFINITIONS_DDL.split(", ")], *[c for c in proposals.columns if c == "source_columns"])


def persist_definitions(root: str, proposals: DataFrame, snapshot_columns: DataFrame, proposed_by: str = "system",
                        mode: str = "raise") -> DataFrame:
    """Append definitions and one link per source column; returns the references that resolve to nothing.

    Additive: nothing stored before is touched. In `quarantine` mode a definition
    with any unresolved reference is held back as a whole.
    """
    defined = definition_rows(proposals, proposed_by)
    references = defined.select(
        F.col("id").alias("entity_id"), F.col("source_snapshot_id").alias("snapshot_id"), F.inline("source_columns")
    ).withColumnRenamed("column", "column_name")
    resolved, lost = ground(references, snapshot_columns, mode)
    bad = lost.select("entity_id").distinct()
    kept = defined.drop("source_columns").join(bad.withColumnRenamed("entity_id", "id"), "id", "left_anti")
    links = resolved.join(bad, "entity_id", "left_anti").select(
        stable_id("entity_id", "column_id").alias("id"), "entity_id", F.col("column_id").alias("snapshot_column_id")
    )
    append(links, root, "definition_columns")
    append(kept, root, "definitions")
    return lost


def dump_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def _mark_file(spark: SparkSession, root: str, name: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/source_marks/{hashlib.md5(name.encode()).hexdigest()}.json")
    return jvm, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def read_mark(spark: SparkSession, root: str, name: str) -> dict | None:
    """What the last complete run noted about a source; None if there was none. A few bytes, read without a job."""
    jvm, fs, path = _mark_file(spark, root, name)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError:  # a run ended while it wrote; as if there were none
        return None
    finally:
        stream.close()


def write_mark(spark: SparkSession, root: str, name: str, mark: dict) -> None:
    _, fs, path = _mark_file(spark, root, name)
    stream = fs.create(path, True)
    try:
        stream.write(bytearray(json.dumps(mark).encode()))
    finally:
        stream.close()
