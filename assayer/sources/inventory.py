"""Table and column inventories as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from assayer.functions.types import normalize_native, normalize_spark
from assayer.sources.readers import Source, TableRef

TABLES_DDL = "database_name string, schema_name string, table_name string, comment string"
COLUMNS_DDL = (
    "database_name string, schema_name string, table_name string, column_name string, normalized_type string, "
    "native_type string, is_nullable boolean, ordinal_position int, comment string"
)


def table_inventory(spark: SparkSession, source: Source) -> DataFrame:
    rows = [(t.database, t.schema, t.name, source.comments.get(t)) for t in source.tables]
    return spark.createDataFrame(rows, TABLES_DDL)


def describe(ref: TableRef, schema: StructType) -> list[tuple]:
    return [
        (
            ref.database, ref.schema, ref.name, f.name, normalize_spark(f.dataType), f.dataType.simpleString(),
            f.nullable, position, f.metadata.get("comment"),
        )
        for position, f in enumerate(schema.fields, start=1)
    ]


def column_inventory(spark: SparkSession, source: Source) -> DataFrame:
    """One row per column, from the warehouse's own catalogue or from the Spark schema; no data is read."""
    if source.native_columns is not None:
        listed = spark.createDataFrame([(t.schema, t.name) for t in source.tables], "schema_name string, table_name string")
        return source.native_columns.join(listed, ["schema_name", "table_name"], "left_semi").select(
            F.lit(source.database).alias("database_name"),
            "schema_name",
            "table_name",
            "column_name",
            normalize_native(F.col("native_type")).alias("normalized_type"),
            "native_type",
            (F.col("nullable_flag") == 1).alias("is_nullable"),
            F.col("ordinal_position").cast("int").alias("ordinal_position"),
            "comment",
        )
    rows = [row for ref in source.tables for row in describe(ref, source.schema(ref))]
    return spark.createDataFrame(rows, COLUMNS_DDL)


def primary_keys(spark: SparkSession, source: Source) -> DataFrame:
    """(schema_name, table_name, primary_key_columns in key order); empty for sources without keys."""
    if source.primary_keys is None:
        return spark.createDataFrame([], "schema_name string, table_name string, primary_key_columns array<string>")
    return ordered_names(source.primary_keys, ["schema_name", "table_name"], "key_position", "column_name", "primary_key_columns")


def ordered_names(df: DataFrame, keys: list[str], position: str, name: str, alias: str) -> DataFrame:
    """Names of one table in position order. Groups are as wide as a table has columns."""
    pairs = F.sort_array(F.collect_list(F.struct(position, name)))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda p: p[name]).alias(alias))


COUNTS_DDL = "database_name string, schema_name string, table_name string, row_count bigint, is_estimate boolean"


def row_counts(spark: SparkSession, source: Source, exact: bool = True) -> DataFrame:
    """Rows per table: from file footers where they tell (exact, no scan), else counted.

    With `exact=False` nothing is scanned: what footers do not tell is the catalogue's statistics or the warehouse's own
    estimate, or NULL where there is none.
    """
    told = {t: source.row_count(t) for t in source.tables}
    rows = [(t.database, t.schema, t.name, n, False) for t, n in told.items() if n is not None]
    left = [t for t, n in told.items() if n is None]
    parts = [spark.createDataFrame(rows, COUNTS_DDL)] if rows or not left else []
    if not exact and left:
        known = spark.createDataFrame([(t.database, t.schema, t.name, source.statistics.get(t)) for t in left],
                                      "database_name string, schema_name string, table_name string, row_count bigint")
        if source.row_estimates is not None:
            known = known.drop("row_count").join(
                source.row_estimates.withColumnRenamed("row_count_estimate", "row_count"), ["schema_name", "table_name"], "left")
        parts.append(known.select("database_name", "schema_name", "table_name", "row_count", F.lit(True).alias("is_estimate")))
    elif left:
        parts += [
            source.read(t).agg(F.count("*").alias("row_count")).select(
                F.lit(t.database).alias("database_name"), F.lit(t.schema).alias("schema_name"), F.lit(t.name).alias("table_name"),
                "row_count", F.lit(False).alias("is_estimate"))
            for t in left
        ]
    return reduce(DataFrame.unionByName, parts)


def tables_by_schema(tables: DataFrame) -> DataFrame:
    """Sorted tables with the size of their schema, one row per table."""
    sizes = tables.groupBy("schema_name").agg(F.count("*").alias("n_tables"))
    return tables.select("schema_name", "table_name").join(sizes, "schema_name").orderBy("schema_name", "table_name")
