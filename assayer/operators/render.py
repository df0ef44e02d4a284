"""Markdown description of snapshots, one text per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.text import approximate_count, display_samples, display_value

# Headings and fallbacks of the description.
NO_KEY = "_(none detected)_"
NO_COUNT = "_unknown (table not yet analyzed)_"
NO_TABLES = "_(No tables found in this snapshot.)_"
COLUMN_HEADER = [
    "| # | Name | Normalized type | Native type | Nullable | Distinct (in sample) | Sample values |",
    "|---|------|-----------------|-------------|----------|----------------------|---------------|",
]
UNQUOTED_TYPES = ["integer", "numeric", "boolean"]


def _ticked(text: Column) -> Column:
    return F.concat(F.lit("`"), text, F.lit("`"))


def column_line(c: Column) -> Column:
    """`c` is a struct as load_snapshots gives it."""
    bare = c["normalized_type"].isin(UNQUOTED_TYPES)
    shown = F.transform(
        c["sample_values"], lambda v: F.when(bare, display_value(v, quoted=False)).otherwise(display_value(v))
    )
    return F.concat(
        F.lit("| "), c["ordinal_position"].cast("string"), F.lit(" | "), _ticked(c["column_name"]), F.lit(" | "),
        _ticked(c["normalized_type"]), F.lit(" | "), _ticked(c["native_type"]), F.lit(" | "),
        F.when(c["is_nullable"], "yes").otherwise("no"), F.lit(" | "),
        F.coalesce(c["distinct_sample_count"], F.lit(0)).cast("string"), F.lit(" | "), display_samples(shown), F.lit(" |"),
    )


def describe_tables(tables: DataFrame) -> DataFrame:
    """Adds `markdown` to rows as load_snapshots gives them."""
    keys = F.col("primary_key_columns")
    key_text = F.when(F.size(keys) > 0, F.array_join(F.transform(keys, _ticked), ", ")).otherwise(NO_KEY)
    count = F.when(F.col("row_count_estimate").isNotNull(), approximate_count(F.col("row_count_estimate"))).otherwise(NO_COUNT)
    more = F.when(F.col("sample_truncated"), " (truncated, more rows exist)").otherwise("")
    comment = F.when(
        F.coalesce(F.col("comment"), F.lit("")) != "",
        F.array(F.concat(F.lit("_Table comment: "), F.col("comment"), F.lit("_")), F.lit("")),
    ).otherwise(F.array().cast("array<string>"))
    heading = F.array(
        F.concat(F.lit("## Table: "), _ticked(F.concat_ws(".", "database_name", "schema_name", "table_name"))), F.lit("")
    )
    facts = F.array(
        F.concat(F.lit("- **Primary key:** "), key_text),
        F.concat(F.lit("- **Row count (estimate):** "), count),
        F.concat(F.lit("- **Sample:** "), F.col("sample_rows_returned").cast("string"), F.lit(" rows"), more),
        F.lit(""), F.lit("### Columns"), F.lit(""), *[F.lit(line) for line in COLUMN_HEADER],
    )
    lines = F.coalesce(F.transform("columns", column_line), F.array().cast("array<string>"))
    return tables.withColumn("markdown", F.array_join(F.concat(heading, comment, facts, lines), "\n"))


def snapshot_heading(source_database: str, n_tables: int) -> str:
    head = f"# Schema snapshot: `{source_database}`\n\nTables: {n_tables}\n"
    return head if n_tables else f"{head}\n{NO_TABLES}"
