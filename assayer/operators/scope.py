"""Scopes: saved selections of schemas and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


class InvalidScope(ValueError):
    pass


def apply_scope(tables: DataFrame, included_schemas: list[str], excluded_tables: DataFrame | list[str] = ()) -> DataFrame:
    """Tables of the included schemas without the excluded ones, given as `schema.table`."""
    kept = tables.where(F.col("schema_name").isin(list(included_schemas)))
    if not isinstance(excluded_tables, DataFrame):
        if not excluded_tables:
            return kept
        return kept.where(~F.concat_ws(".", "schema_name", "table_name").isin(list(excluded_tables)))
    hidden = excluded_tables.toDF("excluded")
    return kept.join(hidden, F.concat_ws(".", "schema_name", "table_name") == F.col("excluded"), "left_anti")


def unknown_schemas(scopes: DataFrame, available: DataFrame) -> DataFrame:
    """(scope_id, schema_name) of every included schema that does not exist; case counts."""
    return scopes.select("scope_id", "schema_name").distinct().join(
        available.select("schema_name").distinct(), "schema_name", "left_anti"
    ).select("scope_id", "schema_name")


def unknown_tables(excluded: DataFrame, tables: DataFrame) -> DataFrame:
    """(scope_id, excluded) of every excluded `schema.table` that does not exist."""
    known = tables.select(F.concat_ws(".", "schema_name", "table_name").alias("excluded")).distinct()
    return excluded.select("scope_id", "excluded").distinct().join(known, "excluded", "left_anti").select("scope_id", "excluded")


def validate_scope(included_schemas: list[str], tables: DataFrame, excluded_tables: list[str] = ()) -> None:
    """Raises with all offenders, not just the first. Works on metadata of one warehouse."""
    if not included_schemas:
        raise InvalidScope("included_schemas must not be empty")
    spark = tables.sparkSession
    wanted = spark.createDataFrame([("scope", s) for s in included_schemas], "scope_id string, schema_name string")
    bad = sorted(r.schema_name for r in unknown_schemas(wanted, tables).collect())
    if bad:
        raise InvalidScope(f"schemas not present in the data source: {bad}")
    if excluded_tables:
        hidden = spark.createDataFrame([("scope", t) for t in excluded_tables], "scope_id string, excluded string")
        lost = sorted(r.excluded for r in unknown_tables(hidden, tables).collect())
        if lost:
            raise InvalidScope(f"excluded tables not present in the data source: {lost}")


def reference_counts(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(key, one count per kind of child, deletable): children are counted before they meet their parent."""
    result = parents.select(key)
    for name, (df, column) in children.items():
        counted = df.groupBy(F.col(column).alias(key)).agg(F.count("*").alias(name))
        result = result.join(counted, key, "left")
    counts = [F.coalesce(F.col(n), F.lit(0)).alias(n) for n in children]
    total = sum((F.coalesce(F.col(n), F.lit(0)) for n in children), F.lit(0))
    return result.select(key, *counts, (total == 0).alias("deletable"))


def newest_first(df: DataFrame, at: str, id_column: str = "id") -> DataFrame:
    return df.orderBy(F.desc(at), id_column)
