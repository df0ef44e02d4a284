"""From a source to a stored snapshot, skipping when nothing changed."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer.operators import snapshot as snapshots
from assayer.operators.scope import apply_scope, validate_scope
from assayer.sources import inventory, sampling, store
from assayer.sources.readers import Source, TableRef
from assayer.vocab import DEFAULT_SAMPLE_ROWS, RULESET_VERSION


@dataclass(frozen=True)
class Captured:
    source_database: str
    tables: DataFrame
    columns: DataFrame


@dataclass(frozen=True)
class Outcome:
    skipped: bool
    snapshot_id: str | None
    captured_at: datetime | None
    n_tables: int
    n_columns: int


def _sampled_cells(ref: TableRef, df: DataFrame, limit: int, key: Column | None) -> DataFrame:
    """Cells of a sample of one table, numbered in sample order: the sample leaves one task sorted."""
    placed = sampling.sample_rows(df, limit, key).withColumn("__pos", F.monotonically_increasing_id())
    names = [F.lit(ref.schema).alias("schema_name"), F.lit(ref.name).alias("table_name")]
    return sampling.long_form(placed, keep=["__pos"]).select(*names, "column_name", "value", "__pos")


def capture(spark: SparkSession, source: Source, sample_limit: int = DEFAULT_SAMPLE_ROWS,
            sample_key: Callable[[TableRef], Column] | None = None) -> Captured:
    """Inventory, exact row counts and samples of every table in one plan; no tables give an empty capture."""
    columns = inventory.column_inventory(spark, source)
    counts = inventory.row_counts(spark, source).drop("is_estimate").withColumnRenamed("row_count", "row_count_estimate")
    tables = (
        inventory.table_inventory(spark, source)
        .join(counts, ["database_name", "schema_name", "table_name"])
        .join(inventory.primary_keys(spark, source), ["schema_name", "table_name"], "left")
        .withColumn("primary_key_columns", F.coalesce("primary_key_columns", F.array().cast("array<string>")))
        .withColumn("sample_rows_returned", F.least(F.col("row_count_estimate"), F.lit(sample_limit)))
        .withColumn("sample_truncated", F.col("row_count_estimate") > sample_limit)
    )
    if not source.tables:
        empty = spark.createDataFrame([], "column_name string, sample_values array<string>, distinct_sample_count bigint, table_name string, schema_name string")
        sampled = empty
    else:
        cells = reduce(DataFrame.unionByName, [
            _sampled_cells(t, source.read(t), sample_limit, sample_key(t) if sample_key else None) for t in source.tables
        ])
        sampled = sampling.column_samples(cells, "__pos", sample_limit, ["schema_name", "table_name", "column_name"])
    described = columns.join(sampled, ["schema_name", "table_name", "column_name"], "left").withColumn(
        "distinct_sample_count", F.coalesce("distinct_sample_count", F.lit(0))
    ).withColumn("sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))
    return Captured(source.database if source.tables else "", tables, described)


def within_scope(spark: SparkSession, source: Source, included_schemas: list[str], excluded_tables: list[str] = ()) -> Source:
    """The source reduced to a saved scope; names that do not exist are an error."""
    listed = inventory.table_inventory(spark, source)
    validate_scope(included_schemas, listed, excluded_tables)
    kept = apply_scope(listed, included_schemas, list(excluded_tables)).select("schema_name", "table_name")
    names = {tuple(r) for r in kept.collect()}
    return replace(source, tables=[t for t in source.tables if (t.schema, t.name) in names])


def structure(spark: SparkSession, source: Source) -> str:
    """Fingerprint of a source. Needs metadata only, so skipping costs no scan."""
    columns = inventory.column_inventory(spark, source)
    keys = inventory.primary_keys(spark, source).select(
        F.lit(source.database).alias("database_name"), "schema_name", "table_name", F.explode("primary_key_columns").alias("column_name")
    )
    signed = snapshots.signatures(columns, keys, [], inventory.table_inventory(spark, source))
    return snapshots.fingerprints(signed, []).first()["fingerprint"]


def ingest(spark: SparkSession, source: Source, root: str, scope_id: str | None = None,
           sample_limit: int = DEFAULT_SAMPLE_ROWS, rule_version: str = RULESET_VERSION) -> Outcome:
    """Store a new snapshot unless the last one of this source has the same structure and rule set.

    Where the source lists its files, an unchanged list tells by itself that the structure is that of the last run; no
    job runs then. If the list has changed, footers tell the structure.
    """
    database = source.database if source.tables else ""
    listing = source.listing()
    noted = store.read_mark(spark, root, database) if listing else None
    known = {"listing": listing, "rule_version": rule_version, "scope_id": scope_id}
    if noted and all(noted.get(k) == v for k, v in known.items()):
        return Outcome(True, noted["snapshot_id"], datetime.fromisoformat(noted["captured_at"]), 0, 0)

    def note(snapshot_id: str, captured_at: datetime) -> None:
        if listing:
            store.write_mark(spark, root, database, {**known, "snapshot_id": snapshot_id, "captured_at": captured_at.isoformat()})

    mark = structure(spark, source)
    try:
        stored = store.read_table(spark, root, "schema_snapshots", store.SNAPSHOTS_DDL)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = spark.createDataFrame([], store.SNAPSHOTS_DDL)
    current = spark.createDataFrame([(database, mark)], "source_database string, fingerprint string")
    previous = snapshots.latest(stored.where(F.col("source_database") == database)).withColumnRenamed("rule_version", "prompt_version")
    decision = snapshots.skip_decisions(current, previous, rule_version).first()
    if decision["skip"]:
        note(decision["last_snapshot_id"], decision["last_captured_at"])
        return Outcome(True, decision["last_snapshot_id"], decision["last_captured_at"], 0, 0)
    captured = capture(spark, source, sample_limit)
    snapshot_id, now = str(uuid.uuid4()), datetime.now(timezone.utc).replace(tzinfo=None)
    head = spark.createDataFrame([(snapshot_id, now, database, scope_id, rule_version, mark)], store.SNAPSHOTS_DDL)
    store.persist_snapshots(
        root, head, captured.tables.withColumn("snapshot_id", F.lit(snapshot_id)),
        captured.columns.withColumn("snapshot_id", F.lit(snapshot_id)),
    )
    note(snapshot_id, now)
    n_columns = inventory.column_inventory(spark, source).count()
    return Outcome(False, snapshot_id, now, len(source.tables), n_columns)
