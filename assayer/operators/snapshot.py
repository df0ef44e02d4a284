"""Structural comparison of schema snapshots, for one snapshot or for whole histories at once.

Inputs are long tables. `by` names the columns that tell snapshots apart, such as
`snapshot_id`; every function works on all snapshots in one plan.
columns: by…, database_name, schema_name, table_name, column_name, normalized_type,
         native_type, is_nullable, ordinal_position [, is_key]
keys:    by…, database_name, schema_name, table_name, column_name   (primary-key columns,
         where `is_key` is not a column already)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TABLE = ["database_name", "schema_name", "table_name"]


def _line(kind: str, *parts: str) -> Column:
    """Parts as a JSON array, so that no dot, bar or NULL of one part can pass for another part."""
    return F.to_json(F.array(F.lit(kind), *[F.col(p).cast("string") for p in parts]))


def signatures(columns: DataFrame, keys: DataFrame | None, by: list[str], tables: DataFrame | None = None) -> DataFrame:
    """(by…, signature): one distinct line per column and per key column, plus tables without columns.

    Samples, row counts and comments play no part, nor does the order of rows.
    """
    line = _line("column", *TABLE, "column_name", "normalized_type", "native_type", "is_nullable", "ordinal_position")
    key = _line("key", *TABLE, "column_name")
    if "is_key" in columns.columns:
        key_line = F.when(F.col("is_key"), key)
        parts = columns.select(*by, F.explode(F.array_compact(F.array(line, key_line))).alias("signature"))
    else:
        parts = columns.select(*by, line.alias("signature"))
    if keys is not None:
        parts = parts.unionByName(keys.select(*by, key.alias("signature")))
    if tables is not None:
        parts = parts.unionByName(tables.select(*by, _line("table", *TABLE).alias("signature")))
    return parts.distinct()


def fingerprints(signed: DataFrame, by: list[str]) -> DataFrame:
    """(by…, fingerprint): equal exactly when the signature sets are equal, up to MD5 collisions.

    Sums of digest words do not depend on order, so nothing is sorted or
    collected and a snapshot of any size is combined task by task.
    """
    digest = F.md5("signature")
    words = [
        F.sum(F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")).alias(f"w{start}")
        for start in (1, 9, 17, 25)
    ]
    return signed.groupBy(*by).agg(F.count("*").alias("n"), *words).select(
        *by, F.concat_ws("-", *[F.col(c).cast("string") for c in ("n", "w1", "w9", "w17", "w25")]).alias("fingerprint")
    )


def sides(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two relations as one, told apart by `side`."""
    return old.withColumn("side", F.lit("old")).unionByName(new.withColumn("side", F.lit("new")))


def structural_difference(both: DataFrame, by: list[str]) -> DataFrame:
    """(by…, signature, only_in): lines of one side missing on the other; empty means equivalent.

    both: by…, signature, side
    """
    merged = both.groupBy(*by, "signature").agg(
        F.bool_or(F.col("side") == "old").alias("in_old"), F.bool_or(F.col("side") == "new").alias("in_new")
    )
    return merged.where("in_old <> in_new").select(
        *by, "signature", F.when(F.col("in_old"), "old").otherwise("new").alias("only_in")
    )


def are_equivalent(a: DataFrame, b: DataFrame, database_a: str, database_b: str) -> bool:
    """Whole-snapshot check for two inventories' signatures."""
    return database_a == database_b and structural_difference(sides(a, b), []).isEmpty()


ATTRIBUTES = ["normalized_type", "native_type", "is_nullable", "ordinal_position", "is_key"]


def with_keys(columns: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """Marks key columns with `is_key`."""
    place = by + TABLE + ["column_name"]
    marked = keys.select(*place, F.lit(True).alias("is_key")).distinct()
    return columns.join(marked, place, "left").withColumn("is_key", F.coalesce("is_key", F.lit(False)))


def schema_diff(both: DataFrame, by: list[str]) -> DataFrame:
    """(by…, schema_name, table_name, column_name, change): what happened from side `old` to side `new`.

    both: columns of both snapshots with `side`. A table on one side only gives one
    row without a column. All rows move once, by table: the columns of a table are
    matched, and its presence judged, in place.
    """
    place = by + ["schema_name", "table_name"]
    full = both if "is_key" in both.columns else both.withColumn("is_key", F.lit(False))
    moved = full.select(*place, "column_name", "side", *ATTRIBUTES).repartition(*place)

    def of(name: str, value: str) -> Column:
        return F.max(F.when(F.col("side") == name, F.col(value))).alias(f"{name}_{value}")

    cells = moved.groupBy(*place, "column_name").agg(*[of(s, v) for s in ("old", "new") for v in ATTRIBUTES])
    in_old, in_new = F.col("old_ordinal_position").isNotNull(), F.col("new_ordinal_position").isNotNull()
    table = Window.partitionBy(*place)  # as many rows as the table has columns
    judged = cells.withColumns({
        "table_in_old": F.max(in_old).over(table), "table_in_new": F.max(in_new).over(table),
        "first_column": F.min("column_name").over(table),
    })
    shared, kept = F.col("table_in_old") & F.col("table_in_new"), in_old & in_new
    speaks = F.col("column_name") == F.col("first_column")

    def differs(value: str) -> Column:
        return kept & ~F.col(f"old_{value}").eqNullSafe(F.col(f"new_{value}"))

    changes = F.array_compact(
        F.array(
            F.when(~shared & speaks, F.when(F.col("table_in_new"), "table_added").otherwise("table_removed")),
            F.when(shared & ~in_old, "column_added"),
            F.when(shared & ~in_new, "column_removed"),
            F.when(differs("normalized_type") | differs("native_type"), "type_changed"),
            F.when(differs("is_nullable"), "nullability_changed"),
            F.when(differs("ordinal_position"), "moved"),
            F.when(differs("is_key"), "key_changed"),
        )
    )
    found = judged.select(*place, "column_name", F.explode(changes).alias("change"))
    return found.withColumn("column_name", F.when(~F.col("change").startswith("table_"), F.col("column_name")))


def latest(snapshots: DataFrame, partition: str = "source_database", at: str = "captured_at", id_column: str = "id",
           n: int = 1) -> DataFrame:
    """The newest `n` snapshots per source with their age rank, ties by id.

    Each task keeps only `n` per source before the shuffle.
    """
    order = Window.partitionBy(partition).orderBy(F.desc(at), id_column)
    return snapshots.withColumn("age_rank", F.row_number().over(order)).where(F.col("age_rank") <= n)


def latest_with_version(snapshots: DataFrame, definitions: DataFrame) -> DataFrame:
    """Newest snapshot per source with the rule-set version of any definition made from it (NULL if none)."""
    versions = definitions.groupBy("source_snapshot_id").agg(F.max("prompt_version").alias("prompt_version"))
    newest = latest(snapshots).drop("age_rank")
    return newest.join(versions, newest["id"] == versions["source_snapshot_id"], "left").drop("source_snapshot_id")


def skip_decisions(current: DataFrame, previous: DataFrame, version: str | Column) -> DataFrame:
    """Whether each source may skip this run: same structure and same rule set as its last snapshot.

    current:  source_database, fingerprint
    previous: source_database, id, captured_at, fingerprint, prompt_version
    """
    wanted = F.lit(version) if isinstance(version, str) else version
    joined = current.alias("c").join(previous.alias("p"), F.col("c.source_database") == F.col("p.source_database"), "left")
    skip = F.coalesce(
        (F.col("c.fingerprint") == F.col("p.fingerprint")) & (F.col("p.prompt_version") == wanted), F.lit(False)
    )
    return joined.select(
        F.col("c.source_database").alias("source_database"),
        skip.alias("skip"),
        F.when(skip, F.col("p.id")).alias("last_snapshot_id"),
        F.when(skip, F.col("p.captured_at")).alias("last_captured_at"),
    )


COMPATIBILITY = ["compatible", "needs_review", "broken"]


def compatibility(links: DataFrame, new_columns: DataFrame, by: list[str]) -> DataFrame:
    """(by…, definition_id, compatibility): every definition against the newest snapshot, worst column decides.

    links: by…, definition_id, schema_name, table_name, column_name, normalized_type as captured
    """
    place = by + ["schema_name", "table_name", "column_name"]
    now = new_columns.select(*place, F.col("normalized_type").alias("new_type"))
    rank = F.when(F.col("new_type").isNull(), 2).when(F.col("new_type") != F.col("normalized_type"), 1).otherwise(0)
    worst = links.join(now, place, "left").groupBy(*by, "definition_id").agg(F.max(rank).alias("worst"))
    names = F.array(*[F.lit(c) for c in COMPATIBILITY])
    return worst.select(*by, "definition_id", F.element_at(names, F.col("worst") + 1).alias("compatibility"))
