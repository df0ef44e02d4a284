"""Strict reading of proposal sets and grounding of what they refer to, in bulk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer import vocab
from assayer.functions.names import split_qualified
from assayer.functions.text import json_body

# The fields of each proposal kind with their form.
REQUIRED_FIELDS = {
    "entities": {
        "name": "text", "display_name": "text", "description": "text", "source_columns": "colrefs", "rationale": "text",
        "confidence": "confidence",
    },
    "measures": {
        "name": "text", "display_name": "text", "description": "text", "aggregation": "aggregation", "sql_expression": "text",
        "source_tables": "some_texts", "rationale": "text", "confidence": "confidence",
    },
    "dimensions": {
        "name": "text", "display_name": "text", "description": "text", "source_column": "colref",
        "cardinality_hint": "cardinality", "rationale": "text", "confidence": "confidence",
    },
    "time_dimensions": {
        "name": "text", "display_name": "text", "description": "text", "source_column": "colref",
        "granularity_hint": "granularity", "rationale": "text", "confidence": "confidence",
    },
    "relationships": {
        "name": "text", "display_name": "text", "description": "text", "from_table": "text", "from_column": "text",
        "relationship_type": "relationship", "rationale": "text", "confidence": "confidence",
    },
    "data_quality_flags": {"severity": "severity", "title": "text", "description": "text", "rationale": "text"},
}
OPTIONAL_FIELDS = {
    "entities": {"evidence": "texts"},
    "measures": {"filter_expression": "maybe_text", "format_hint": "maybe_format", "evidence": "texts", "caveats": "texts"},
    "dimensions": {"sample_values": "samples", "evidence": "texts"},
    "time_dimensions": {"evidence": "texts"},
    "relationships": {"to_table": "maybe_text", "to_column": "maybe_text", "evidence": "texts"},
    "data_quality_flags": {"affected_columns": "any_colrefs", "evidence": "texts"},
}
KINDS = list(REQUIRED_FIELDS)
ENUMS = {
    "confidence": vocab.CONFIDENCES, "severity": vocab.SEVERITIES, "aggregation": vocab.AGGREGATIONS,
    "cardinality": vocab.CARDINALITIES, "granularity": vocab.GRANULARITIES,
    "relationship": vocab.RELATIONSHIP_TYPES, "maybe_format": vocab.FORMAT_HINTS,
}
MAX_SAMPLES = 10
ERROR_EXCERPT = 500


def _has_form(value: str, form: str) -> str:
    """SQL predicate: the variant `value` has the form."""
    kind = f"schema_of_variant({value})"
    text = f"variant_get({value}, '$', 'string')"
    items = f"try_variant_get({value}, '$', 'array<variant>')"
    colref = "'OBJECT<column: STRING, table: STRING>'"
    if form in ENUMS:
        allowed = ", ".join(f"'{v}'" for v in ENUMS[form])
        member = f"({kind} = 'STRING' and {text} in ({allowed}))"
        return f"({kind} = 'VOID' or {member})" if form.startswith("maybe") else member
    return {
        "text": f"{kind} = 'STRING'",
        "maybe_text": f"{kind} in ('STRING', 'VOID')",
        "texts": f"{kind} in ('ARRAY<STRING>', 'ARRAY<VOID>') and forall({items}, e -> schema_of_variant(e) = 'STRING')",
        "some_texts": f"{kind} = 'ARRAY<STRING>' and forall({items}, e -> schema_of_variant(e) = 'STRING')",
        "colref": f"{kind} = {colref}",
        "colrefs": f"{items} is not null and size({items}) >= 1 and forall({items}, e -> schema_of_variant(e) = {colref})",
        "any_colrefs": f"{items} is not null and forall({items}, e -> schema_of_variant(e) = {colref})",
        "samples": f"{items} is not null and size({items}) <= {MAX_SAMPLES} "
                   f"and forall({items}, e -> not schema_of_variant(e) rlike '^(OBJECT|ARRAY)')",
    }[form]


def _item_error(kind: str) -> Column:
    """First thing wrong with one item (a MAP<STRING,VARIANT> named `item`), or NULL."""
    fields = REQUIRED_FIELDS[kind] | OPTIONAL_FIELDS[kind]
    known = ", ".join(f"'{f}'" for f in fields)
    required = ", ".join(f"'{f}'" for f in REQUIRED_FIELDS[kind])
    error = F.when(F.col("item").isNull(), "not an object")
    error = error.when(F.expr(f"size(array_except(map_keys(item), array({known}))) > 0"), "unknown field")
    error = error.when(F.expr(f"size(array_except(array({required}), map_keys(item))) > 0"), "missing field")
    for name, form in fields.items():
        cell = f"item['{name}']"
        error = error.when(
            F.expr(f"map_contains_key(item, '{name}') and not coalesce({_has_form(cell, form)}, false)"), f"bad {name}"
        )
    if kind == "relationships":
        def is_set(side):
            return f"coalesce(schema_of_variant(item['{side}']) = 'STRING', false)"

        error = error.when(F.expr(f"{is_set('to_table')} <> {is_set('to_column')}"), "one target side only").when(
            F.expr(f"not {is_set('to_table')} and variant_get(item['relationship_type'], '$', 'string') <> 'unlinked_dimension'"),
            "target needed",
        )
    return error


def parse_responses(responses: DataFrame, id_column: str = "id", text: str = "text") -> DataFrame:
    """(id, kind, item_index, item, error): every item of every response, with what is wrong with it.

    A response that is no object, or has an unknown or non-array key, gives one row
    with kind and item NULL; one without any items gives such a row with no error.
    Wrapping the body in brackets first makes trailing junk a parse error. Every
    text is parsed once.
    """
    body = json_body(F.col(text))
    whole = F.expr("try_variant_get(try_parse_json(concat('[', __body, ']')), '$', 'array<map<string,variant>>')")
    parsed = responses.select(F.col(id_column).alias("id"), body.alias("__body")).withColumn("__all", whole).select(
        "id", "__body", F.when(F.size("__all") == 1, F.element_at("__all", 1)).alias("set")
    )
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    not_arrays = "exists(map_values(set), v -> not schema_of_variant(v) like 'ARRAY<%')"
    broken = (
        F.when(F.col("set").isNull(), "not a JSON object")
        .when(F.expr(f"size(array_except(map_keys(set), array({kinds}))) > 0"), "unknown field")
        .when(F.expr(not_arrays), "kind is not an array")
    )
    judged = parsed.select("id", "set", F.concat(broken, F.lit(": "), F.substring("__body", 1, ERROR_EXCERPT)).alias("broken"))
    # kinds without items are dropped, so that an empty response keeps exactly one row
    filled = F.expr("map_filter(set, (k, v) -> schema_of_variant(v) <> 'ARRAY<VOID>')")
    lists = judged.select("id", "broken", F.explode_outer(F.when(F.col("broken").isNull(), filled)).alias("kind", "list"))
    items = lists.select(
        "id", "broken", "kind", F.posexplode_outer(F.expr("try_variant_get(list, '$', 'array<variant>')")).alias("item_index", "raw")
    ).select("id", "broken", "kind", "item_index", F.expr("try_variant_get(raw, '$', 'map<string,variant>')").alias("item"))
    error = F.when(F.col("broken").isNotNull(), F.col("broken"))
    for kind in KINDS:
        error = error.when(F.col("kind") == kind, _item_error(kind))
    return items.select("id", "kind", "item_index", "item", error.alias("error"))


def response_summary(items: DataFrame) -> DataFrame:
    """(id, valid, first_error, n_items and one count per kind). One bad item rejects its whole response.

    The first error is that of the first kind in the contract's order, and there of the first item.
    """
    place = F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).alias("kind"), "item_index")
    first = F.min_by("error", F.when(F.col("error").isNotNull(), place))
    return items.groupBy("id").agg(
        (F.count("error") == 0).alias("valid"), first.alias("first_error"), F.count("kind").alias("n_items"),
        *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in KINDS],
    )


# ---- checks on proposals that are already columns ----

def enum_reason(allowed: dict[str, list[str]]) -> Column:
    """First column holding a value outside its vocabulary (NULL included), or NULL."""
    reason = F.when(F.lit(False), F.lit(None).cast("string"))
    for column, values in allowed.items():
        reason = reason.when(~F.coalesce(F.col(column).isin(values), F.lit(False)), f"bad {column}")
    return reason


def target_reason(kind: str = "relationship_type", table: str = "to_table", column: str = "to_column") -> Column:
    """Both target sides or neither; neither only for an unlinked dimension."""
    t, c = F.col(table).isNotNull(), F.col(column).isNotNull()
    return F.when(t != c, "one target side only").when(
        ~t & (F.col(kind) != "unlinked_dimension"), "target needed"
    )


def size_reason(column: str, least: int | None = None, most: int | None = None) -> Column:
    n = F.coalesce(F.size(F.col(column)), F.lit(0))
    reason = F.when(F.lit(False), F.lit(None).cast("string"))
    if least is not None:
        reason = reason.when(n < least, f"{column} needs at least {least}")
    if most is not None:
        reason = reason.when(n > most, f"{column} takes at most {most}")
    return reason


def quarantine(df: DataFrame, *reasons: Column) -> tuple[DataFrame, DataFrame]:
    """(clean rows, rejected rows with their first `reason`)"""
    checked = df.withColumn("reason", F.coalesce(*reasons))
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")


def confidence_rank(confidence: Column) -> Column:
    return F.when(confidence == "high", 3).when(confidence == "medium", 2).when(confidence == "low", 1)


# ---- references to captured columns ----

class UngroundedReference(LookupError):
    pass


def resolve_columns(references: DataFrame, snapshot_columns: DataFrame) -> DataFrame:
    """References (snapshot_id, table, column_name) with the column_id they mean, NULL where there is none.

    `table` is `schema.table` or `database.schema.table`; the database part and
    nothing else is ignored, and case counts.
    """
    schema, name = split_qualified(F.col("table"))
    placed = references.withColumn("schema_name", schema).withColumn("table_name", name)
    known = snapshot_columns.select("snapshot_id", "schema_name", "table_name", "column_name", "column_id")
    found = placed.where("table_name is not null").join(
        known, ["snapshot_id", "schema_name", "table_name", "column_name"], "left"
    )
    # names of another shape cannot resolve, and would all meet in one task
    shapeless = placed.where("table_name is null").withColumn("column_id", F.lit(None).cast(known.schema["column_id"].dataType))
    return found.unionByName(shapeless)


def ground(references: DataFrame, snapshot_columns: DataFrame, mode: str = "raise") -> tuple[DataFrame, DataFrame]:
    """(resolved, unresolved). `raise` refuses the whole batch if anything is unresolved; `quarantine` keeps both."""
    if mode not in ("raise", "quarantine"):
        raise ValueError("mode is 'raise' or 'quarantine'")
    resolved = resolve_columns(references, snapshot_columns)
    lost = resolved.where("column_id is null").drop("column_id")
    if mode == "raise":
        first = lost.select("table", "column_name").head(1)
        if first:
            raise UngroundedReference(f"no such column in the snapshot: {first[0].table}.{first[0].column_name}")
    return resolved.where("column_id is not null"), lost


def hydrate(definitions: DataFrame, links: DataFrame, columns: DataFrame, tables: DataFrame) -> DataFrame:
    """(definition columns, table as `schema.table`, column): lineage, one row per source column."""
    return (
        definitions.join(links, definitions["id"] == links["entity_id"]).drop(links["id"])
        .join(columns.select(F.col("id").alias("snapshot_column_id"), "table_id", "column_name"), "snapshot_column_id")
        .join(tables.select(F.col("id").alias("table_id"), "schema_name", "table_name"), "table_id")
        .withColumn("table", F.concat_ws(".", "schema_name", "table_name"))
        .withColumnRenamed("column_name", "column")
    )
