"""Rule-based proposals from a profile of the whole warehouse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.names import quoted_name
from assayer.operators.components import components

MEASURE_AGGREGATIONS = ["sum", "avg", "min", "max"]


def base_name(column: Column) -> Column:
    """Column name without a one- or two-letter table prefix (`o_custkey` is `custkey`)."""
    return F.regexp_replace(column, "^[a-z]{1,2}_", "")


COVERED = 0.9  # share of a key's values that shows by itself that a column refers to it


def confidence(ratio: Column, coverage: Column, names_agree: Column) -> Column:
    """How sure a link is: high where the values show it, medium where names and types suggest it, else low.

    That all values of a column lie in a key shows little by itself, as any small number lies in a dense key. It counts
    if the names agree as well, or if the values cover nearly the whole key.
    """
    shown = (ratio >= 1.0) & (names_agree | (coverage >= COVERED))
    return F.when(shown, "high").when(names_agree, "medium").otherwise("low")


def measures(profiles: DataFrame) -> DataFrame:
    """Aggregations of numeric non-key columns, distinct counts of keys, and a row count per table."""
    numeric = profiles.where("normalized_type = 'numeric' and not is_key").select(
        "table_name", "column_name", F.explode(F.array(*[F.lit(a) for a in MEASURE_AGGREGATIONS])).alias("aggregation")
    ).withColumn("sql_expression", F.concat(F.upper("aggregation"), F.lit("("), quoted_name(F.col("column_name")), F.lit(")")))
    keys = profiles.where("is_key and normalized_type in ('integer', 'string')").select(
        "table_name", "column_name", F.lit("count_distinct").alias("aggregation"),
        F.concat(F.lit("COUNT(DISTINCT "), quoted_name(F.col("column_name")), F.lit(")")).alias("sql_expression"),
    )
    rows = profiles.select("table_name").distinct().select(
        "table_name", F.lit(None).cast("string").alias("column_name"), F.lit("count").alias("aggregation"),
        F.lit("COUNT(*)").alias("sql_expression"),
    )
    named = numeric.unionByName(keys).unionByName(rows)
    return named.withColumn("name", F.lower(F.concat_ws("_", "table_name", F.coalesce("column_name", F.lit("rows")), "aggregation")))


def dimensions(profiles: DataFrame) -> DataFrame:
    """Non-key text, boolean and integer columns with few distinct values."""
    return profiles.where(
        "not is_key and n_distinct > 0 and normalized_type in ('string', 'boolean', 'integer') and cardinality in ('low', 'medium')"
    ).select("table_name", "column_name", F.col("cardinality").alias("cardinality_hint"), "n_distinct")


def time_dimensions(profiles: DataFrame, grains: DataFrame) -> DataFrame:
    return profiles.where("normalized_type in ('date', 'timestamp')").join(grains, ["table_name", "column_name"]).select(
        "table_name", "column_name", F.col("grain").alias("granularity_hint")
    )


RELATIONSHIP = "from_table string, from_column string, to_table string, to_column string, relationship_type string, confidence string"


def exact_relationships(inclusions: DataFrame) -> DataFrame:
    agree = base_name(F.col("from_column")) == base_name(F.col("to_column"))
    return inclusions.select(
        "from_table", "from_column", "to_table", "to_column", F.lit("exact_match").alias("relationship_type"),
        confidence(F.col("containment"), F.col("coverage"), agree).alias("confidence"),
    )


def relationships(*kinds: DataFrame) -> DataFrame:
    """Relationship proposals of all kinds in one table."""
    names = [c.split()[0] for c in RELATIONSHIP.split(", ")]
    return reduce(DataFrame.unionByName, [k.select(*names) for k in kinds])


def quality_flags(*flags: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), flags)


def entity_groups(edges: DataFrame) -> DataFrame:
    """(column, entity): columns connected by relationship edges, named after their smallest column.

    edges: from_table, from_column, to_table, to_column. Nodes are columns, so the graph is metadata-sized.
    """
    ends = edges.select(F.concat_ws(".", "from_table", "from_column").alias("a"), F.concat_ws(".", "to_table", "to_column").alias("b"))
    return components(ends).select(F.col("node").alias("column"), F.col("root").alias("entity"))


def entities(edges: DataFrame) -> DataFrame:
    """Entity proposals in the contract's shape: one per connected group of columns.

    edges: from_table, from_column, to_table, to_column, evidence (what shows the link), confidence
    """
    groups = entity_groups(edges)
    members = groups.groupBy("entity").agg(F.sort_array(F.collect_list("column")).alias("members"))
    source = F.concat_ws(".", "from_table", "from_column")
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    shown = edges.select(source.alias("column"), "evidence", rank.alias("rank")).join(groups, "column").groupBy("entity").agg(
        F.sort_array(F.collect_set("evidence")).alias("evidence"), F.max("rank").alias("rank"))
    name = F.regexp_replace(base_name(F.element_at(F.split("entity", r"\."), -1)), "_?(key|id)$", "")
    plain = F.when(name == "", F.regexp_replace("entity", r"\.", "_")).otherwise(name)
    columns = F.array_join("members", ", ")
    return members.join(shown, "entity").select(
        plain.alias("name"), F.initcap(F.replace(plain, F.lit("_"), F.lit(" "))).alias("display_name"),
        F.concat(F.lit("What "), columns, F.lit(" refer to.")).alias("description"),
        F.transform("members", lambda m: F.struct(
            F.regexp_replace(m, r"\.[^.]*$", "").alias("table"), F.element_at(F.split(m, r"\."), -1).alias("column"))).alias("source_columns"),
        F.lit("The values of these columns are found in one another.").alias("rationale"), "evidence",
        F.when(F.col("rank") == 3, "high").when(F.col("rank") == 2, "medium").otherwise("low").alias("confidence"),
    )


def summary(kinds: dict[str, DataFrame]) -> DataFrame:
    """(kind, n) per proposal kind and for all together."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in kinds.items()]
    counted = reduce(DataFrame.unionByName, parts)
    return counted.unionByName(counted.agg(F.sum("n").alias("n")).select(F.lit("total").alias("kind"), "n"))
