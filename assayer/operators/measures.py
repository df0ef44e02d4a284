"""Governed measures evaluated by dimension and time grain."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.cells import quoted
from assayer.functions.dates import relative_difference, truncate
from assayer.operators.lifecycle import resolve_names
from assayer.vocab import AGGREGATIONS, FORMAT_HINTS


class NotApproved(PermissionError):
    pass


@dataclass(frozen=True)
class Measure:
    """`sql_expression` is a complete aggregate such as SUM(amount)."""

    name: str
    aggregation: str
    sql_expression: str
    source_tables: tuple[str, ...]
    filter_expression: str | None = None
    format_hint: str | None = None
    status: str = "proposed"

    def __post_init__(self):
        if self.aggregation not in AGGREGATIONS:
            raise ValueError(f"{self.aggregation!r} is not one of {AGGREGATIONS}")
        if self.format_hint is not None and self.format_hint not in FORMAT_HINTS:
            raise ValueError(f"{self.format_hint!r} is not one of {FORMAT_HINTS}")
        if not self.source_tables:
            raise ValueError("a measure needs at least one source table")


def simple_measure(name: str, aggregation: str, column: str, table: str, **options) -> Measure:
    """The standard expression of every aggregation but `custom`. `column` is a column's name, or * for a count."""
    column = column if column == "*" else quoted(column)
    inner = {"count_distinct": f"COUNT(DISTINCT {column})"}.get(aggregation, f"{aggregation.upper()}({column})")
    return Measure(name, aggregation, inner, (table,), **options)


def require_approved(measures: list[Measure]) -> None:
    pending = [m.name for m in measures if m.status != "approved"]
    if pending:
        raise NotApproved(f"only approved definitions can be queried; not approved: {pending}")


def evaluate(df: DataFrame, measures: list[Measure], dimensions: list[str | Column] = (),
             time: tuple[str, str] | None = None, approved_only: bool = False) -> DataFrame:
    """One grouped aggregation of `df`. `time` is (column, grain); its period is named like the grain.

    A filter shared by all measures becomes a WHERE and reaches the scan. With
    several filters their union is the WHERE and each measure keeps its own as an
    aggregate filter, still one scan. Custom expressions cannot take an aggregate
    filter and get a branch of their own.
    """
    if approved_only:
        require_approved(measures)
    groups = [F.col(d) if isinstance(d, str) else d for d in dimensions]
    if time is not None:
        column, grain = time
        groups.append(truncate(grain, F.col(column)).alias(grain))
    filters = {m.filter_expression for m in measures}
    if len(filters) == 1:
        shared = filters.pop()
        rows = df.where(shared) if shared else df
        return rows.groupBy(*groups).agg(*[F.expr(m.sql_expression).alias(m.name) for m in measures])
    alone = [m for m in measures if m.aggregation == "custom" and m.filter_expression]
    together = [m for m in measures if m not in alone]
    if not alone:
        return _one_scan(df, together, groups)
    parts = ([_one_scan(df, together, groups)] if together else []) + [evaluate(df, [m], groups) for m in alone]
    names = [c for c in parts[0].columns if c not in {m.name for m in measures}]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.groupBy(*names).agg(*[F.max(m.name).alias(m.name) for m in measures])


def _one_scan(df: DataFrame, measures: list[Measure], groups: list[Column]) -> DataFrame:
    filters = [m.filter_expression for m in measures]
    rows = df if None in filters else df.where(" or ".join(f"({f})" for f in dict.fromkeys(filters)))
    aggregates = [
        F.expr(m.sql_expression if m.filter_expression is None else f"{m.sql_expression} FILTER (WHERE {m.filter_expression})").alias(m.name)
        for m in measures
    ]
    return rows.groupBy(*groups).agg(*aggregates)


class MeasureRegistry:
    """Measures by name, as the stored definitions have them when a query is made.

    definitions: id, name, status, approved_at, aggregation, sql_expression, source_tables ARRAY<STRING>,
    filter_expression, format_hint; statuses as the fold of the decision log gives them. Of a name's versions the newest
    approved one counts. A name that has none is refused, whatever the caller says of it.
    """

    def __init__(self, definitions: DataFrame):
        self.definitions = definitions

    def measures(self, names: list[str]) -> list[Measure]:
        chosen = resolve_names(self.definitions.where(F.col("name").isin(names)))
        found = {
            r["name"]: Measure(r["name"], r["aggregation"], r["sql_expression"], tuple(r["source_tables"]), r["filter_expression"],
                               r["format_hint"], r["status"])
            for r in chosen.collect()  # a row per name asked for
        }
        lost = [n for n in names if n not in found]
        if lost:
            raise NotApproved(f"only approved definitions can be queried; not approved or unknown: {lost}")
        return [found[n] for n in names]

    def evaluate(self, df: DataFrame, names: list[str], dimensions: list[str | Column] = (),
                 time: tuple[str, str] | None = None) -> DataFrame:
        """`evaluate` of the measures of these names."""
        return evaluate(df, self.measures(names), dimensions, time, approved_only=True)


def compare_variants(df: DataFrame, base: str, variants: list[str], tolerance: float = 0.0) -> DataFrame:
    """Adds, per variant, its relative difference from `base` and whether the two disagree."""
    for v in variants:
        df = df.withColumn(f"{v}_vs_{base}", relative_difference(F.col(v), F.col(base)))
        df = df.withColumn(
            f"{v}_disagrees", F.abs(F.col(v) - F.col(base)) > F.lit(tolerance)
        )
    return df
