"""Row samples and what one column of a sample shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.cells import comparable_text, literal, quoted
from assayer.functions.types import normalize_spark
from assayer.vocab import DEFAULT_SAMPLE_ROWS


def sample_rows(df: DataFrame, limit: int, key: Column | None = None, seed: int | None = None,
                fraction: float | None = None) -> DataFrame:
    """`limit` whole rows in random order, repeatable when `key` is given.

    Every partition keeps its own best `limit` rows, so one small merge is all
    that moves. `fraction` thins the scan first where any sample will do.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    if fraction is not None:
        df = df.sample(fraction=fraction, seed=seed)
    order = F.md5(key.cast("string")) if key is not None else F.rand(seed)
    return df.orderBy(order).limit(limit)


def has_more_rows(df: DataFrame, returned: int) -> DataFrame:
    """One row, one flag: whether `df` goes on after `returned` rows. Reads no further than it must."""
    probe = df.select(F.lit(1).alias("one")).offset(returned).limit(1)
    return probe.agg((F.count("*") > 0).alias("truncated"))


def long_form(df: DataFrame, columns: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """(…keep, column_name, normalized_type, value): one row per cell, values as comparable text."""
    names = columns or [c for c in df.columns if c not in (keep or [])]
    cells = ", ".join(
        f"struct({literal(c)} as column_name, '{normalize_spark(df.schema[c].dataType)}' as normalized_type, "
        f"{comparable_text(c, df.schema[c].dataType)} as value)"
        for c in names
    )
    return df.selectExpr(*[quoted(k) for k in keep or []], f"inline(array({cells}))")


def column_samples(cells: DataFrame, position: str, max_values: int = DEFAULT_SAMPLE_ROWS,
                   by: list[str] = ("column_name",)) -> DataFrame:
    """First values per column in row order with NULLs kept, and the distinct count over all given rows.

    `cells` is the long form of a sample, so a column has no more rows than the
    sample. NULL counts as one value of its own.
    """
    pairs = F.array_sort(F.collect_list(F.struct(position, "value")))
    grouped = cells.groupBy(*by).agg(pairs.alias("pairs"), distinct_with_null(F.col("value")).alias("distinct_sample_count"))
    return grouped.select(
        *by, F.transform(F.slice("pairs", 1, max_values), lambda p: p["value"]).alias("sample_values"), "distinct_sample_count"
    )


def distinct_with_null(value: Column) -> Column:
    return F.count_distinct(value) + F.max(F.when(value.isNull(), 1).otherwise(0))
