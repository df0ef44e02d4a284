"""Groups with hot keys, as plain joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SALTS = 64  # one bit each of a 64-bit mask


def by_place(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """The table with its columns named c0, c1, ... and the new names of some of them, so that no name of a user's column
    clashes with one of an operator's own. `toDF(*docs.columns)` gives the names back."""
    lowered = [c.lower() for c in docs.columns]
    plain = docs.toDF(*[f"c{i}" for i in range(len(lowered))])
    return plain, [f"c{docs.columns.index(n) if n in docs.columns else lowered.index(n.lower())}" for n in names]


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def salt_of(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def salted_totals(rows: DataFrame, keys: list[str], least: list[Column], salt: str = "_salt") -> DataFrame:
    """Per group: `hubs` (the least value of each of `least`), `n` (rows), and `_mask` (the salts that occur).

    Grouped by salt first, so a hot key is combined in parts.
    """
    parts = rows.groupBy(*keys, salt).agg(
        F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(f"_hub{i}") for i, c in enumerate(least)])
    return parts.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.bit_or(F.expr(f"shiftleft(1L, {salt})")).alias("_mask"),
        F.array(*[F.min(f"_hub{i}") for i in range(len(least))]).alias("hubs"))


def by_salt(totals: DataFrame, salt: str = "_salt") -> DataFrame:
    """One row per group and salt that occurs in it, for joins on key and salt."""
    bits = F.expr(f"filter(sequence(0, {SALTS - 1}), s -> (shiftright(_mask, s) & 1L) = 1L)")
    return totals.withColumn(salt, F.explode(bits)).drop("_mask")
