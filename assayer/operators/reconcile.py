"""Figures of several systems set side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.dates import quarter_label, relative_difference

MONEY = "decimal(28,2)"


def receipts(payments: DataFrame, reference: Column, amount: str) -> DataFrame:
    """(reference, n_payments, received, gross, credited): payments per document, grouped before any join."""
    a = F.col(amount).cast("decimal(18,2)")
    zero = F.lit(0).cast("decimal(18,2)")
    return payments.select(reference.alias("reference"), a.alias("a")).where("reference is not null").groupBy("reference").agg(
        F.count("*").alias("n_payments"),
        F.sum("a").cast(MONEY).alias("received"),
        F.sum(F.when(F.col("a") > 0, F.col("a")).otherwise(zero)).cast(MONEY).alias("gross"),
        F.sum(F.when(F.col("a") < 0, F.col("a")).otherwise(zero)).cast(MONEY).alias("credited"),
    )


def settlements(documents: DataFrame, key: str, total: str, paid: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Every document with its receipts, the difference and a status: unpaid, partial, exact or over."""
    docs = documents.select(F.col(key).alias("reference"), F.col(total).cast("decimal(18,2)").alias("total"))
    joined = docs.join(paid, "reference", "left").withColumn(
        "difference", (F.coalesce(F.col("received"), F.lit(0).cast(MONEY)) - F.col("total")).cast(MONEY)
    )
    status = (
        F.when(F.coalesce(F.col("n_payments"), F.lit(0)) == 0, "unpaid")
        .when(F.abs(F.col("difference")) <= tolerance, "exact")
        .when(F.col("difference") < 0, "partial").otherwise("over")
    )
    return joined.withColumn("status", status)


def split_payments(settled: DataFrame) -> DataFrame:
    """Documents settled exactly by more than one incoming payment and no credit."""
    return settled.where("n_payments > 1 and status = 'exact' and credited = 0")


def corrected_payments(settled: DataFrame) -> DataFrame:
    """Documents where the gross receipt was wrong and a credit followed."""
    return settled.where("gross <> total and credited < 0")


def unattributed(transactions: DataFrame, reference: Column, amount: str, documents: DataFrame, key: str,
                 exclude: Column | None = None) -> DataFrame:
    """Negative transactions whose reference is missing or unknown, other than those `exclude` explains."""
    negative = transactions.where(F.col(amount) < 0)
    if exclude is not None:
        negative = negative.where(~F.coalesce(exclude, F.lit(False)))
    known = documents.select(F.col(key).alias("reference")).distinct()
    keyed = negative.withColumn("reference", reference)
    # rows without a reference need no lookup, and would all meet in one task
    lost = keyed.where("reference is not null").join(known, "reference", "left_anti")
    return keyed.where("reference is null").unionByName(lost)


def by_period(df: DataFrame, groups: list[Column], amount: Column, alias: str) -> DataFrame:
    return df.groupBy(*groups).agg(F.sum(amount.cast("decimal(18,2)")).cast(MONEY).alias(alias))


def forecast_vs_actual(forecast: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Two aggregates matched on their keys, either side may miss; `miss` is (forecast - actual) / actual."""
    return forecast.join(actual, keys, "full").withColumn(
        "miss", F.round(relative_difference(F.col("forecast").cast("double"), F.col("actual").cast("double")), 6)
    )


def plan_drift(monthly: DataFrame, month: str, unit: str, amount: str, plan: DataFrame, plan_quarter: str,
               plan_unit: str, planned: str, version: str) -> DataFrame:
    """Months rolled up to quarters against the newest version of the plan for that quarter and unit; either side may miss."""
    rolled = by_period(
        monthly, [quarter_label(F.col(month)).alias("quarter"), F.col(unit).alias("unit")], F.col(amount), "forecast"
    )
    newest = plan.groupBy(F.col(plan_quarter).alias("quarter"), F.col(plan_unit).alias("unit")).agg(
        F.max(version).alias("version"), F.max_by(F.col(planned).cast(MONEY), F.col(version)).alias("planned")
    )
    return rolled.join(newest, ["quarter", "unit"], "full").withColumn(
        "drift", F.round(relative_difference(F.col("planned").cast("double"), F.col("forecast").cast("double")), 6)
    )


def side_by_side(systems: dict[str, DataFrame], keys: list[str], figure: str = "amount") -> DataFrame:
    """One row per entity and period with each system's figure and their spread.

    `systems` are aggregates already; they meet in one grouping, not in a chain of joins.
    """
    stacked = reduce(
        DataFrame.unionByName,
        [df.select(*keys, F.lit(name).alias("system"), F.col(figure).alias("figure")) for name, df in systems.items()],
    )
    columns = [F.sum(F.when(F.col("system") == s, F.col("figure"))).cast(MONEY).alias(s) for s in systems]
    wide = stacked.groupBy(*keys).agg(*columns, F.count_distinct("system").alias("n_systems"))
    if len(systems) == 1:
        return wide.withColumn("spread", F.lit(0).cast(MONEY))
    names = list(systems)
    return wide.withColumn("spread", (F.greatest(*names) - F.least(*names)).cast(MONEY))
