"""Periods and ratios."""

from pyspark.sql import Column, functions as F

from assayer.vocab import GRANULARITIES


def truncate(grain: str, when: Column) -> Column:
    if grain not in GRANULARITIES:
        raise ValueError(f"grain must be one of {GRANULARITIES}, not {grain!r}")
    return F.date_trunc(grain, when).cast("date")


def quarter_label(when: Column) -> Column:
    return F.concat(F.year(when).cast("string"), F.lit("-Q"), F.quarter(when).cast("string"))


def annualise(amount: Column, months: Column) -> Column:
    return F.try_divide(amount * 12, months)


def relative_difference(value: Column, base: Column) -> Column:
    """(value - base) / base; NULL where the base is zero or anything is missing."""
    return F.try_divide(value - base, base)
