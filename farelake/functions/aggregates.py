"""Aggregate expressions with the warehouse's rounding rules.

Averages and rates are one exact decimal or integer sum turned into a double
and divided once, so they do not depend on the order rows arrive in.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from farelake.functions.scalars import col_of


def mean(value: str | Column) -> Column:
    """Mean of the non-NULL values as a double; NULL when there are none."""
    v = col_of(value)
    return F.try_divide(F.sum(v).cast("double"), F.count(v).cast("double"))


def whole_mean(value: str | Column) -> Column:
    """Mean of an integer column, cut to a whole number."""
    v = col_of(value)
    n = F.count(v)
    return F.call_function("div", F.sum(v), F.nullif(n, F.lit(0))).cast("int")


def count_if(condition: Column) -> Column:
    """Rows where ``condition`` is true; 0, not NULL, for no such row."""
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double quotient; NULL for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent_of(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double") * F.lit(100.0), denominator.cast("double"))


def percent(condition: Column) -> Column:
    """Share of all rows for which ``condition`` is true, in percent."""
    return percent_of(count_if(condition), F.count(F.lit(1)))
