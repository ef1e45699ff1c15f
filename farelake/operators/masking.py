"""Masking of classified columns for readers without privilege."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

# Rule names of this repo, from weakest to strongest.
RULES = ("year", "last4", "hash", "full")


def masked(column: str, rule: str) -> Column:
    value = F.col(column)
    if rule == "full":
        return F.lit(None).cast("string")
    if rule == "hash":
        return F.sha2(value.cast("string"), 256)
    if rule == "last4":
        text = value.cast("string")
        return F.when(F.length(text) <= 4, F.lit("****")).otherwise(F.concat(F.lit("****"), F.right(text, F.lit(4))))
    if rule == "year":
        return F.trunc(value, "year")
    raise ValueError(f"unknown masking rule {rule!r}; known are {RULES}")


def mask_columns(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Replace each named column by its masked form."""
    return df.select([masked(c, rules[c]).alias(c) if c in rules else F.col(c) for c in df.columns])


def mask_for_readers(df: DataFrame, rules: Mapping[str, str], privileged: Column) -> DataFrame:
    """As ``mask_columns``, but only on rows where ``privileged`` is not true.

    For reads that carry their reader, such as an export per user. Where the
    masked form does not fit the column's type it is NULL.
    """
    clear = F.coalesce(privileged, F.lit(False))
    return df.select([
        F.when(clear, F.col(c)).otherwise(masked(c, rules[c]).try_cast(df.schema[c].dataType)).alias(c)
        if c in rules else F.col(c) for c in df.columns])


def rules_of(classification: DataFrame, table: str) -> dict[str, str]:
    """Masking rules of one table, by column name; of several rules for a column the strongest.

    Reads a table's column list, at most one row per column, to the driver:
    which expressions a projection holds must be known when it is planned.
    """
    rows = (classification.where((F.col("table_name") == table) & F.col("masking_rule").isNotNull())
            .select("column_name", "masking_rule").distinct().collect())
    strongest: dict[str, str] = {}
    for r in rows:
        if r.masking_rule not in RULES:
            raise ValueError(f"unknown masking rule {r.masking_rule!r}; known are {RULES}")
        if RULES.index(r.masking_rule) >= RULES.index(strongest.get(r.column_name, RULES[0])):
            strongest[r.column_name] = r.masking_rule
    return strongest
