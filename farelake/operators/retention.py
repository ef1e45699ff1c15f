"""Keeping, archiving and purging rows by age."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from farelake.functions.scalars import days_before
from farelake.session import durable
from farelake.sources.tables import NO_DATE, PARTITIONED, drop_folders, folder_names, in_folders, move_folder, partition_column, write_table


def is_past(column: str, as_of, days: int) -> Column:
    """True for rows older than ``days``; a row without a time is kept."""
    return F.coalesce(F.col(column) < days_before(as_of, days), F.lit(False))


def kept_rows(df: DataFrame, column: str, as_of, days: int) -> DataFrame:
    return df.where(~is_past(column, as_of, days))


def archived_rows(df: DataFrame, column: str, as_of, days: int) -> DataFrame:
    return df.where(F.col(column) < days_before(as_of, days))


def archive_split(df: DataFrame, column: str, as_of, days: int) -> DataFrame:
    """All rows with ``is_archived``; written by that column, both parts come from one pass."""
    return df.withColumn("is_archived", is_past(column, as_of, days))


def retention_purge(df: DataFrame, table: str, column: str, classification: DataFrame, as_of) -> DataFrame:
    """Rows a purge would delete, by the shortest retention period among the table's columns.

    No classified column, or none with a period, means nothing is purged.
    """
    period = (classification.where(F.col("table_name") == table)
              .agg(F.min("retention_period_days").alias("days")))
    cutoff = days_before(as_of, 0) - F.make_dt_interval(days=period.scalar())
    return df.where(F.col(column) < cutoff)


def stored_folders(spark: SparkSession, root: str, table: str, grain: str) -> list:
    """Dates of a stored table's folders, from their names alone; rows without a date are not among them."""
    column = partition_column(table, grain)
    names = [name for name in folder_names(spark, f"{root}/{table}") if name.startswith(f"{column}=")]
    dates = [name.partition("=")[2] for name in names]
    return sorted(dt.date.fromisoformat(d) for d in dates if d != NO_DATE)


def _cut(spark: SparkSession, root: str, table: str, grain: str, cutoff: dt.datetime) -> tuple[list, list]:
    """(folders wholly before the cutoff, the folder it falls into)."""
    first = cutoff.date().replace(day=1) if grain == "month" else cutoff.date()
    folders = stored_folders(spark, root, table, grain)
    return [d for d in folders if d < first], [d for d in folders if d == first]


def archive_folders(spark: SparkSession, root: str, archive: str, table: str, as_of, days: int, grain: str = "day") -> list:
    """Move all rows older than ``days`` from a table stored below ``root`` to the same table below ``archive``.

    Folders wholly before the cutoff are moved as they are, without reading a row. Only the one
    folder the cutoff falls into is read, and split. Rows without a date stay. Gives the dates of the
    moved folders. May be run again after a failure, and with a later clock.
    """
    cutoff = spark.range(1).select(days_before(as_of, days)).first()[0]
    whole, split = _cut(spark, root, table, grain, cutoff)
    _split(spark, root, table, grain, split, cutoff, archive)
    for date in whole:
        move_folder(spark, root, archive, table, grain, date)
    return whole


def purge_folders(spark: SparkSession, root: str, table: str, classification: DataFrame, as_of, grain: str = "day") -> list:
    """Remove all rows past the shortest retention period among the table's columns; see ``archive_folders``."""
    period = classification.where(F.col("table_name") == table).agg(F.min("retention_period_days")).first()[0]
    if period is None:
        return []
    cutoff = spark.range(1).select(days_before(as_of, period)).first()[0]
    whole, split = _cut(spark, root, table, grain, cutoff)
    _split(spark, root, table, grain, split, cutoff, None)
    drop_folders(spark, root, table, grain, whole)
    return whole


def _split(spark: SparkSession, root: str, table: str, grain: str, folders: list, cutoff: dt.datetime, archive: str | None) -> None:
    """Rewrite the folder of the cutoff: rows from it on stay, those before go to ``archive`` or nowhere."""
    if not folders:
        return
    column, source = partition_column(table, grain), PARTITIONED[table][1]
    rows = durable(in_folders(spark.read.parquet(f"{root}/{table}"), column, folders).drop(column), "cutoff-folder")
    old = rows.where(F.col(source) < F.lit(cutoff))
    if archive is not None and not old.isEmpty():
        # What an earlier run has put there stays: the folder is split by an ever later cutoff.
        if folder_names(spark, f"{archive}/{table}"):
            before = spark.read.parquet(f"{archive}/{table}")
            before = durable(in_folders(before, column, folders).drop(column).select(old.columns), "archived-folder")
            old = before.where(F.col(source) < old.agg(F.min(source)).scalar()).unionByName(old)
        write_table(old, archive, table, grain=grain)
    kept = rows.where(~(F.col(source) < F.lit(cutoff)))
    if kept.isEmpty():
        drop_folders(spark, root, table, grain, folders)
    else:
        write_table(kept, root, table, grain=grain)
