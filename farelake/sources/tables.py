"""Reading and writing warehouse tables as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from farelake.functions.scalars import clock
from farelake.schemas import DEFAULTS, schema_of

# Tables stored in one folder per day or month of a date the bulk of queries filter on:
# table -> (stem of the partition column, its source). A day suits facts of many GB a day.
PARTITIONED = {
    "fact_trips": ("pickup", "pickup_timestamp"),
    "fact_payments": ("payment", "payment_timestamp"),
    "fact_driver_daily": ("activity", "activity_date"),
    "staging_raw_trips": ("ingestion", "ingestion_timestamp"),
    "security_audit_log": ("event", "event_timestamp"),
    "place_day_sums": ("pickup", "pickup_date"),
    "place_day_members": ("pickup", "pickup_date"),
}
GRAINS = ("day", "month")
# The name Spark gives to the folder of rows without a date.
NO_DATE = "__HIVE_DEFAULT_PARTITION__"
# Loaded tables are written often and read a few times: smaller files for a little more time.
CODEC = "zstd"


def partition_column(table: str, grain: str) -> str:
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}, not {grain!r}")
    return f"{PARTITIONED[table][0]}_{grain}"


def read_table(spark: SparkSession, root: str, table: str, grain: str = "day") -> DataFrame:
    """A table below ``root`` with its explicit schema (plus its partition column)."""
    schema = schema_of(table)
    if table in PARTITIONED:
        schema = schema.add(partition_column(table, grain), "date")
    return spark.read.schema(schema).parquet(f"{root}/{table}")


def with_partition_column(df: DataFrame, table: str, grain: str = "day") -> DataFrame:
    return df.withColumn(partition_column(table, grain), F.to_date(F.date_trunc(grain, PARTITIONED[table][1])))


def write_table(df: DataFrame, root: str, table: str, mode: str = "overwrite", grain: str = "day",
                whole: bool = False) -> None:
    """Write a table; facts go into one folder per day or month.

    The rebalance hint lets Spark cut a heavy date into several files of even
    size and put light dates together, so no date is one task. Overwriting
    replaces only the folders the rows fall into, or with ``whole`` the table:
    a full load must, since a row whose date was corrected would otherwise stay
    in its old folder too.
    """
    if table not in PARTITIONED:
        df.write.option("compression", CODEC).mode(mode).parquet(f"{root}/{table}")
        return
    column = partition_column(table, grain)
    rows = with_partition_column(df, table, grain).hint("rebalance", column)
    writer = rows.write.option("partitionOverwriteMode", "static" if whole else "dynamic")
    writer.option("compression", CODEC).mode(mode).partitionBy(column).parquet(f"{root}/{table}")


def conform(df: DataFrame, table: str, as_of=None) -> DataFrame:
    """Give ``df`` a table's full column list.

    A column that is missing gets its declared default, else NULL. An explicit
    NULL in a present column stays NULL, as it does on insert. A value that its
    column cannot hold becomes NULL and does not stop the load.
    """
    now = clock(as_of)
    defaults = DEFAULTS.get(table, {})
    present = set(df.columns)
    columns = []
    for field in schema_of(table).fields:
        if field.name in present:
            value = F.col(field.name)
        elif field.name in defaults:
            text = defaults[field.name]
            value = now if text == "now" else F.expr(text)
        else:
            value = F.lit(None)
        columns.append(value.try_cast(field.dataType).alias(field.name))
    return df.select(columns)


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def is_complete(spark: SparkSession, path: str) -> bool:
    """True where a write to ``path`` has come to its end."""
    system, place = _folder(spark, f"{path}/_SUCCESS")
    return system.exists(place)


def drop_folder(spark: SparkSession, path: str) -> None:
    system, place = _folder(spark, path)
    system.delete(place, True)


def drop_folders(spark: SparkSession, root: str, table: str, grain: str, dates) -> None:
    """Remove the folders of some dates (None: rows without one) of a table stored by day or month."""
    for date in dates:
        name = NO_DATE if date is None else str(date)
        drop_folder(spark, f"{root}/{table}/{partition_column(table, grain)}={name}")


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below ``path``; none where it does not exist."""
    system, place = _folder(spark, path)
    if not system.exists(place):
        return []
    return [entry.getPath().getName() for entry in system.listStatus(place) if entry.isDirectory()]


def move_folder(spark: SparkSession, root: str, to: str, table: str, grain: str, date) -> None:
    """Move one folder of a table as it is. Where it has files already, the moved ones come beside them."""
    name = f"{table}/{partition_column(table, grain)}={date}"
    system, source = _folder(spark, f"{root}/{name}")
    _, target = _folder(spark, f"{to}/{name}")
    if not system.exists(source):
        return
    system.mkdirs(target.getParent())
    if not system.exists(target):
        system.rename(source, target)
        return
    for entry in system.listStatus(source):
        system.rename(entry.getPath(), spark._jvm.org.apache.hadoop.fs.Path(target, entry.getPath().getName()))
    system.delete(source, True)


def in_folders(df: DataFrame, column: str, dates) -> DataFrame:
    """Rows of the given folders (None: rows without a date); the others are not read."""
    days = [d for d in dates if d is not None]
    wanted = F.col(column).isin(days) if days else F.lit(False)
    return df.where(wanted | F.col(column).isNull() if None in dates else wanted)
