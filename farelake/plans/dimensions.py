"""Dimension loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farelake.functions.calendar import calendar_columns
from farelake.functions.scalars import location_key
from farelake.operators.latest import latest_per_key
from farelake.operators.keys import highest, number_rows
from farelake.operators.scd2 import CURRENT, END, START, build_sparse_versions, build_versions
from farelake.schemas import columns_of

RIDER_TRACKED = ["loyalty_tier"]
DRIVER_TRACKED = ["driver_status", "vehicle_type"]


def scd2_riders(changes: DataFrame, tracked=RIDER_TRACKED, sequence=("change_seq",)) -> DataFrame:
    return build_versions(changes, "rider_id", "changed_at", list(sequence), list(tracked))


def scd2_drivers(changes: DataFrame, tracked=DRIVER_TRACKED, sequence=("change_seq", "change_sub")) -> DataFrame:
    return build_versions(changes, "driver_id", "changed_at", list(sequence), list(tracked))


def version_attributes(table: str, key: str) -> dict[str, str]:
    """The attributes of a versioned dimension, with their types: all columns but keys and load times."""
    fixed = {key, key.replace("_id", "_sk"), START, END, CURRENT, "created_at", "updated_at"}
    return {name: kind.lower() for name, kind in columns_of(table) if name not in fixed}


def driver_histories(log: DataFrame, sequence=("change_seq",)) -> DataFrame:
    """Driver versions with every attribute, from a log of single changes."""
    return build_sparse_versions(log, "driver_id", "changed_at", list(sequence), version_attributes("dim_drivers", "driver_id"))


def rider_histories(log: DataFrame, sequence=("change_seq",)) -> DataFrame:
    """Rider versions with every attribute, from a log of single changes."""
    return build_sparse_versions(log, "rider_id", "changed_at", list(sequence), version_attributes("dim_riders", "rider_id"))


def load_locations(staging: DataFrame) -> DataFrame:
    """Distinct pickup and dropoff places with their key hash.

    A place seen in both roles counts as a pickup. Both roles come from one
    pass over staging, and each task reduces its rows to distinct places.
    """
    roles = F.array(
        F.struct(F.col("pickup_lat").alias("latitude"), F.col("pickup_lng").alias("longitude"),
                 F.lit("pickup").alias("location_type")),
        F.struct(F.col("dropoff_lat").alias("latitude"), F.col("dropoff_lng").alias("longitude"),
                 F.lit("dropoff").alias("location_type")))
    places = (staging.select(F.inline(roles))
              .where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()))
    return (places.groupBy("latitude", "longitude").agg(F.max("location_type").alias("location_type"))
            .select(location_key("latitude", "longitude").alias("location_id"),
                    "latitude", "longitude", "location_type"))


def with_location_keys(places: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Number the places ``existing`` lacks."""
    if existing is None:
        return number_rows(places, "location_id", "location_sk")
    fresh = places.join(existing.select("location_id"), "location_id", "left_anti")
    return number_rows(fresh, "location_id", "location_sk", highest(existing, "location_sk"))


def minutes_of(days: DataFrame, column: str, step: int = 1) -> DataFrame:
    """Every minute, or every ``step``-th, of the distinct dates in ``days``.

    The dates are dealt out in turn, since adaptive execution would put so few into one task, which would then make all minutes.
    """
    day = F.col(column).cast("date").cast("timestamp_ntz")
    minute = F.explode(F.sequence(F.lit(0), F.lit(24 * 60 - 1), F.lit(step)))
    parts = int(days.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (days.where(F.col(column).isNotNull()).select(day.alias("_day")).distinct().repartition(parts)
            .select("_day", minute.alias("_minute"))
            .select((F.col("_day") + F.make_dt_interval(mins=F.col("_minute"))).alias("minute_start")))


def dim_time(minutes: DataFrame, holidays: DataFrame) -> DataFrame:
    """The time dimension for a table of minutes; ``holidays`` is (holiday_date, holiday_name)."""
    calendar = minutes.select(calendar_columns("minute_start"))
    named = holidays.select(F.col("holiday_date").alias("full_date"), "holiday_name")
    rows = (calendar.join(named, "full_date", "left")
            .withColumn("is_holiday", F.col("holiday_name").isNotNull()))
    return rows.select(
        "time_sk", "full_date", "year", "quarter", "month", "month_name", "week_of_year", "day_of_month",
        "day_of_year", "day_of_week", "day_name", "hour_24", "hour_12", "am_pm", "minute", "is_weekend",
        "is_holiday", "holiday_name", "business_hours", "rush_hour")


def date_range(df: DataFrame, column: str) -> DataFrame:
    """Every date from the first to the last of ``column``."""
    day = F.to_date(F.col(column))
    span = df.agg(F.min(day).alias("first"), F.max(day).alias("last"))
    return span.where(F.col("first").isNotNull()).select(F.explode(F.sequence("first", "last")).alias("day"))


def upsert_by_key(existing: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Type 1 load: incoming rows replace existing ones with the same key.

    Repeated incoming keys are reduced to the last by ``order``; the ordering
    columns themselves are not stored.
    """
    columns = existing.columns
    last = latest_per_key(incoming, [key], order).select(columns)
    return existing.join(last.select(key), key, "left_anti").select(columns).unionByName(last)


def upsert_members(existing: DataFrame, incoming: DataFrame, key: str, surrogate: str, order: list[str]) -> DataFrame:
    """Type 1 load of a reference dimension with surrogate keys.

    Known members take the incoming columns and keep their key and the columns that do
    not come in; new members are numbered after the highest key.
    """
    columns = [c for c in incoming.columns if c not in (key, *order)]
    last = latest_per_key(incoming.where(F.col(key).isNotNull()), [key], order).select(key, *columns)
    other = [c for c in existing.columns if c not in (key, surrogate, *columns)]
    known = existing.select(key, surrogate, *other)
    kept = known.join(last, key).select(existing.columns)
    fresh = number_rows(last.join(known, key, "left_anti"), key, surrogate, highest(existing, surrogate))
    return (existing.join(last.select(key), key, "left_anti").select(existing.columns)
            .unionByName(kept).unionByName(fresh, allowMissingColumns=True))
