"""Trip, revenue, driver and city views.

``wh`` maps table names to DataFrames. Joins carry no broadcast hint: Spark
broadcasts a dimension only below the session's size threshold, and otherwise
shuffles on the key and splits hot keys at run time.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from farelake.functions.aggregates import mean, percent, ratio, whole_mean
from farelake.functions.scalars import full_name, months_before

Tables = Mapping[str, DataFrame]

SATISFIED_FROM = "4.0"
HIGH_EARNINGS = 5000
TOP_DRIVERS = 100


def since(df: DataFrame, column: str, cutoff: Column, stem: str) -> DataFrame:
    """Rows from ``cutoff`` on. If the table is stored by day or month, older folders are not read."""
    rows = df.where(F.col(column) >= cutoff)
    for grain in ("day", "month"):
        if f"{stem}_{grain}" in df.columns:
            rows = rows.where(F.col(f"{stem}_{grain}") >= F.to_date(F.date_trunc(grain, cutoff)))
    return rows


def pickup_city(wh: Tables) -> DataFrame:
    """Pickup role of the location dimension, cut to key and city."""
    return wh["dim_locations"].select(F.col("location_sk").alias("pickup_location_sk"), "city")


def completed_status(wh: Tables):
    """Key of the completed status as a scalar subquery.

    More than one such row is an error, none selects no trip.
    """
    return wh["dim_trip_status"].where(F.col("status_code") == "COMPLETED").select("trip_status_sk").scalar()


def v_trip_summary(wh: Tables) -> DataFrame:
    """Trips with driver, rider and both addresses.

    Keeps a trip only if the driver and rider versions it refers to are still
    current; see ``trip_summary_all_versions`` for the other reading.
    """
    drivers = wh["dim_drivers"].where("is_current").select("driver_sk", "first_name", "last_name")
    riders = wh["dim_riders"].where("is_current").select("rider_sk", "first_name", "last_name")
    return _trip_summary(wh, drivers, riders)


def trip_summary_all_versions(wh: Tables) -> DataFrame:
    """As ``v_trip_summary``, with the names of the version each trip was taken under."""
    drivers = wh["dim_drivers"].select("driver_sk", "first_name", "last_name")
    riders = wh["dim_riders"].select("rider_sk", "first_name", "last_name")
    return _trip_summary(wh, drivers, riders)


def _trip_summary(wh: Tables, drivers: DataFrame, riders: DataFrame) -> DataFrame:
    drivers = drivers.select("driver_sk", full_name("first_name", "last_name").alias("driver_name"))
    riders = riders.select("rider_sk", full_name("first_name", "last_name").alias("rider_name"))
    places = wh["dim_locations"].select("location_sk", "address")
    pickups = places.toDF("pickup_location_sk", "pickup_address")
    dropoffs = places.toDF("dropoff_location_sk", "dropoff_address")
    return (
        wh["fact_trips"]
        .join(drivers, "driver_sk")
        .join(riders, "rider_sk")
        .join(pickups, "pickup_location_sk")
        .join(dropoffs, "dropoff_location_sk")
        .select("trip_id", "driver_name", "rider_name", "pickup_address", "dropoff_address",
                "pickup_timestamp", "dropoff_timestamp", "actual_duration_minutes",
                "actual_distance_miles", "total_fare", "rider_rating_given", "driver_rating_given")
    )


def v_daily_revenue(wh: Tables) -> DataFrame:
    """Completed trips by pickup date and city. Trips without a pickup time share a NULL date.

    Trips are summed per place and date before the place is looked up.
    """
    per_place = (
        wh["fact_trips"]
        .where(F.col("trip_status_sk") == completed_status(wh))
        .groupBy(F.to_date("pickup_timestamp").alias("trip_date"), "pickup_location_sk")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("total_fare").alias("fare"), F.count("total_fare").alias("fares"),
             F.sum("driver_earnings").alias("earned"), F.sum("company_commission").alias("kept"))
    )
    return (
        per_place.join(pickup_city(wh), "pickup_location_sk")
        .groupBy("trip_date", "city")
        .agg(F.sum("n").alias("total_trips"),
             F.sum("fare").cast("decimal(20,2)").alias("total_revenue"),
             ratio(F.sum("fare"), F.sum("fares")).alias("avg_fare"),
             F.sum("earned").cast("decimal(20,2)").alias("driver_earnings"),
             F.sum("kept").cast("decimal(20,2)").alias("company_revenue"))
    )


def v_top_drivers(wh: Tables, as_of=None) -> DataFrame:
    """First 100 driver-days of the last month by driver rating, then lifetime trips.

    ``monthly_earnings`` is one day's gross earnings. Ties are broken by driver
    and date so the 100 rows are well defined.
    """
    drivers = (wh["dim_drivers"].where("is_current")
               .select("driver_sk", full_name("first_name", "last_name").alias("driver_name"),
                       "city_code", "driver_rating", F.col("total_trips").alias("lifetime_trips")))
    days = (since(wh["fact_driver_daily"], "activity_date", months_before(as_of, 1), "activity")
            .select("driver_sk", "activity_date", "average_rating", "gross_earnings", "acceptance_rate"))
    return (
        days.join(drivers, "driver_sk")
        .orderBy(F.desc("driver_rating"), F.desc("lifetime_trips"), "driver_sk", "activity_date")
        .limit(TOP_DRIVERS)
        .select("driver_name", "city_code", "driver_rating",
                F.col("lifetime_trips").alias("total_trips"),
                F.col("average_rating").alias("recent_rating"),
                F.col("gross_earnings").alias("monthly_earnings"),
                "acceptance_rate")
    )


def v_city_performance(wh: Tables, as_of=None) -> DataFrame:
    """Last month's trips by pickup city. Unrated trips count as not satisfied."""
    return (
        since(wh["fact_trips"], "pickup_timestamp", months_before(as_of, 1), "pickup")
        .join(pickup_city(wh), "pickup_location_sk")
        .groupBy("city")
        .agg(F.count_distinct("trip_id").alias("total_trips"),
             F.count_distinct("driver_sk").alias("active_drivers"),
             F.count_distinct("rider_sk").alias("active_riders"),
             mean("total_fare").alias("avg_fare"),
             whole_mean("actual_duration_minutes").alias("avg_trip_duration"),
             percent(F.col("rider_rating_given") >= F.lit(SATISFIED_FROM).cast("decimal(3,2)"))
             .alias("rider_satisfaction_rate"))
    )


def top_cities(wh: Tables, as_of=None) -> DataFrame:
    return v_city_performance(wh, as_of).orderBy(F.desc("total_trips"), "city")


def revenue_trend(wh: Tables) -> DataFrame:
    """Revenue per day over all cities, newest first."""
    return (v_daily_revenue(wh).groupBy("trip_date")
            .agg(F.sum("total_revenue").alias("daily_revenue"))
            .orderBy(F.desc("trip_date")))


def high_earning_drivers(wh: Tables, as_of=None) -> DataFrame:
    """The top-driver rows above the earnings mark; the mark applies after the first 100."""
    return (v_top_drivers(wh, as_of).where(F.col("monthly_earnings") > HIGH_EARNINGS)
            .orderBy(F.desc("recent_rating")))


def register_views(wh: Tables, as_of=None) -> None:
    """Register tables and views so SQL text can name them."""
    from farelake.plans import access

    for name, frame in list(wh.items()):
        frame.createOrReplaceTempView(name)
    views = {
        "v_trip_summary": lambda: v_trip_summary(wh),
        "v_daily_revenue": lambda: v_daily_revenue(wh),
        "v_top_drivers": lambda: v_top_drivers(wh, as_of),
        "v_city_performance": lambda: v_city_performance(wh, as_of),
        "v_active_users": lambda: access.v_active_users(wh),
        "v_user_permissions": lambda: access.v_user_permissions(wh),
        "v_security_audit_summary": lambda: access.v_security_audit_summary(wh, as_of),
    }
    needs = {
        "v_trip_summary": {"fact_trips", "dim_drivers", "dim_riders", "dim_locations"},
        "v_daily_revenue": {"fact_trips", "dim_locations", "dim_trip_status"},
        "v_top_drivers": {"dim_drivers", "fact_driver_daily"},
        "v_city_performance": {"fact_trips", "dim_locations"},
        "v_active_users": {"security_users"},
        "v_user_permissions": {"security_users", "user_roles", "security_roles", "role_permissions",
                               "security_permissions"},
        "v_security_audit_summary": {"security_audit_log", "security_users"},
    }
    for name, build in views.items():
        if needs[name] <= set(wh):
            build().createOrReplaceTempView(name)
