"""Key figures over the trip fact: sums per place first, then the lookup of what the place is, then the figure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from farelake.functions.aggregates import count_if, percent_of, ratio
from farelake.plans.views import SATISFIED_FROM, Tables, pickup_city


def _trip_date() -> Column:
    return F.to_date("pickup_timestamp").alias("trip_date")


def kpi_financial(wh: Tables) -> DataFrame:
    """Surge share, commission rate, earnings per trip and discount share by city and day."""
    summed = ("total_fare", "surge_fare", "company_commission", "driver_earnings", "discount_amount", "surge_multiplier")
    per_place = wh["fact_trips"].groupBy(_trip_date(), "pickup_location_sk").agg(
        F.count(F.lit(1)).alias("n"), F.count("surge_multiplier").alias("surges"), *[F.sum(c).alias(c) for c in summed])
    return (
        per_place.join(pickup_city(wh), "pickup_location_sk").groupBy("trip_date", "city")
        .agg(F.sum("n").alias("total_trips"),
             F.sum("total_fare").cast("decimal(20,2)").alias("total_revenue"),
             percent_of(F.sum("surge_fare"), F.sum("total_fare")).alias("surge_share"),
             percent_of(F.sum("company_commission"), F.sum("total_fare")).alias("commission_rate"),
             ratio(F.sum("driver_earnings"), F.sum("n")).alias("earnings_per_trip"),
             percent_of(F.sum("discount_amount"), F.sum("total_fare")).alias("discount_share"),
             ratio(F.sum("surge_multiplier"), F.sum("surges")).alias("avg_surge_multiplier"))
    )


def kpi_operations(wh: Tables) -> DataFrame:
    """Completion and cancellation rate, mean wait and distance by city and day."""
    flags = wh["dim_trip_status"].select("trip_status_sk", "is_completed", "is_cancelled")
    per_place = wh["fact_trips"].groupBy(_trip_date(), "pickup_location_sk", "trip_status_sk").agg(
        F.count(F.lit(1)).alias("n"), F.sum("wait_time_minutes").alias("wait"), F.count("wait_time_minutes").alias("waits"),
        F.sum("actual_distance_miles").alias("miles"), F.count("actual_distance_miles").alias("distances"))
    n = F.sum("n")
    return (
        per_place.join(flags, "trip_status_sk").join(pickup_city(wh), "pickup_location_sk").groupBy("trip_date", "city")
        .agg(n.alias("total_trips"),
             percent_of(F.sum(F.when(F.col("is_completed"), F.col("n")).otherwise(0)), n).alias("completion_rate"),
             percent_of(F.sum(F.when(F.col("is_cancelled"), F.col("n")).otherwise(0)), n).alias("cancellation_rate"),
             ratio(F.sum("wait"), F.sum("waits")).alias("avg_wait_minutes"),
             ratio(F.sum("miles"), F.sum("distances")).alias("avg_distance_miles"))
    )


def kpi_utilization(daily: DataFrame) -> DataFrame:
    """Driving hours over online hours, and acceptance, by driver and month."""
    return (
        daily.groupBy("driver_sk", F.trunc("activity_date", "month").alias("activity_month"))
        .agg(F.sum("hours_online").alias("hours_online"),
             F.sum("driving_minutes").alias("driving_minutes"),
             percent_of(F.sum("driving_minutes"), F.sum("hours_online") * F.lit(60)).alias("utilization"),
             percent_of(F.sum("total_trips"), F.sum("offered_trips")).alias("acceptance_rate"))
    )


def driving_days(trips: DataFrame, feed: DataFrame) -> DataFrame:
    """Driver days with exact driving minutes next to the online hours of the feed."""
    days = (trips.where(F.col("pickup_timestamp").isNotNull())
            .groupBy("driver_sk", F.to_date("pickup_timestamp").alias("activity_date"))
            .agg(F.count(F.lit(1)).alias("total_trips"),
                 F.coalesce(F.sum("actual_duration_minutes"), F.lit(0)).alias("driving_minutes")))
    return days.join(feed, ["driver_sk", "activity_date"], "left")


def kpi_quality(wh: Tables) -> DataFrame:
    """Mean ratings both ways, share of ratings of 4 and more, and share of unrated completed trips."""
    good = F.lit(SATISFIED_FROM).cast("decimal(3,2)")
    done = wh["dim_trip_status"].where("is_completed").select("trip_status_sk")
    per_place = wh["fact_trips"].groupBy("pickup_location_sk", "trip_status_sk").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rider_rating_given").alias("of_drivers"), F.count("rider_rating_given").alias("rated"),
        F.sum("driver_rating_given").alias("of_riders"), F.count("driver_rating_given").alias("rated_riders"),
        count_if(F.col("rider_rating_given") >= good).alias("satisfied"))
    return (
        per_place.join(done, "trip_status_sk").join(pickup_city(wh), "pickup_location_sk").groupBy("city")
        .agg(F.sum("n").alias("completed_trips"),
             ratio(F.sum("of_drivers"), F.sum("rated")).alias("avg_driver_rating"),
             ratio(F.sum("of_riders"), F.sum("rated_riders")).alias("avg_rider_rating"),
             percent_of(F.sum("satisfied"), F.sum("rated")).alias("satisfied_share"),
             percent_of(F.sum("n") - F.sum("rated"), F.sum("n")).alias("unrated_share"))
    )


def monthly_driver_earnings(wh: Tables) -> DataFrame:
    """A driver's true monthly sums, over all versions of the driver.

    Trips are summed per version key before the lookup of the driver, so a
    busy driver is one row per task and month in the shuffle.
    """
    per_version = (
        wh["fact_trips"].where(F.col("pickup_timestamp").isNotNull())
        .groupBy("driver_sk", F.trunc("pickup_timestamp", "month").alias("month"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("total_fare").alias("gross"), F.sum("driver_earnings").alias("net"))
    )
    return (per_version.join(wh["dim_drivers"].select("driver_sk", "driver_id"), "driver_sk")
            .groupBy("driver_id", "month")
            .agg(F.sum("n").alias("total_trips"), F.sum("gross").alias("gross_earnings"),
                 F.sum("net").alias("net_earnings")))


def rider_insights(wh: Tables) -> DataFrame:
    """Trips, spend, ratings and last trip of each rider, under the rider's current tier.

    Sums are built per version key first and brought together over the
    business key after the lookup.
    """
    per_version = wh["fact_trips"].groupBy("rider_sk").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_fare").alias("spend"), F.max("pickup_timestamp").alias("last"),
        F.sum("driver_rating_given").alias("rating_sum"), F.count("driver_rating_given").alias("ratings"))
    riders = wh["dim_riders"].select("rider_sk", "rider_id", "loyalty_tier", "is_current")
    return (
        riders.join(per_version, "rider_sk", "left").groupBy("rider_id")
        .agg(F.max(F.when(F.col("is_current"), F.col("loyalty_tier"))).alias("loyalty_tier"),
             F.coalesce(F.sum("n"), F.lit(0)).alias("total_trips"),
             F.sum("spend").alias("total_spend"),
             ratio(F.sum("rating_sum"), F.sum("ratings")).alias("avg_rating"),
             F.max("last").alias("last_trip_at"))
    )


def loyalty_summary(wh: Tables) -> DataFrame:
    """Riders, trips and spend by loyalty tier."""
    return (rider_insights(wh).groupBy("loyalty_tier")
            .agg(F.count(F.lit(1)).alias("riders"), F.sum("total_trips").alias("total_trips"),
                 F.sum("total_spend").alias("total_spend"),
                 ratio(F.sum("total_spend"), F.count(F.lit(1))).alias("spend_per_rider")))


def demand_by_zone_hour(wh: Tables, time: DataFrame) -> DataFrame:
    """Requests by zone, hour, weekend and rush label.

    Requests are counted per place and hour before any lookup; the hour's
    labels come from the time dimension's on-the-hour rows.
    """
    hour = F.date_trunc("hour", "requested_timestamp").cast("timestamp_ntz")
    counted = (
        wh["fact_trips"].where(F.col("requested_timestamp").isNotNull())
        .groupBy("pickup_location_sk", F.date_format(hour, "yyyyMMddHHmm").cast("bigint").alias("time_sk"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    zones = wh["dim_locations"].select(F.col("location_sk").alias("pickup_location_sk"), "zone_id")
    hours = time.where(F.col("minute") == 0).select("time_sk", "hour_24", "is_weekend", "rush_hour")
    return (
        counted.join(hours, "time_sk").join(zones, "pickup_location_sk")
        .groupBy("zone_id", "hour_24", "is_weekend", "rush_hour")
        .agg(F.sum("n").alias("requests"))
    )
