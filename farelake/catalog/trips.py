"""Trip, revenue, driver and city queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from farelake.plans import views
from farelake.plans.partials import CityPartials
from farelake.registry import TRIP_CLOCK, query
from farelake.session import durable, scratch_dir
from farelake.sources.tables import with_partition_column

CUTOFF = f"(timestamp '{TRIP_CLOCK}' - interval '1' month)"
# Half of the trips from here on come late to the stored partials.
LATE_FROM = "2001-07-20"

# The checks start from the result's columns and find them another way than the plans do.
TRIP_SUMMARY = """
with driver_label as (
  select driver_sk as k, case when first_name is not null and last_name is not null
         then concat(first_name, ' ', last_name) end as label from dim_drivers where {current}),
rider_label as (
  select rider_sk as k, case when first_name is not null and last_name is not null
         then concat(first_name, ' ', last_name) end as label from dim_riders where {current}),
place as (select location_sk as k, address as label from dim_locations)
select trip_id, (select label from driver_label where k = driver_sk) as driver_name,
       (select label from rider_label where k = rider_sk) as rider_name,
       (select label from place where k = pickup_location_sk) as pickup_address,
       (select label from place where k = dropoff_location_sk) as dropoff_address,
       pickup_timestamp, dropoff_timestamp, actual_duration_minutes, actual_distance_miles, total_fare,
       rider_rating_given, driver_rating_given
from fact_trips
where driver_sk in (select k from driver_label) and rider_sk in (select k from rider_label)
  and pickup_location_sk in (select k from place) and dropoff_location_sk in (select k from place)"""

# Sums per place and date first, cities after that.
DAILY_REVENUE = """
with per_place as (
  select pickup_location_sk as location_sk, cast(pickup_timestamp as date) as trip_date, count(*) as n,
         count(total_fare) as fares, sum(total_fare) as fare, sum(driver_earnings) as earned,
         sum(company_commission) as kept
  from fact_trips
  where trip_status_sk in (select trip_status_sk from dim_trip_status where status_code = 'COMPLETED')
  group by all)
select trip_date, city, cast(sum(n) as bigint) as total_trips, cast(sum(fare) as decimal(20,2)) as total_revenue,
       cast(sum(fare) as double) / cast(sum(fares) as bigint) as avg_fare,
       cast(sum(earned) as decimal(20,2)) as driver_earnings, cast(sum(kept) as decimal(20,2)) as company_revenue
from per_place join (select location_sk, city from dim_locations) using (location_sk)
group by trip_date, city"""

TOP_DRIVERS = f"""
with recent as (select * from fact_driver_daily where activity_date >= {CUTOFF}),
placed as (
  select *, row_number() over (order by driver_rating desc nulls last, c.total_trips desc nulls last,
                               driver_sk, activity_date) as place
  from (select driver_sk, first_name, last_name, city_code, driver_rating, total_trips
        from dim_drivers where is_current) as c
  join (select driver_sk, activity_date, average_rating, gross_earnings, acceptance_rate from recent)
  using (driver_sk))
select case when first_name is not null and last_name is not null then concat(first_name, ' ', last_name) end
           as driver_name,
       city_code, driver_rating, total_trips, average_rating as recent_rating,
       cast(gross_earnings as decimal(20,2)) as monthly_earnings, acceptance_rate
from placed where place <= 100"""

# Heads are distinct (city, kind, key) rows; fares and ratings are summed apart from them.
CITY_PERFORMANCE = f"""
with recent as (
  select *, (select city from dim_locations where location_sk = pickup_location_sk) as city
  from fact_trips
  where pickup_timestamp >= {CUTOFF} and pickup_location_sk in (select location_sk from dim_locations)),
heads as (
  select city, 't' as kind, cast(trip_id as varchar) as head from recent
  union select city, 'd', cast(driver_sk as varchar) from recent
  union select city, 'r', cast(rider_sk as varchar) from recent),
counted as (
  select city, count(head) filter (where kind = 't') as total_trips,
         count(head) filter (where kind = 'd') as active_drivers,
         count(head) filter (where kind = 'r') as active_riders
  from heads group by city),
summed as (
  select city, cast(sum(total_fare) as double) / count(total_fare) as avg_fare,
         cast(sum(actual_duration_minutes) // nullif(count(actual_duration_minutes), 0) as integer)
             as avg_trip_duration,
         100.0::double * count(*) filter (where rider_rating_given >= 4.0) / count(*) as rider_satisfaction_rate
  from recent group by city)
select c.city, total_trips, active_drivers, active_riders, avg_fare, avg_trip_duration, rider_satisfaction_rate
from counted c join summed s on c.city is not distinct from s.city"""

query("v_trip_summary", "fact_trips", "dim_drivers", "dim_riders", "dim_locations",
      sql=TRIP_SUMMARY.format(current="is_current"))(
    views.v_trip_summary)

query("trip_summary_all_versions", "fact_trips", "dim_drivers", "dim_riders", "dim_locations",
      sql=TRIP_SUMMARY.format(current="true"))(
    views.trip_summary_all_versions)

query("v_daily_revenue", "fact_trips", "dim_locations", "dim_trip_status", sql=DAILY_REVENUE)(
    views.v_daily_revenue)

query("v_top_drivers", "dim_drivers", "fact_driver_daily", sql=TOP_DRIVERS)(
    lambda wh: views.v_top_drivers(wh, TRIP_CLOCK))

query("v_city_performance", "fact_trips", "dim_locations", sql=CITY_PERFORMANCE)(
    lambda wh: views.v_city_performance(wh, TRIP_CLOCK))

ONE_STATE = ("pickup_timestamp", "driver_sk", "rider_sk", "pickup_location_sk", "total_fare", "actual_duration_minutes",
             "rider_rating_given")


def stored_city_performance(wh):
    """Partials of all but half of the last days, then of the one folder the other half falls into, and the report on them.

    The test facts repeat some trips; as after a load, one state of each is kept first.
    """
    states = wh["fact_trips"].groupBy("trip_id").agg(F.max(F.struct(*ONE_STATE)).alias("state"))
    trips = durable(with_partition_column(states.select("trip_id", "state.*"), "fact_trips", "month"), "trips-once")
    late = F.coalesce((F.col("pickup_timestamp") >= F.lit(LATE_FROM).cast("timestamp_ntz")) & (F.pmod(F.xxhash64("trip_id"), F.lit(2)) == 0),
                      F.lit(False))
    stored = CityPartials(wh.spark, scratch_dir(wh.spark, "city-partials"), "month")
    stored.store(trips.where(~late))
    stored.refresh(trips, [r[0] for r in trips.where(late).select(stored.folder).distinct().collect()])
    return stored.performance({"fact_trips": trips, "dim_locations": wh["dim_locations"]}, TRIP_CLOCK)


ONCE = f"""
once as (
  select * from fact_trips qualify row_number() over (
    partition by trip_id order by {', '.join(f'{c} desc nulls last' for c in ONE_STATE)}) = 1),
recent as ("""
query("stored_city_performance", "fact_trips", "dim_locations",
      sql=CITY_PERFORMANCE.replace("recent as (", ONCE, 1).replace("from fact_trips\n  where pickup", "from once\n  where pickup"))(
    stored_city_performance)

query("top_cities", "fact_trips", "dim_locations", sql=CITY_PERFORMANCE)(
    lambda wh: views.top_cities(wh, TRIP_CLOCK))

query("revenue_trend", "fact_trips", "dim_locations", "dim_trip_status",
      sql=f"""
select trip_date, cast(sum(total_revenue) as decimal(30,2)) as daily_revenue
from ({DAILY_REVENUE}) as v group by trip_date""")(views.revenue_trend)

query("high_earning_drivers", "dim_drivers", "fact_driver_daily",
      sql=f"select * from ({TOP_DRIVERS}) as v where monthly_earnings > 5000")(
    lambda wh: views.high_earning_drivers(wh, TRIP_CLOCK))
