"""Key figures over trips."""

from __future__ import annotations

from farelake.catalog.loads import TIME_SQL
from farelake.plans import dimensions, kpis
from farelake.registry import query

query("kpi_financial", "fact_trips", "dim_locations", sql="""
select cast(ft.pickup_timestamp as date) as trip_date, pl.city, count(*) as total_trips,
       cast(sum(total_fare) as decimal(20,2)) as total_revenue,
       cast(sum(surge_fare) as double) * 100 / nullif(cast(sum(total_fare) as double), 0) as surge_share,
       cast(sum(company_commission) as double) * 100 / nullif(cast(sum(total_fare) as double), 0) as commission_rate,
       cast(sum(driver_earnings) as double) / count(*) as earnings_per_trip,
       cast(sum(discount_amount) as double) * 100 / nullif(cast(sum(total_fare) as double), 0) as discount_share,
       cast(sum(surge_multiplier) as double) / nullif(count(surge_multiplier), 0) as avg_surge_multiplier
from fact_trips ft join dim_locations pl on ft.pickup_location_sk = pl.location_sk
group by 1, 2""")(kpis.kpi_financial)

query("kpi_operations", "fact_trips", "dim_locations", "dim_trip_status", sql="""
select cast(ft.pickup_timestamp as date) as trip_date, pl.city, count(*) as total_trips,
       cast(count(case when s.is_completed then 1 end) as double) * 100 / count(*) as completion_rate,
       cast(count(case when s.is_cancelled then 1 end) as double) * 100 / count(*) as cancellation_rate,
       cast(sum(wait_time_minutes) as double) / nullif(count(wait_time_minutes), 0) as avg_wait_minutes,
       cast(sum(actual_distance_miles) as double) / nullif(count(actual_distance_miles), 0) as avg_distance_miles
from fact_trips ft join dim_locations pl on ft.pickup_location_sk = pl.location_sk
join dim_trip_status s on s.trip_status_sk = ft.trip_status_sk
group by 1, 2""")(kpis.kpi_operations)

query("kpi_utilization", "fact_trips", "driver_feed", sql="""
with days as (
  select driver_sk, cast(pickup_timestamp as date) as activity_date, count(*) as total_trips,
         coalesce(sum(actual_duration_minutes), 0) as driving_minutes
  from fact_trips where pickup_timestamp is not null group by 1, 2)
select d.driver_sk, cast(date_trunc('month', d.activity_date) as date) as activity_month,
       cast(sum(f.hours_online) as decimal(15,2)) as hours_online,
       cast(sum(d.driving_minutes) as bigint) as driving_minutes,
       cast(sum(d.driving_minutes) as double) * 100 / nullif(cast(sum(f.hours_online) * 60 as double), 0)
           as utilization,
       cast(sum(d.total_trips) as double) * 100 / nullif(cast(sum(f.offered_trips) as double), 0) as acceptance_rate
from days d left join driver_feed f on f.driver_sk = d.driver_sk and f.activity_date = d.activity_date
group by 1, 2""")(lambda wh: kpis.kpi_utilization(kpis.driving_days(wh["fact_trips"], wh["driver_feed"])))

query("kpi_quality", "fact_trips", "dim_locations", "dim_trip_status", sql="""
select pl.city, count(*) as completed_trips,
       cast(sum(rider_rating_given) as double) / nullif(count(rider_rating_given), 0) as avg_driver_rating,
       cast(sum(driver_rating_given) as double) / nullif(count(driver_rating_given), 0) as avg_rider_rating,
       cast(count(case when rider_rating_given >= 4.0 then 1 end) as double) * 100
           / nullif(count(rider_rating_given), 0) as satisfied_share,
       cast(count(case when rider_rating_given is null then 1 end) as double) * 100 / count(*) as unrated_share
from fact_trips ft join dim_locations pl on ft.pickup_location_sk = pl.location_sk
join dim_trip_status s on s.trip_status_sk = ft.trip_status_sk and s.is_completed
group by 1""")(kpis.kpi_quality)

query("monthly_driver_earnings", "fact_trips", "dim_drivers", sql="""
select d.driver_id, cast(date_trunc('month', pickup_timestamp) as date) as month, count(*) as total_trips,
       cast(sum(total_fare) as decimal(30,2)) as gross_earnings,
       cast(sum(driver_earnings) as decimal(30,2)) as net_earnings
from fact_trips t join dim_drivers d on d.driver_sk = t.driver_sk
where pickup_timestamp is not null group by 1, 2""")(kpis.monthly_driver_earnings)

RIDERS = """
select r.rider_id, max(case when r.is_current then r.loyalty_tier end) as loyalty_tier,
       count(t.rider_sk) as total_trips, cast(sum(t.total_fare) as decimal(30,2)) as total_spend,
       cast(sum(t.driver_rating_given) as double) / nullif(count(t.driver_rating_given), 0) as avg_rating,
       max(t.pickup_timestamp) as last_trip_at
from dim_riders r left join fact_trips t on t.rider_sk = r.rider_sk
group by 1"""

query("rider_insights", "fact_trips", "dim_riders", sql=RIDERS)(kpis.rider_insights)

query("loyalty_summary", "fact_trips", "dim_riders", sql=f"""
select loyalty_tier, count(*) as riders, cast(sum(total_trips) as bigint) as total_trips,
       cast(sum(total_spend) as decimal(38,2)) as total_spend,
       cast(sum(total_spend) as double) / count(*) as spend_per_rider
from ({RIDERS}) as r group by 1""")(kpis.loyalty_summary)

query("demand_by_zone_hour", "fact_trips", "dim_locations", "holidays", sql=f"""
with hours as ({TIME_SQL.replace("{column}", "requested_timestamp").replace("{table}", "fact_trips")})
select l.zone_id, h.hour_24, h.is_weekend, h.rush_hour, count(*) as requests
from fact_trips t
join dim_locations l on l.location_sk = t.pickup_location_sk
join hours h on h.minute = 0
  and h.time_sk = cast(strftime(date_trunc('hour', t.requested_timestamp), '%Y%m%d%H%M') as bigint)
group by 1, 2, 3, 4""")(
    lambda wh: kpis.demand_by_zone_hour(wh, dimensions.dim_time(
        dimensions.minutes_of(wh["fact_trips"], "requested_timestamp", 60), wh["holidays"])))
