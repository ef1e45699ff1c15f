"""Staging, dimension and fact loads, data quality, retention, masking and row policies."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from farelake.catalog.trips import DAILY_REVENUE
from farelake.functions.scalars import code, location_key, password_digest
from farelake.operators import constraints, masking, policies, quality, retention
from farelake.operators.keys import assign_surrogate_keys
from farelake.operators.scd2 import merge_versions, with_version_keys
from farelake.plans import dimensions, facts, monitoring, views
from farelake.plans.increment import IncrementalLoad
from farelake.plans.pipeline import place_attributes
from farelake.registry import EVENT_CLOCK, TRIP_CLOCK, query
from farelake.schemas import ACCEPTED, FOREIGN_KEYS, RANGES, REQUIRED, TEXT_LIMITS, UNIQUE
from farelake.session import durable, scratch_dir
from farelake.sources.tables import write_table
from farelake.streaming import jobs
from farelake.streaming.facts import LOGS, stream_facts

LOAD_MARK = "1998-01-01 00:00:00"

LATEST = """
latest as (
  select * exclude (rn, status), upper(rtrim(status)) as status
  from (select *, row_number() over (partition by trip_id order by ingestion_timestamp desc nulls last,
               requested_at desc nulls last, pickup_at desc nulls last, dropoff_at desc nulls last,
               driver_id desc nulls last, rider_id desc nulls last, raw_data desc nulls last) as rn
        from staging_raw_trips) as s where rn = 1)"""

CHECKED = """
checked as (
  select *, coalesce(json_valid(fare_breakdown) and substr(ltrim(fare_breakdown), 1, 1) in ('{', '['), true) as fare_ok,
         coalesce(json_valid(raw_data) and substr(ltrim(raw_data), 1, 1) in ('{', '['), true) as raw_ok
  from staging_raw_trips)"""


def _part(key: str, column: str, kind: str = "decimal(10,2)") -> str:
    return (f"try_cast(case when json_valid(fare_breakdown) and substr(ltrim(fare_breakdown), 1, 1) = '{{' "
            f"then json_extract_string(fare_breakdown, '$.{key}') end as {kind}) as {column}")


FARE_PARTS = ",\n       ".join(
    _part(k, c, "decimal(4,2)" if k == "surge" else "decimal(10,2)") for k, c in facts.FARE_KEYS.items())


def numbered(source: str, key: str, name: str, after: str = "0", digits: int = 3) -> str:
    return (f"select {key}, cast({after} + row_number() over (order by substr(md5({key}), 1, {digits}), {key}) as bigint) "
            f"as {name} from (select distinct {key} from {source} where {key} is not null) as k")


query("ingest_staging", "staging_raw_trips", sql=f"with {LATEST}\nselect * exclude (ingestion_date), "
      "cast(ingestion_timestamp as date) as ingestion_date from latest")(
    lambda wh: facts.ingest_staging(wh["staging_raw_trips"]))

query("validate_json", "staging_raw_trips", sql=f"""
with {CHECKED}
select *, fare_ok and raw_ok and trip_id is not null as is_valid from checked""")(
    lambda wh: facts.with_json_check(wh["staging_raw_trips"]))

query("quarantined_rows", "staging_raw_trips", sql=f"""
with {CHECKED}
select *, false as is_valid from checked where not (fare_ok and raw_ok and trip_id is not null)""")(
    lambda wh: facts.quarantined_rows(wh["staging_raw_trips"]))

query("parse_fare_breakdown", "staging_raw_trips", sql=f"""
select *,
       {FARE_PARTS}
from staging_raw_trips""")(lambda wh: facts.parse_fare_breakdown(wh["staging_raw_trips"]))


def quality_report(wh):
    q = quality
    return q.quality_report([
        q.row_rules_report(wh["dim_drivers"], "dim_drivers", [
            q.not_null("driver_sk"), q.not_null("last_name"), q.in_range("driver_rating", 0, 5),
            q.max_length("city_code", 10), q.max_length("first_name", 10)]),
        q.row_rules_report(wh["dim_riders"], "dim_riders", [
            q.accepted("loyalty_tier", ACCEPTED["loyalty_tier"]), q.not_null("last_name")]),
        q.row_rules_report(wh["raw_payments"], "raw_payments", [
            q.accepted("payment_status", ACCEPTED["payment_status"]), q.in_range("payment_amount", 0, 400000)]),
        q.row_rules_report(wh["fact_trips"], "fact_trips", [
            q.not_null("pickup_timestamp"), q.in_range("rider_rating_given", 0, 4)]),
        q.row_rules_report(wh["security_audit_log"], "security_audit_log", [
            q.in_range("risk_score", 0, 99), q.not_null("user_sk")]),
        q.unique_report(wh["fact_trips"], "fact_trips", ["trip_id"]),
        q.unique_report(wh["dim_trip_status"], "dim_trip_status", ["status_code"]),
        q.unique_report(wh["fact_driver_daily"], "fact_driver_daily", ["driver_sk", "activity_date"]),
        q.foreign_key_report(wh["fact_trips"], "fact_trips", "driver_sk",
                             wh["dim_drivers"].where("is_current"), "driver_sk"),
        q.foreign_key_report(wh["fact_trips"], "fact_trips", "dropoff_location_sk", wh["dim_locations"],
                             "location_sk"),
        q.foreign_key_report(wh["raw_payments"], "raw_payments", "trip_id", wh["fact_trips"], "trip_id"),
    ])


def _row_sql(table: str, rule: str, column: str, failed: str) -> str:
    return (f"select '{table}' as table_name, '{rule}' as rule, '{column}' as column_name, "
            f"count(*) as rows_checked, count(case when {failed} then 1 end) as failures from {table}")


def _unique_sql(table: str, *key: str) -> str:
    return (f"select '{table}', 'unique', '{'+'.join(key)}', cast(coalesce(sum(n), 0) as bigint), "
            f"count(case when n > 1 then 1 end) "
            f"from (select count(*) as n from {table} group by {', '.join(key)}) as c")


def _fk_sql(table: str, column: str, parent: str, key: str) -> str:
    return (f"select '{table}', 'foreign_key', '{column}', count(*), "
            f"count(case when {column} is not null and not exists "
            f"(select 1 from {parent} p where p.{key} = t.{column}) then 1 end) from {table} t")


query("quality_report", "dim_drivers", "dim_riders", "raw_payments", "fact_trips", "security_audit_log",
      "dim_trip_status", "fact_driver_daily", "dim_locations", sql="\nunion all\n".join((
          _row_sql("dim_drivers", "not_null", "driver_sk", "driver_sk is null"),
          _row_sql("dim_drivers", "not_null", "last_name", "last_name is null"),
          _row_sql("dim_drivers", "in_range", "driver_rating", "not driver_rating between 0 and 5"),
          _row_sql("dim_drivers", "max_length", "city_code", "length(city_code) > 10"),
          _row_sql("dim_drivers", "max_length", "first_name", "length(first_name) > 10"),
          _row_sql("dim_riders", "accepted_values", "loyalty_tier",
                   "loyalty_tier not in ('bronze', 'silver', 'gold', 'platinum')"),
          _row_sql("dim_riders", "not_null", "last_name", "last_name is null"),
          _row_sql("raw_payments", "accepted_values", "payment_status",
                   "payment_status not in ('pending', 'completed', 'failed', 'refunded')"),
          _row_sql("raw_payments", "in_range", "payment_amount", "not payment_amount between 0 and 400000"),
          _row_sql("fact_trips", "not_null", "pickup_timestamp", "pickup_timestamp is null"),
          _row_sql("fact_trips", "in_range", "rider_rating_given", "not rider_rating_given between 0 and 4"),
          _row_sql("security_audit_log", "in_range", "risk_score", "not risk_score between 0 and 99"),
          _row_sql("security_audit_log", "not_null", "user_sk", "user_sk is null"),
          _unique_sql("fact_trips", "trip_id"),
          _unique_sql("dim_trip_status", "status_code"),
          _unique_sql("fact_driver_daily", "driver_sk", "activity_date"),
          _fk_sql("fact_trips", "driver_sk", "(select * from dim_drivers where is_current)", "driver_sk"),
          _fk_sql("fact_trips", "dropoff_location_sk", "dim_locations", "location_sk"),
          _fk_sql("raw_payments", "trip_id", "fact_trips", "trip_id"))))(quality_report)

# Tables of the constraint check: the declared name and the sample table under it.
CHECKED_TABLES = {
    "dim_drivers": "dim_drivers", "dim_riders": "dim_riders", "dim_locations": "dim_locations",
    "dim_payment_methods": "dim_payment_methods", "dim_trip_status": "dim_trip_status", "fact_trips": "keyed_trips",
    "fact_payments": "keyed_payments", "fact_driver_daily": "fact_driver_daily", "security_users": "security_users",
    "user_sessions": "user_sessions", "security_roles": "security_roles", "security_permissions": "security_permissions",
    "role_permissions": "role_permissions", "user_roles": "user_roles", "user_attributes": "user_attributes",
    "security_audit_log": "security_audit_log",
}
# Keys that the sample tables lack.
_NO_KEY = {("fact_driver_daily", "driver_daily_sk"), ("role_permissions", "role_permission_sk"), ("user_roles", "user_role_sk"),
           ("user_attributes", "user_attribute_sk")}


def constraint_keys(wh):
    """All unique keys and references; the time dimension covers the days of pickups."""
    tables = {name: wh[sample] for name, sample in CHECKED_TABLES.items()}
    tables["dim_time"] = dimensions.dim_time(dimensions.minutes_of(wh["fact_trips"], "pickup_timestamp"), wh["holidays"])
    return constraints.key_report(tables)


def _key_sql() -> str:
    lines = []
    for table, sample in CHECKED_TABLES.items():
        lines += [f"select '{table}' as table_name, 'unique' as rule, '{'+'.join(key)}' as column_name, "
                  f"cast(coalesce(sum(n), 0) as bigint) as rows_checked, count(case when n > 1 then 1 end) as failures "
                  f"from (select count(*) as n from {sample} group by {', '.join(key)}) as c"
                  for key in UNIQUE[table] if (table, key[0]) not in _NO_KEY]
    for table, column, parent, key in FOREIGN_KEYS:
        miss = (f"{column} // 100 % 100 >= 24 or {column} % 100 >= 60 or {column} // 10000 not in (select d from days)"
                if parent == "dim_time" else f"not exists (select 1 from {CHECKED_TABLES[parent]} p where p.{key} = t.{column})")
        lines.append(f"select '{table}', 'foreign_key', '{column}', count(*), "
                     f"count(case when {column} is not null and ({miss}) then 1 end) from {CHECKED_TABLES[table]} t")
    lines.append("select 'dim_time', 'unique', 'time_sk', count(*) * 1440, 0 from days")
    return ("with days as (select distinct cast(strftime(pickup_timestamp, '%Y%m%d') as bigint) as d from fact_trips "
            "where pickup_timestamp is not null)\n" + "\nunion all\n".join(lines))


query("constraint_keys", *dict.fromkeys([*CHECKED_TABLES.values(), "fact_trips"]), sql=_key_sql())(constraint_keys)

COLUMN_TABLES = {
    "security_users": ["user_sk", "user_id", "email", "first_name", "last_name", "user_status", "account_type"],
    "dim_drivers": ["driver_sk", "driver_id", "first_name", "last_name", "driver_rating", "city_code"],
    "dim_riders": ["rider_sk", "rider_id", "first_name", "last_name", "loyalty_tier"],
    "security_audit_log": ["audit_sk", "event_type", "ip_address", "risk_score"],
    "staging_raw_trips": ["trip_id", "status"],
}


def _column_sql() -> str:
    lines = []
    for table, columns in COLUMN_TABLES.items():
        lines += [_row_sql(table, "not_null", c, f"{c} is null") for c in REQUIRED.get(table, ()) if c in columns]
        lines += [_row_sql(table, "max_length", c, f"length({c}) > {n}") for c, n in TEXT_LIMITS[table].items() if c in columns]
        lines += [_row_sql(table, "accepted_values", c, f"lower(rtrim({c})) not in ({', '.join(repr(v) for v in ACCEPTED[c])})")
                  for c in columns if c in ACCEPTED]
        lines += [_row_sql(table, "in_range", c, f"not {c} between {low} and {high}")
                  for c, (low, high) in RANGES.get(table, {}).items() if c in columns]
    return "\nunion all\n".join(lines)


query("constraint_columns", *COLUMN_TABLES, sql=_column_sql())(
    lambda wh: constraints.row_report({t: wh[t].select(columns) for t, columns in COLUMN_TABLES.items()}))

query("orphan_trips", "fact_trips", "dim_drivers", sql="""
select t.* from fact_trips t
where t.driver_sk is not null
  and not exists (select 1 from dim_drivers d where d.is_current and d.driver_sk = t.driver_sk)""")(
    lambda wh: quality.orphans(wh["fact_trips"], "driver_sk", wh["dim_drivers"].where("is_current"), "driver_sk"))


def new_trip_keys(wh):
    staging = wh["staging_raw_trips"]
    loaded = assign_surrogate_keys(staging.where("processed"), "trip_id", "trip_sk")
    return assign_surrogate_keys(staging, "trip_id", "trip_sk", existing=loaded)


query("assign_surrogate_keys", "staging_raw_trips", sql=f"""
with loaded as ({numbered('(select * from staging_raw_trips where processed) as p', 'trip_id', 'trip_sk')}),
fresh as (select trip_id from staging_raw_trips where trip_id not in (select trip_id from loaded))
{numbered('fresh', 'trip_id', 'trip_sk', '(select coalesce(max(trip_sk), 0) from loaded)')}""")(new_trip_keys)


def versions_sql(feed: str, key: str, order: str, tracked: list[str]) -> str:
    names = ", ".join(tracked)
    before = ", ".join(f"lag({c}) over w as before_{c}" for c in tracked)
    changed = " or ".join(f"{c} is distinct from before_{c}" for c in tracked)
    return f"""
picked as (select {key}, changed_at, {names},
                  row_number() over (partition by {key}, changed_at order by {order}) as rn from {feed}),
seen as (select {key}, changed_at, {names}, {before}, row_number() over w as nth from picked where rn = 1
         window w as (partition by {key} order by changed_at)),
versions as (
  select {key}, {names}, changed_at as effective_start_date,
         coalesce(lead(changed_at) over w, timestamp '9999-12-31 00:00:00') as effective_end_date,
         lead(changed_at) over w is null as is_current
  from seen where nth = 1 or {changed}
  window w as (partition by {key} order by changed_at))"""


RIDER_VERSIONS = versions_sql("rider_changes", "rider_id", "change_seq desc", dimensions.RIDER_TRACKED)
DRIVER_VERSIONS = versions_sql("driver_changes", "driver_id", "change_seq desc, change_sub desc",
                               dimensions.DRIVER_TRACKED)

query("scd2_riders", "rider_changes", sql=f"with {RIDER_VERSIONS}\nselect * from versions")(
    lambda wh: dimensions.scd2_riders(wh["rider_changes"]))

query("scd2_drivers", "driver_changes", sql=f"with {DRIVER_VERSIONS}\nselect * from versions")(
    lambda wh: dimensions.scd2_drivers(wh["driver_changes"]))


def sparse_sql(log: str, key: str, attributes: dict[str, str]) -> str:
    """Versions with every attribute: each attribute's last setting up to a time; '~' stands for a setting to NULL."""
    set_to = ", ".join(f"max(case when attribute = '{a}' then v end) as {a}" for a in attributes)
    last = ", ".join(f"last_value({a} ignore nulls) over w as {a}" for a in attributes)
    typed = ", ".join(f"try_cast(nullif({a}, '~') as {'varchar' if t == 'string' else t}) as {a}" for a, t in attributes.items())
    return f"""
named as (select {key}, changed_at, attribute, coalesce(value, '~') as v,
                 row_number() over (partition by {key}, changed_at, attribute order by change_seq desc) as rn
          from {log}),
set_at as (select {key}, changed_at, {set_to} from named where rn = 1 group by {key}, changed_at),
filled as (select {key}, changed_at, {last} from set_at window w as (partition by {key} order by changed_at)),
typed as (select {key}, changed_at, {typed} from filled),
{versions_sql('typed', key, 'changed_at', list(attributes))}"""


for _name, _log, _key, _table, _build in (
        ("scd2_driver_attributes", "driver_attributes", "driver_id", "dim_drivers", dimensions.driver_histories),
        ("scd2_rider_attributes", "rider_attributes", "rider_id", "dim_riders", dimensions.rider_histories)):
    query(_name, _log, sql=f"with {sparse_sql(_log, _key, dimensions.version_attributes(_table, _key))}\nselect * from versions")(
        lambda wh, build=_build, log=_log: build(wh[log]))


def scd2_late_changes(wh):
    """A first load without the late changes, then a merge of them; equals one full build."""
    log = wh["rider_changes"]
    first = durable(with_version_keys(dimensions.scd2_riders(log.where(~F.col("arrives_late"))),
                                      "rider_id", "rider_sk"), "riders")
    merged = merge_versions(first, log, log.where("arrives_late"), "rider_id", "rider_sk", "changed_at",
                            ["change_seq"], dimensions.RIDER_TRACKED)
    return merged.drop("rider_sk")


query("scd2_late_changes", "rider_changes", sql=f"with {RIDER_VERSIONS}\nselect * from versions")(scd2_late_changes)

LOCATION_ID = "substr(sha256(cast({0} as varchar) || '_' || cast({1} as varchar)), 1, 50)"

query("load_locations", "staging_raw_trips", sql=f"""
select {LOCATION_ID.format('latitude', 'longitude')} as location_id, latitude, longitude,
       max(location_type) as location_type
from (select pickup_lat as latitude, pickup_lng as longitude, 'pickup' as location_type from staging_raw_trips
      union all
      select dropoff_lat, dropoff_lng, 'dropoff' from staging_raw_trips) as p
where latitude is not null and longitude is not null
group by latitude, longitude""")(lambda wh: dimensions.load_locations(wh["staging_raw_trips"]))

TIME_SQL = """
select cast(strftime(m, '%Y%m%d%H%M') as bigint) as time_sk, cast(m as date) as full_date,
       cast(year(m) as integer) as year, cast(quarter(m) as integer) as quarter, cast(month(m) as integer) as month,
       strftime(m, '%B') as month_name, cast(weekofyear(m) as integer) as week_of_year,
       cast(day(m) as integer) as day_of_month, cast(dayofyear(m) as integer) as day_of_year,
       cast(isodow(m) as integer) as day_of_week, strftime(m, '%A') as day_name,
       cast(hour(m) as integer) as hour_24, cast((hour(m) + 11) % 12 + 1 as integer) as hour_12,
       case when hour(m) < 12 then 'AM' else 'PM' end as am_pm, cast(minute(m) as integer) as minute,
       isodow(m) >= 6 as is_weekend, h.holiday_name is not null as is_holiday, h.holiday_name,
       case when hour(m) between 6 and 11 then 'morning' when hour(m) between 12 and 17 then 'afternoon'
            when hour(m) between 18 and 21 then 'evening' else 'night' end as business_hours,
       case when isodow(m) < 6 and hour(m) between 7 and 9 then 'morning_rush'
            when isodow(m) < 6 and hour(m) between 16 and 18 then 'evening_rush' else 'off_peak' end as rush_hour
from (select d + i * interval '1' minute as m
      from (select distinct cast({column} as date) as d from {table} where {column} is not null) as days,
           range(1440) as r(i)) as minutes
left join holidays h on h.holiday_date = cast(m as date)"""

query("dim_time", "holidays", sql=TIME_SQL.replace("{column}", "ts").replace("{table}", "events"))(
    lambda wh: dimensions.dim_time(dimensions.minutes_of(wh["events"], "ts"), wh["holidays"]))

query("upsert_reference_dims", "dim_payment_methods", "method_updates", sql="""
select coalesce(u.payment_method_id, m.payment_method_id) as payment_method_id,
       case when u.payment_method_id is null then m.payment_type else u.payment_type end as payment_type,
       case when u.payment_method_id is null then m.provider else u.provider end as provider
from dim_payment_methods m
full outer join (select * from (select *, row_number() over (partition by payment_method_id
                                                             order by update_seq desc) as rn
                                from method_updates) as r where rn = 1) u
  on u.payment_method_id = m.payment_method_id""")(
    lambda wh: dimensions.upsert_by_key(
        wh["dim_payment_methods"].select("payment_method_id", "payment_type", "provider"),
        wh["method_updates"], "payment_method_id", ["update_seq"]))


def fact_trips_load(wh):
    # The raw record decides between deliveries; the load itself does not read it.
    staging = durable(facts.ingest_staging(facts.valid_rows(wh["staging_raw_trips"])).drop("raw_data", "processed"), "clean-staging")
    riders = durable(with_version_keys(durable(dimensions.scd2_riders(wh["rider_changes"]), "riders"), "rider_id", "rider_sk"), "rider-keys")
    places = wh["dim_locations"].withColumn("location_id", location_key("latitude", "longitude"))
    return facts.load_fact_trips(staging, {
        "dim_drivers": wh["dim_drivers"], "dim_riders": riders, "dim_locations": places,
        "dim_trip_status": wh["dim_trip_status"]})


MEASURES = """
measured as (
  select *, base_fare + coalesce(distance_fare, 0) + coalesce(time_fare, 0) as metered from parts),
surged as (
  select *, cast(metered * (surge_multiplier - 1) as decimal(10,2)) as surge_fare from measured),
totals as (
  select *, cast(metered + surge_fare + coalesce(tolls_fare, 0) + coalesce(tips_amount, 0)
                 - coalesce(discount_amount, 0) as decimal(10,2)) as total_fare from surged),
shares as (
  select *, cast(cast((total_fare - coalesce(tips_amount, 0)) * 0.80 as decimal(10,2))
                 + coalesce(tips_amount, 0) as decimal(10,2)) as driver_earnings from totals)"""

query("load_fact_trips", "staging_raw_trips", "rider_changes", "dim_drivers", "dim_locations", "dim_trip_status",
      sql=f"""
with {RIDER_VERSIONS},
version_ids as (select *, cast(rider_id as varchar) || '@' || strftime(effective_start_date, '%Y-%m-%d %H:%M:%S.%f')
                       as version_id from versions),
rider_keys as ({numbered('version_ids', 'version_id', 'rider_sk')}),
riders as (select v.*, k.rider_sk from version_ids v join rider_keys k on k.version_id = v.version_id),
{CHECKED},
{LATEST.replace('from staging_raw_trips', 'from checked where fare_ok and raw_ok')},
trip_keys as ({numbered('latest', 'trip_id', 'trip_sk', digits=4)}),
places as (select location_sk, {LOCATION_ID.format('latitude', 'longitude')} as location_id from dim_locations),
raw_parts as (select *,
       {FARE_PARTS} from latest),
keyed as (
  select k.trip_sk, r.*, coalesce(d.driver_sk, -1) as driver_sk, coalesce(v.rider_sk, -1) as rider_sk,
         case when r.pickup_lat is not null then coalesce(pl.location_sk, -1) end as pickup_location_sk,
         case when r.dropoff_lat is not null then coalesce(dl.location_sk, -1) end as dropoff_location_sk,
         coalesce(s.trip_status_sk, -1) as trip_status_sk
  from raw_parts r
  join trip_keys k on k.trip_id = r.trip_id
  left join dim_drivers d on d.driver_id = r.driver_id
       and coalesce(r.pickup_at, r.requested_at) >= d.effective_start_date
       and coalesce(r.pickup_at, r.requested_at) < d.effective_end_date
  left join riders v on v.rider_id = r.rider_id
       and coalesce(r.pickup_at, r.requested_at) >= v.effective_start_date
       and coalesce(r.pickup_at, r.requested_at) < v.effective_end_date
  left join places pl on pl.location_id = {LOCATION_ID.format('r.pickup_lat', 'r.pickup_lng')}
  left join places dl on dl.location_id = {LOCATION_ID.format('r.dropoff_lat', 'r.dropoff_lng')}
  left join dim_trip_status s on s.status_code = r.status),
parts as (select * exclude (surge_multiplier), cast(coalesce(surge_multiplier, 1) as decimal(4,2)) as surge_multiplier
          from keyed),
{MEASURES}
select trip_sk, trip_id, cast(driver_sk as bigint) as driver_sk, cast(rider_sk as bigint) as rider_sk,
       cast(pickup_location_sk as bigint) as pickup_location_sk,
       cast(dropoff_location_sk as bigint) as dropoff_location_sk,
       cast(strftime(pickup_at, '%Y%m%d%H%M') as bigint) as pickup_time_sk,
       cast(strftime(dropoff_at, '%Y%m%d%H%M') as bigint) as dropoff_time_sk,
       cast(trip_status_sk as bigint) as trip_status_sk, requested_at as requested_timestamp,
       pickup_at as pickup_timestamp, dropoff_at as dropoff_timestamp,
       cast(epoch_us(dropoff_at - pickup_at) // 60000000 as integer) as actual_duration_minutes,
       cast(epoch_us(pickup_at - requested_at) // 60000000 as integer) as wait_time_minutes,
       base_fare, distance_fare, time_fare, surge_multiplier, surge_fare, tolls_fare, tips_amount, discount_amount,
       total_fare, driver_earnings, cast(total_fare - driver_earnings as decimal(10,2)) as company_commission
from shares""")(fact_trips_load)

# What the second of two loads brings, beside everything after the mark: some changes that come late, some drivers' first data.
LATE_CHANGE = "change_seq % 7 = 3"


def two_sources(wh):
    """The sources of a first load and the rows that come in after it."""
    first, rest = ({"dim_trip_status": wh["dim_trip_status"], "dim_payment_methods": wh["dim_payment_methods"],
                    "holidays": wh["holidays"], "places": place_attributes(wh["dim_locations"])} for _ in range(2))
    parts = {"staging_raw_trips": f"ingestion_timestamp < timestamp_ntz '{LOAD_MARK}'",
             "driver_attributes": f"changed_at < timestamp_ntz '{LOAD_MARK}' and not {LATE_CHANGE} and driver_id % 10 <> 3",
             "rider_attributes": f"changed_at < timestamp_ntz '{LOAD_MARK}' and not {LATE_CHANGE}",
             "raw_payments": f"payment_timestamp < timestamp_ntz '{LOAD_MARK}'"}
    for name, early in parts.items():
        first[name], rest[name] = wh[name].where(early), wh[name].where(f"not coalesce({early}, false)")
    return first, rest


def named_facts(job):
    """Loaded trips under the names of what their keys point to."""
    t = job.table
    drivers = t("dim_drivers").select("driver_sk", "driver_id", F.col("effective_start_date").alias("driver_from"),
                                      F.col("last_name").alias("driver_last_name"))
    riders = t("dim_riders").select("rider_sk", "rider_id", F.col("effective_start_date").alias("rider_from"), "loyalty_tier")
    places = t("dim_locations").select("location_sk", "location_id")
    return (t("fact_trips").join(drivers, "driver_sk").join(riders, "rider_sk")
            .join(places.toDF("pickup_location_sk", "pickup_id"), "pickup_location_sk", "left")
            .join(places.toDF("dropoff_location_sk", "dropoff_id"), "dropoff_location_sk", "left")
            .join(t("dim_trip_status").select("trip_status_sk", "status_code"), "trip_status_sk")
            .select("trip_id", "driver_id", "driver_from", "driver_last_name", "rider_id", "rider_from", "loyalty_tier", "pickup_id",
                    "dropoff_id", "status_code", "pickup_timestamp", "total_fare", "driver_earnings"))


def two_step_load(wh):
    """A full load, then an increment with later states, late changes and drivers unknown before."""
    job = IncrementalLoad(wh.spark, scratch_dir(wh.spark, "two-step"), TRIP_CLOCK, grain="month")
    first, rest = two_sources(wh)
    job.run(first)
    job.add(rest, 1)
    return named_facts(job)


def _renamed(text: str, prefix: str) -> str:
    return re.sub(r"\b(named|set_at|filled|typed|picked|seen|versions)\b", prefix + r"_\1", text)


TWO_STEP_SQL = f"""
with {_renamed(sparse_sql('driver_attributes', 'driver_id', dimensions.version_attributes('dim_drivers', 'driver_id')), 'd')},
{_renamed(sparse_sql('rider_attributes', 'rider_id', dimensions.version_attributes('dim_riders', 'rider_id')), 'r')},
{CHECKED},
{LATEST.replace('from staging_raw_trips', 'from checked where fare_ok and raw_ok')},
raw_parts as (select *,
       {FARE_PARTS} from latest),
keyed as (
  select p.* exclude (driver_id, rider_id), coalesce(d.driver_id, -1) as driver_id, d.effective_start_date as driver_from,
         d.last_name as driver_last_name, coalesce(r.rider_id, -1) as rider_id, r.effective_start_date as rider_from, r.loyalty_tier
  from raw_parts p
  left join d_versions d on d.driver_id = p.driver_id and coalesce(p.pickup_at, p.requested_at) >= d.effective_start_date
       and coalesce(p.pickup_at, p.requested_at) < d.effective_end_date
  left join r_versions r on r.rider_id = p.rider_id and coalesce(p.pickup_at, p.requested_at) >= r.effective_start_date
       and coalesce(p.pickup_at, p.requested_at) < r.effective_end_date),
parts as (select * exclude (surge_multiplier), cast(coalesce(surge_multiplier, 1) as decimal(4,2)) as surge_multiplier
          from keyed),
{MEASURES}
select trip_id, driver_id, driver_from, driver_last_name, rider_id, rider_from, loyalty_tier,
       {LOCATION_ID.format('pickup_lat', 'pickup_lng')} as pickup_id, {LOCATION_ID.format('dropoff_lat', 'dropoff_lng')} as dropoff_id,
       status as status_code, pickup_at as pickup_timestamp, total_fare, driver_earnings
from shares"""

query("two_step_load", "staging_raw_trips", "driver_attributes", "rider_attributes", sql=TWO_STEP_SQL)(two_step_load)

MEASURE_COLUMNS = ["trip_id", "requested_timestamp", "pickup_timestamp", "dropoff_timestamp", "base_fare",
                   "distance_fare", "time_fare", "surge_multiplier", "tolls_fare", "tips_amount", "discount_amount"]

query("trip_measures", "fact_trips", sql=f"""
with parts as (select {', '.join(MEASURE_COLUMNS)} from fact_trips),
{MEASURES}
select * exclude (metered), cast(total_fare - driver_earnings as decimal(10,2)) as company_commission,
       cast(epoch_us(pickup_timestamp - requested_timestamp) // 60000000 as integer) as wait_time_minutes,
       cast(epoch_us(dropoff_timestamp - pickup_timestamp) // 60000000 as integer) as actual_duration_minutes
from shares""")(lambda wh: facts.trip_measures(wh["fact_trips"].select(MEASURE_COLUMNS)))


def trip_keys(wh):
    return assign_surrogate_keys(wh["staging_raw_trips"], "trip_id", "trip_sk")


query("load_fact_payments", "raw_payments", "staging_raw_trips", "dim_payment_methods", sql=f"""
with trips as ({numbered('staging_raw_trips', 'trip_id', 'trip_sk')}),
known_payments as (select * from raw_payments where trip_id in (select trip_id from trips)),
payment_keys as ({numbered('known_payments', 'payment_id', 'payment_sk', digits=4)})
select k.payment_sk, p.payment_id, t.trip_sk,
       cast(coalesce(m.payment_method_sk, -1) as bigint) as payment_method_sk,
       cast(strftime(p.payment_timestamp, '%Y%m%d%H%M') as bigint) as payment_time_sk,
       p.payment_amount, p.processing_fee, p.payment_status, p.payment_timestamp
from raw_payments p join trips t on t.trip_id = p.trip_id join payment_keys k on k.payment_id = p.payment_id
left join dim_payment_methods m on m.payment_method_id = p.payment_method_id""")(
    lambda wh: facts.load_fact_payments(wh["raw_payments"], trip_keys(wh), wh["dim_payment_methods"]))

query("payment_orphans", "raw_payments", "fact_trips", sql="""
select p.* from raw_payments p where not exists (select 1 from fact_trips t where t.trip_id = p.trip_id)""")(
    lambda wh: facts.payment_orphans(wh["raw_payments"], wh["fact_trips"]))

DRIVER_DAYS = """
select driver_sk, cast(pickup_timestamp as date) as activity_date, count(*) as total_trips,
       count(case when s.is_completed then 1 end) as completed_trips,
       count(case when s.is_cancelled then 1 end) as cancelled_trips,
       cast(sum(total_fare) as decimal(20,2)) as gross_earnings,
       cast(sum(driver_earnings) as decimal(20,2)) as net_earnings,
       cast(sum(actual_distance_miles) as decimal(18,2)) as total_miles_driven,
       cast(coalesce(sum(actual_duration_minutes), 0) as double) / 60 as hours_driving,
       cast(count(case when s.is_cancelled then 1 end) as double) * 100 / count(*) as cancellation_rate,
       cast(sum(rider_rating_given) as double) / nullif(count(rider_rating_given), 0) as average_rating
from fact_trips t left join dim_trip_status s on s.trip_status_sk = t.trip_status_sk
where pickup_timestamp is not null group by 1, 2"""

DAYS_WITH_FEED = f"""
select d.*, f.hours_online, cast(d.total_trips as double) * 100 / nullif(f.offered_trips, 0) as acceptance_rate
from ({DRIVER_DAYS}) as d
left join driver_feed f on f.driver_sk = d.driver_sk and f.activity_date = d.activity_date"""

query("driver_daily", "fact_trips", "dim_trip_status", "driver_feed", sql=DAYS_WITH_FEED)(
    lambda wh: facts.driver_daily(wh["fact_trips"], wh["dim_trip_status"], wh["driver_feed"]))

LATE = f"""
select * from staging_raw_trips
where coalesce(pickup_at, requested_at) < timestamp '{LOAD_MARK}' and ingestion_timestamp >= timestamp '{LOAD_MARK}'"""

query("late_arrivals", "staging_raw_trips", sql=LATE)(
    lambda wh: facts.late_rows(wh["staging_raw_trips"], LOAD_MARK))


def late_driver_days(wh):
    late = facts.late_rows(wh["staging_raw_trips"], LOAD_MARK).select("trip_id")
    touched = (wh["fact_trips"].where(F.col("pickup_timestamp").isNotNull()).join(late, "trip_id", "left_semi")
               .select("driver_sk", F.to_date("pickup_timestamp").alias("activity_date")))
    return facts.recompute_driver_days(wh["fact_trips"], touched, wh["dim_trip_status"])


query("late_driver_days", "staging_raw_trips", "fact_trips", "dim_trip_status", sql=f"""
with affected as (
  select distinct driver_sk as sk, cast(pickup_timestamp as date) as day from fact_trips
  where pickup_timestamp is not null and trip_id in (select trip_id from ({LATE}) as l))
select d.*, cast(null as decimal(5,2)) as hours_online, cast(null as double) as acceptance_rate
from ({DRIVER_DAYS}) as d join affected on sk = driver_sk and day = activity_date""")(late_driver_days)


def late_days_stored(wh):
    """Daily sums stored without the late trips; then the months these fall into are replaced, and all is read back."""
    trips, statuses, feed = wh["fact_trips"], wh["dim_trip_status"], wh["driver_feed"]
    late = durable(facts.late_rows(wh["staging_raw_trips"], LOAD_MARK).select("trip_id"), "late-trips")
    root = scratch_dir(wh.spark, "late-days")
    days = facts.driver_daily(trips.join(late, "trip_id", "left_anti"), statuses, feed)
    write_table(days, root, "fact_driver_daily", grain="month", whole=True)
    touched = (trips.where(F.col("pickup_timestamp").isNotNull()).join(late, "trip_id", "left_semi")
               .select(F.to_date("pickup_timestamp").alias("activity_date")))
    write_table(facts.recompute_days(trips, touched, statuses, feed, "month"), root, "fact_driver_daily", grain="month")
    return wh.spark.read.schema(days.schema).parquet(f"{root}/fact_driver_daily").select(days.columns)


query("late_driver_days_stored", "staging_raw_trips", "fact_trips", "dim_trip_status", "driver_feed",
      sql=DAYS_WITH_FEED)(late_days_stored)

query("unknown_members", "staging_raw_trips", "rider_changes", sql=f"""
with missing as (select distinct rider_id from staging_raw_trips
                 where rider_id not in (select rider_id from rider_changes where arrives_late)),
last as (select coalesce(max(rider_id), 0) as n from rider_changes where arrives_late)
select rider_id, cast((select n from last) + row_number() over (
         order by substr(md5(cast(rider_id as varchar)), 1, 3), rider_id) as bigint) as rider_sk,
       true as is_current, true as is_inferred
from missing""")(
    lambda wh: facts.unknown_members(
        wh["staging_raw_trips"],
        wh["rider_changes"].where("arrives_late").select("rider_id", F.col("rider_id").alias("rider_sk")),
        "rider_id", "rider_sk"))

def filled_members(wh):
    """Riders met before their first loaded change, given the tier of their first late one."""
    late = wh["rider_changes"].where("arrives_late")
    known = late.select("rider_id", F.col("rider_id").alias("rider_sk"))
    members = facts.unknown_members(wh["staging_raw_trips"], known, "rider_id", "rider_sk")
    first = (wh["rider_changes"].where("not arrives_late").groupBy("rider_id")
             .agg(F.min_by("loyalty_tier", F.struct("changed_at", "change_seq")).alias("loyalty_tier")))
    return facts.fill_inferred(members, first, "rider_id", ["loyalty_tier"])


query("fill_inferred", "staging_raw_trips", "rider_changes", sql="""
with missing as (select distinct rider_id from staging_raw_trips
                 where rider_id not in (select rider_id from rider_changes where arrives_late)),
last as (select coalesce(max(rider_id), 0) as n from rider_changes where arrives_late),
first as (select rider_id, loyalty_tier, row_number() over (partition by rider_id order by changed_at, change_seq) as rn
          from rider_changes where not arrives_late)
select m.rider_id, cast((select n from last) + row_number() over (
         order by substr(md5(cast(m.rider_id as varchar)), 1, 3), m.rider_id) as bigint) as rider_sk,
       true as is_current, f.rider_id is null as is_inferred, f.loyalty_tier
from missing m left join first f on f.rider_id = m.rider_id and f.rn = 1""")(filled_members)

query("incremental_load", "staging_raw_trips", sql="""
select * from staging_raw_trips
where trip_id not in (select trip_id from staging_raw_trips where processed)""")(
    lambda wh: facts.incremental_rows(wh["staging_raw_trips"], wh["staging_raw_trips"].where("processed")))


def freshness_report(wh):
    return monitoring.freshness_report([
        monitoring.table_freshness(wh["fact_trips"], "fact_trips", "pickup_timestamp", TRIP_CLOCK),
        monitoring.table_freshness(wh["staging_raw_trips"], "staging_raw_trips", "ingestion_timestamp", TRIP_CLOCK),
        monitoring.table_freshness(wh["security_audit_log"], "security_audit_log", "event_timestamp", EVENT_CLOCK),
    ], wh["report_runs"])


def _fresh_sql(table: str, column: str, clock: str) -> str:
    return (f"select '{table}' as table_name, timestamp '{clock}' as run_at, count(*) as row_count, max({column}) as newest, "
            f"cast(trunc(epoch_us(timestamp '{clock}' - max({column})) / 60000000.0) as integer) as lag_minutes "
            f"from {table}")


FRESH = "\nunion all\n".join((
    _fresh_sql("fact_trips", "pickup_timestamp", TRIP_CLOCK),
    _fresh_sql("staging_raw_trips", "ingestion_timestamp", TRIP_CLOCK),
    _fresh_sql("security_audit_log", "event_timestamp", EVENT_CLOCK)))

query("freshness_report", "fact_trips", "staging_raw_trips", "security_audit_log", "report_runs", sql=f"""
with fresh as ({FRESH}),
last as (select * from (select r.*, row_number() over (partition by r.table_name order by r.run_at desc) as rn
                        from report_runs r join fresh f on f.table_name = r.table_name and r.run_at < f.run_at) as s
         where rn = 1)
select f.* exclude (run_at), p.row_count as previous_rows, f.row_count - p.row_count as growth
from fresh f left join last p on p.table_name = f.table_name""")(freshness_report)

query("growth_report", "staging_raw_trips", sql="""
select table_name, run_at, row_count, lag(row_count) over w as previous_rows,
       row_count - lag(row_count) over w as growth
from (select 'staging_raw_trips' as table_name, date_trunc('month', ingestion_timestamp)::timestamp as run_at,
             count(*) as row_count from staging_raw_trips group by 2) as r
window w as (partition by table_name order by run_at)""")(
    lambda wh: monitoring.growth_report(
        wh["staging_raw_trips"]
        .groupBy(F.lit("staging_raw_trips").alias("table_name"),
                 F.date_trunc("month", "ingestion_timestamp").cast("timestamp_ntz").alias("run_at"))
        .agg(F.count(F.lit(1)).alias("row_count"))))

query("archive_split", "fact_trips", sql=f"""
select *, coalesce(pickup_timestamp < timestamp '{TRIP_CLOCK}' - interval '730' day, false) as is_archived
from fact_trips""")(
    lambda wh: retention.archive_split(wh["fact_trips"], "pickup_timestamp", TRIP_CLOCK, 730))

def archived_by_folder(wh):
    """Trips stored by month, archived twice with a growing clock; both parts read back."""
    spark, root, archive = wh.spark, scratch_dir(wh.spark, "trips"), scratch_dir(wh.spark, "archived-trips")
    trips = wh["fact_trips"]
    write_table(trips, root, "fact_trips", grain="month", whole=True)
    for clock in ("2000-03-10 06:00:00", TRIP_CLOCK):
        retention.archive_folders(spark, root, archive, "fact_trips", clock, 730, "month")
    parts = [spark.read.parquet(f"{place}/fact_trips").select(trips.columns).withColumn("is_archived", F.lit(old))
             for place, old in ((root, False), (archive, True))]
    return parts[0].unionByName(parts[1])


query("archive_by_folder", "fact_trips", sql=f"""
select *, coalesce(pickup_timestamp < timestamp '{TRIP_CLOCK}' - interval '730' day, false) as is_archived
from fact_trips""")(archived_by_folder)


def purged_by_folder(wh):
    """The audit log stored by day, less what is past its retention period."""
    root, log = scratch_dir(wh.spark, "audit"), wh["security_audit_log"]
    write_table(log, root, "security_audit_log", whole=True)
    retention.purge_folders(wh.spark, root, "security_audit_log", wh["data_classification"], EVENT_CLOCK)
    return wh.spark.read.parquet(f"{root}/security_audit_log").select(log.columns)


query("purge_by_folder", "security_audit_log", "data_classification", sql=f"""
select * from security_audit_log
where event_timestamp >= timestamp '{EVENT_CLOCK}' - interval '1' day *
      (select min(retention_period_days) from data_classification where table_name = 'security_audit_log')
   or event_timestamp is null""")(purged_by_folder)

query("retention_purge", "security_audit_log", "data_classification", sql=f"""
select * from security_audit_log
where event_timestamp < timestamp '{EVENT_CLOCK}' - interval '1' day *
      (select min(retention_period_days) from data_classification where table_name = 'security_audit_log')""")(
    lambda wh: retention.retention_purge(wh["security_audit_log"], "security_audit_log", "event_timestamp",
                                         wh["data_classification"], EVENT_CLOCK))


def stored_daily_revenue(wh):
    """Daily revenue stored by month and read back."""
    view = views.v_daily_revenue(wh).withColumn("trip_month", F.trunc("trip_date", "month"))
    return monitoring.materialize(view, scratch_dir(wh.spark, "daily-revenue"), "trip_month")


query("materialize_views", "fact_trips", "dim_locations", "dim_trip_status", sql=f"""
select *, cast(date_trunc('month', trip_date) as date) as trip_month from ({DAILY_REVENUE}) as v""")(stored_daily_revenue)

query("mask_columns", "security_users", sql="""
select user_sk, case when length(user_id) <= 4 then '****' else '****' || right(user_id, 4) end as user_id,
       sha256(email) as email, first_name, cast(null as varchar) as last_name, user_status, account_type,
       cast(date_trunc('year', last_login_at) as date) as last_login_at, email_verified, mfa_enabled
from security_users""")(
    lambda wh: masking.mask_columns(wh["security_users"],
                                    masking.rules_of(wh["data_classification"], "security_users")))

query("apply_row_policies", "row_requests", "dim_locations", "user_attributes", sql="""
select q.request_id, q.user_sk, q.location_sk, l.city
from row_requests q join dim_locations l on l.location_sk = q.location_sk
where exists (select 1 from user_attributes a where a.user_sk = q.user_sk and a.is_active
              and a.attribute_name = 'city' and a.attribute_value = l.city)""")(
    lambda wh: policies.permitted_requests(
        wh["row_requests"].join(wh["dim_locations"].select("location_sk", "city"), "location_sk"),
        "city", wh["user_attributes"], "city"))

query("rows_visible_to", "dim_locations", "user_attributes", sql="""
select l.* from dim_locations l
where l.city in (select attribute_value from user_attributes
                 where user_sk = 1 and is_active and attribute_name = 'city')""")(
    lambda wh: policies.rows_visible_to(wh["dim_locations"], "city", wh["user_attributes"], "city", 1))

query("first_policy", "dim_locations", "access_policies", sql="""
with parsed as (
  select policy_sk, priority_order, trim(split_part(policy_condition, '=', 1)) as c,
         trim(trim(split_part(policy_condition, '=', 2)), '''') as v
  from access_policies
  where is_active and resource_pattern = 'dim_locations' and action_type = 'READ' and policy_sk < 2000),
matched as (
  select l.location_sk, p.policy_sk, p.priority_order,
         row_number() over (partition by l.location_sk order by p.priority_order, p.policy_sk) as rn
  from dim_locations l join parsed p
    on (p.c = 'city' and p.v = l.city) or (p.c = 'zone_id' and p.v = l.zone_id))
select location_sk, policy_sk, priority_order from matched where rn = 1""")(
    lambda wh: policies.first_policy(
        wh["dim_locations"], "location_sk", ["city", "zone_id"],
        policies.parsed_policies(wh["access_policies"], "dim_locations", "READ")))

query("rows_by_policy", "dim_locations", "access_policies", sql="""
with parsed as (
  select policy_sk, priority_order, action_type, trim(split_part(policy_condition, '=', 1)) as c,
         trim(trim(split_part(policy_condition, '=', 2)), '''') as v
  from access_policies
  where is_active and resource_pattern = 'dim_locations' and (policy_sk < 2000 or policy_sk >= 3000)),
matched as (
  select l.location_sk, p.policy_sk, p.priority_order, p.action_type,
         row_number() over (partition by l.location_sk order by p.priority_order, p.policy_sk) as rn
  from dim_locations l join parsed p
    on (p.c = 'city' and p.v = l.city) or (p.c = 'zone_id' and p.v = l.zone_id))
select l.*, m.policy_sk, m.priority_order, coalesce(m.action_type = 'READ', false) as is_allowed
from dim_locations l left join matched m on m.location_sk = l.location_sk and m.rn = 1""")(
    lambda wh: policies.rows_by_policy(wh["dim_locations"], "location_sk", ["city", "zone_id"], wh["access_policies"],
                                       "dim_locations", "READ"))

query("mask_for_readers", "security_users", sql="""
select user_sk, case when account_type = 'STAFF' then user_id
                     when length(user_id) <= 4 then '****' else '****' || right(user_id, 4) end as user_id,
       case when account_type = 'STAFF' then email else sha256(email) end as email, first_name,
       case when account_type = 'STAFF' then last_name end as last_name, user_status, account_type,
       case when account_type = 'STAFF' then last_login_at else date_trunc('year', last_login_at)::timestamp end as last_login_at,
       email_verified, mfa_enabled
from security_users""")(
    lambda wh: masking.mask_for_readers(wh["security_users"], masking.rules_of(wh["data_classification"], "security_users"),
                                        F.col("account_type") == "STAFF"))

query("password_digests", "security_users", sql="""
select user_sk, sha256('pw' || cast(user_sk % 5 as varchar) || 's' || cast(user_sk as varchar)) as digest from security_users""")(
    lambda wh: wh["security_users"].select("user_sk", password_digest(
        F.concat(F.lit("pw"), (F.col("user_sk") % 5).cast("string")), F.concat(F.lit("s"), F.col("user_sk").cast("string"))).alias("digest")))

query("upsert_payment_methods", "dim_payment_methods", "method_updates", sql="""
with last as (select * from (select *, row_number() over (partition by payment_method_id order by update_seq desc) as rn
                             from method_updates) as r where rn = 1)
select coalesce(m.payment_method_sk, (select max(payment_method_sk) from dim_payment_methods) + row_number() over (
         partition by m.payment_method_sk is null
         order by substr(md5(cast(u.payment_method_id as varchar)), 1, 3), u.payment_method_id)) as payment_method_sk,
       coalesce(u.payment_method_id, m.payment_method_id) as payment_method_id,
       case when u.payment_method_id is null then m.payment_type else u.payment_type end as payment_type,
       case when u.payment_method_id is null then m.provider else u.provider end as provider, m.is_active
from dim_payment_methods m full outer join last u on u.payment_method_id = m.payment_method_id""")(
    lambda wh: dimensions.upsert_members(wh["dim_payment_methods"], wh["method_updates"], "payment_method_id", "payment_method_sk",
                                         ["update_seq"]))

# Trip states met in staging and in orders; those the dimension lacks get keys.
query("upsert_trip_status", "dim_trip_status", "staging_raw_trips", sql="""
with met as (select distinct upper(rtrim(status)) as status_code from staging_raw_trips where status is not null
             union select distinct 'STATE_' || o_orderstatus from orders)
select coalesce(s.trip_status_sk, (select max(trip_status_sk) from dim_trip_status) + row_number() over (
         partition by s.trip_status_sk is null order by substr(md5(m.status_code), 1, 3), m.status_code)) as trip_status_sk,
       coalesce(m.status_code, s.status_code) as status_code, s.is_completed, s.is_cancelled
from dim_trip_status s full outer join met m on m.status_code = s.status_code""")(
    lambda wh: dimensions.upsert_members(
        wh["dim_trip_status"],
        wh["staging_raw_trips"].select(code("status").alias("status_code")).unionByName(
            wh["orders"].select(F.concat(F.lit("STATE_"), "o_orderstatus").alias("status_code"))).distinct().withColumn("_turn", F.lit(0)),
        "status_code", "trip_status_sk", ["_turn"]))


def streamed_facts(wh):
    """A full load; then the later staging rows come as a stream of two deliveries, the first with all other new rows."""
    spark, (first, rest) = wh.spark, two_sources(wh)
    job = IncrementalLoad(spark, scratch_dir(spark, "streamed"), TRIP_CLOCK, grain="month")
    job.run(first)
    source, progress = scratch_dir(spark, "deliveries"), scratch_dir(spark, "deliveries-progress")
    part = F.pmod(F.xxhash64("trip_id", "ingestion_timestamp"), F.lit(2))
    for k in range(2):
        rest["staging_raw_trips"].where(part == k).write.mode("append").parquet(source)
        stream_facts(job, jobs.file_stream(spark, source, wh["staging_raw_trips"].schema),
                     lambda batch: rest if batch == 1 else {n: df.limit(0) if n in LOGS else df for n, df in rest.items()}, progress)
    return named_facts(job)


query("stream_fact_load", "staging_raw_trips", "driver_attributes", "rider_attributes", sql=TWO_STEP_SQL)(streamed_facts)
