"""Maps the test tables onto the warehouse's tables.

Each mapping is one SELECT that Spark and DuckDB both accept. ``{name}`` stands
for a test table or for another mapping. The mapping is input, not logic under
test: every query starts from these tables on both engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from farelake.session import configure, freed_shuffles, scratch_dir
from farelake.sources.seeds import PERMISSIONS, ROLES
from farelake.sources.tables import CODEC

# Columns of the test tables this repo reads.
TEST_TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _literal(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"cast({value} as bigint)"
    return "'" + value.replace("'", "''") + "'"


def _values(rows, columns: str) -> str:
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return f"select * from (values {body}) as t({columns})"


def _latitude(prefix: str, key: str) -> str:
    return f"cast('{prefix}.' || lpad(cast({key} % 1000 as varchar(20)), 3, '0') as decimal(10,8))"


def _longitude(prefix: str, key: str) -> str:
    return f"cast('{prefix}.' || lpad(cast({key} as varchar(20)), 8, '0') as decimal(11,8))"


def _minute(ts: str) -> str:
    return (f"cast(year({ts}) as bigint) * 100000000 + month({ts}) * 1000000 + day({ts}) * 10000 + hour({ts}) * 100 "
            f"+ minute({ts})")


_DRIVER = """
    select s_suppkey * 2 + {v} as driver_sk, cast(s_suppkey as int) as driver_id, s_name as first_name,
           case when s_suppkey % 10 = 7 then null else 'V{v}' end as last_name,
           cast(3 + (s_suppkey % 21) * 0.1 as decimal(3,2)) as driver_rating,
           cast(s_suppkey * 7 % 500 as int) as total_trips,
           'C' || cast(s_nationkey as varchar(9)) as city_code,
           {start} as effective_start_date, {end} as effective_end_date, {current} as is_current
    from {{supplier}} where {keep}"""

_RIDER = """
    select c_custkey * 2 + {v} as rider_sk, cast(c_custkey as int) as rider_id, c_mktsegment as first_name,
           case when c_custkey % 50 = 7 then null else c_name end as last_name,
           case c_custkey % 4 when 0 then {tier} when 1 then 'silver' when 2 then 'gold' else 'platinum' end
               as loyalty_tier,
           {start} as effective_start_date, {end} as effective_end_date, {current} as is_current
    from {{customer}} where {keep}"""

_FIRST_DAY = "timestamp '1900-01-01 00:00:00'"
_LAST_DAY = "timestamp '9999-12-31 00:00:00'"
_DRIVER_CHANGE = "timestamp '1999-01-01 00:00:00'"
_RIDER_CHANGE = "timestamp '1998-01-01 00:00:00'"

def _monthly(table: str, column: str) -> str:
    month = f"cast(date_trunc('month', {column}) as timestamp)"
    return f"select '{table}' as table_name, {month} as month, count(*) as row_count from {{{table}}} group by {month}"


def _log(key: str, at: str, seq: str, attributes: dict[str, str], table: str, keep: str = "true") -> str:
    """Rows (key, changed_at, change_seq, attribute, value) that set each attribute to the text of its expression."""
    return "\n    union all\n".join(
        f"    select cast({key} as int) as {{id}}, {at} as changed_at, {seq} as change_seq, '{name}' as attribute,\n"
        f"           cast({value} as varchar(60)) as value from {{{{{table}}}}} where {keep}" for name, value in attributes.items())


_DRIVER_START = {
    "driver_license": "'L' || cast(s_suppkey as varchar(20))", "first_name": "s_name", "last_name": "'D' || cast(s_suppkey % 97 as varchar(9))",
    "email": "lower(s_name) || '@x.io'", "phone": "'555' || cast(s_suppkey as varchar(20))",
    "date_of_birth": "date '1960-01-01' + cast(s_suppkey % 9000 as int)", "driver_rating": "cast(3 + (s_suppkey % 21) * 0.1 as decimal(3,2))",
    "total_trips": "s_suppkey * 7 % 500", "vehicle_make": "'M' || cast(s_suppkey % 11 as varchar(9))",
    "vehicle_model": "'T' || cast(s_suppkey % 13 as varchar(9))", "vehicle_year": "1990 + s_suppkey % 9",
    "vehicle_license_plate": "'P' || cast(s_suppkey as varchar(20))", "vehicle_type": "'economy'", "driver_status": "'active'",
    "city_code": "'C' || cast(s_nationkey as varchar(9))", "registration_date": "date '1991-06-01'",
}
_RIDER_START = {
    "first_name": "c_mktsegment", "last_name": "c_name", "email": "lower(c_name) || '@x.io'", "phone": "'556' || cast(c_custkey as varchar(20))",
    "date_of_birth": "date '1955-01-01' + cast(c_custkey % 15000 as int)", "rider_rating": "cast(4 + (c_custkey % 10) * 0.1 as decimal(3,2))",
    "total_trips": "c_custkey % 300", "loyalty_tier": "'bronze'", "preferred_payment_method": "'cash'", "rider_status": "'active'",
    "signup_date": "date '1991-07-01'", "city_code": "'C' || cast(c_nationkey as varchar(9))",
}
# Later changes: of one attribute a line or order, some to NULL, some that the attribute's type cannot hold.
_DRIVER_LATER = {
    "driver_status": ("case l_returnflag when 'A' then 'active' when 'N' then 'inactive' else 'suspended' end", "l_partkey % 4 = 0"),
    "vehicle_type": ("case when l_linestatus = 'F' then 'economy' else null end", "l_partkey % 4 = 1"),
    "driver_rating": ("case when l_partkey % 40 = 2 then 'none' else cast(cast(3 + l_discount * 10 as decimal(3,2)) as varchar(9)) end",
                      "l_partkey % 4 = 2"),
    "phone": ("'557' || cast(l_partkey % 5 as varchar(9))", "l_partkey % 8 = 3"),
    "vehicle_make": ("'M' || cast(l_partkey % 3 as varchar(9))", "l_partkey % 8 = 7"),
}
_RIDER_LATER = {
    "loyalty_tier": ("case when o_totalprice < 100000 then 'bronze' when o_totalprice < 250000 then 'silver' else 'gold' end", "o_orderkey % 3 = 0"),
    "preferred_payment_method": ("case when o_orderkey % 5 = 0 then null else 'credit_card' end", "o_orderkey % 3 = 1"),
    "rider_rating": ("cast(cast(3 + o_orderkey % 20 * 0.1 as decimal(3,2)) as varchar(9))", "o_orderkey % 3 = 2"),
}


def _history(key: str, start_key: str, first: dict, start_table: str, later_key: str, at: str, seq: str, later: dict, table: str) -> str:
    parts = [_log(start_key, "timestamp '1991-08-01 00:00:00'", "cast(0 as bigint)", first, start_table)]
    parts += [_log(later_key, at, seq, {name: value}, table, keep) for name, (value, keep) in later.items()]
    return "\n    union all\n".join(parts).replace("{id}", key).replace("{{", "{").replace("}}", "}")


MAPPINGS = {
    "driver_attributes": _history("driver_id", "s_suppkey", _DRIVER_START, "supplier", "l_suppkey", "l_shipdate",
                                  "l_orderkey * 10 + l_linenumber", _DRIVER_LATER, "lineitem"),
    "rider_attributes": _history("rider_id", "c_custkey", _RIDER_START, "customer", "o_custkey", "o_orderdate", "o_orderkey",
                                 _RIDER_LATER, "orders"),
    "dim_drivers": "\n    union all\n".join((
        _DRIVER.format(v=1, keep="true", start=_FIRST_DAY, current="s_suppkey % 3 <> 0",
                       end=f"case when s_suppkey % 3 = 0 then {_DRIVER_CHANGE} else {_LAST_DAY} end"),
        _DRIVER.format(v=2, keep="s_suppkey % 3 = 0", start=_DRIVER_CHANGE, current="true", end=_LAST_DAY))),
    "dim_riders": "\n    union all\n".join((
        _RIDER.format(v=1, keep="true", start=_FIRST_DAY, current="c_custkey % 4 <> 0", tier="'bronze'",
                      end=f"case when c_custkey % 4 = 0 then {_RIDER_CHANGE} else {_LAST_DAY} end"),
        _RIDER.format(v=2, keep="c_custkey % 4 = 0", start=_RIDER_CHANGE, current="true", tier="'gold'",
                      end=_LAST_DAY))),
    "dim_locations": f"""
    select c_custkey as location_sk, c_name || ' pickup' as address, n_name as city,
           {_latitude('40', 'c_custkey')} as latitude, {_longitude('-73', 'c_custkey')} as longitude,
           'pickup' as location_type, 'Z' || cast(c_custkey % 10 as varchar(9)) as zone_id
    from {{customer}} join {{nation}} on c_nationkey = n_nationkey
    union all
    select 10000000 + s_suppkey, s_name || ' dropoff', n_name,
           {_latitude('41', 's_suppkey')}, {_longitude('-74', 's_suppkey')},
           'dropoff', 'Z' || cast(s_suppkey % 10 as varchar(9))
    from {{supplier}} join {{nation}} on s_nationkey = n_nationkey""",
    "dim_trip_status": _values(
        ((1, "COMPLETED", True, False), (2, "CANCELLED", False, True), (3, "IN_PROGRESS", False, False)),
        "trip_status_sk, status_code, is_completed, is_cancelled"),
    "dim_payment_methods": _values(
        ((1, 1, "credit_card", "visa", True), (2, 2, "debit_card", "mastercard", True),
         (3, 3, "digital_wallet", "paypal", True), (4, 4, "digital_wallet", "apple_pay", True)),
        "payment_method_sk, payment_method_id, payment_type, provider, is_active"),
    # Ride lines: one row per lineitem with the clocks every trip table derives from.
    "ride_lines": """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
           l_returnflag, l_shipdate, o_custkey,
           cast(l_orderkey as varchar(20)) || '-' || cast(l_linenumber as varchar(9)) as trip_id,
           case when l_returnflag = 'R' and l_linestatus = 'O' then null
                else l_shipdate + (l_partkey * 37 % 1440) * interval '1' minute end as pickup_ts,
           case when l_returnflag = 'A'
                then l_shipdate + (l_partkey * 37 % 1440 + 5 + l_partkey % 56) * interval '1' minute
                end as dropoff_ts,
           l_shipdate + (l_partkey * 37 % 1440 - l_partkey % 13) * interval '1' minute as requested_ts,
           cast(l_extendedprice as decimal(10,2)) as total_fare,
           cast(1 + cast(l_tax as decimal(3,2)) * 5 as decimal(4,2)) as surge_multiplier,
           cast(cast(l_quantity as int) % 3 as decimal(10,2)) as tolls,
           cast(cast(l_discount as decimal(3,2)) * 50 as decimal(10,2)) as tips,
           cast(cast(l_partkey % 5 as int) * 0.25 as decimal(10,2)) as discount
    from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    "fact_trips": """
    select trip_id,
           case when l_suppkey % 3 = 0 and l_shipdate >= timestamp '1999-01-01 00:00:00'
                then l_suppkey * 2 + 2 else l_suppkey * 2 + 1 end as driver_sk,
           case when o_custkey % 4 = 0 and l_shipdate >= timestamp '1998-01-01 00:00:00'
                then o_custkey * 2 + 2 else o_custkey * 2 + 1 end as rider_sk,
           o_custkey as pickup_location_sk,
           case when l_returnflag = 'R' then null else 10000000 + l_suppkey end as dropoff_location_sk,
           cast(case l_returnflag when 'A' then 1 when 'R' then 2 else 3 end as bigint) as trip_status_sk,
           requested_ts as requested_timestamp, pickup_ts as pickup_timestamp, dropoff_ts as dropoff_timestamp,
           case when l_returnflag = 'R' then requested_ts + interval '3' minute end as cancelled_timestamp,
           case when l_returnflag = 'A' then cast(5 + l_partkey % 56 as int) end as actual_duration_minutes,
           cast(l_quantity as decimal(8,2)) as actual_distance_miles,
           case when pickup_ts is not null then cast(l_partkey % 13 as int) end as wait_time_minutes,
           cast(total_fare * 0.30 as decimal(10,2)) as base_fare,
           cast(total_fare * 0.40 as decimal(10,2)) as distance_fare,
           cast(total_fare * 0.20 as decimal(10,2)) as time_fare, surge_multiplier,
           cast(cast(total_fare * 0.90 as decimal(10,2)) * (surge_multiplier - 1) as decimal(10,2)) as surge_fare,
           tolls as tolls_fare, tips as tips_amount, discount as discount_amount, total_fare,
           cast(total_fare * 0.80 as decimal(10,2)) as driver_earnings,
           cast(total_fare - cast(total_fare * 0.80 as decimal(10,2)) as decimal(10,2)) as company_commission,
           case when l_returnflag = 'A' and l_discount > 0
                then cast(3 + cast(l_discount as decimal(3,2)) * 20 as decimal(3,2)) end as rider_rating_given,
           case when l_returnflag = 'A' and l_tax > 0
                then cast(3 + cast(l_tax as decimal(3,2)) * 20 as decimal(3,2)) end as driver_rating_given
    from {ride_lines}""",
    "fact_driver_daily": """
    select driver_sk, cast(pickup_timestamp as date) as activity_date,
           sum(total_fare) as gross_earnings, count(*) as total_trips,
           count(case when trip_status_sk = 1 then 1 end) as completed_trips,
           count(case when trip_status_sk = 2 then 1 end) as cancelled_trips,
           cast(sum(rider_rating_given) as double) / nullif(count(rider_rating_given), 0) as average_rating,
           cast(count(case when trip_status_sk <> 2 then 1 end) as double) * 100 / count(*) as acceptance_rate
    from {fact_trips} where pickup_timestamp is not null
    group by driver_sk, cast(pickup_timestamp as date)""",
    # Driver feed the trips do not hold: hours online and offers, per driver and day.
    "driver_feed": """
    select driver_sk, activity_date, cast(total_trips * 1.50 as decimal(5,2)) as hours_online,
           total_trips + driver_sk % 3 as offered_trips
    from {fact_driver_daily}""",
    "staging_raw_trips": f"""
    select trip_id, cast(l_suppkey as int) as driver_id, cast(o_custkey as int) as rider_id,
           {_latitude('40', 'o_custkey')} as pickup_lat, {_longitude('-73', 'o_custkey')} as pickup_lng,
           case when l_returnflag <> 'R' then {_latitude('41', 'l_suppkey')} end as dropoff_lat,
           case when l_returnflag <> 'R' then {_longitude('-74', 'l_suppkey')} end as dropoff_lng,
           requested_ts as requested_at, pickup_ts as pickup_at, dropoff_ts as dropoff_at,
           case l_returnflag when 'A' then 'completed ' when 'R' then 'CANCELLED' else 'In_Progress' end as status,
           case when l_partkey % 97 = 0 then chr(123) || '"base":'
                when l_partkey % 89 = 0 then null
                when l_partkey % 83 = 0 then '[1, 2]'
                when l_partkey % 79 = 0 then '17'
                else chr(123) || '"base":' ||
                     case when l_partkey % 73 = 0 then '99999999999.00'
                          else cast(cast(l_partkey % 9 + 3 as decimal(10,2)) as varchar(20)) end ||
                     ',"distance":' || cast(cast(l_quantity as decimal(10,2)) as varchar(20)) ||
                     ',"time":' || cast(cast(l_partkey % 56 as int) * 0.25 as varchar(20)) ||
                     ',"surge":' || cast(surge_multiplier as varchar(20)) ||
                     ',"tolls":' || cast(tolls as varchar(20)) || ',"tips":' || cast(tips as varchar(20)) ||
                     ',"discount":' || cast(discount as varchar(20)) || chr(125) end as fare_breakdown,
           chr(123) || '"part":' || cast(l_partkey as varchar(20)) ||
               ',"price":' || cast(total_fare as varchar(20)) ||
               ',"supp":' || cast(l_suppkey as varchar(20)) ||
               ',"qty":' || cast(cast(l_quantity as decimal(10,2)) as varchar(20)) ||
               ',"ship":"' || cast(cast(l_shipdate as date) as varchar(20)) || '"' ||
               case when l_partkey % 61 = 0 then '' else chr(125) end as raw_data,
           requested_ts + (l_partkey % 7 + case when l_partkey % 11 = 0 then 720 else 0 end) * interval '1' hour
               as ingestion_timestamp,
           l_orderkey % 10 = 0 as processed, cast(requested_ts as date) as ingestion_date
    from {{ride_lines}}""",
    "rider_changes": """
    select cast(o_custkey as int) as rider_id, o_orderdate as changed_at, o_orderkey as change_seq,
           case when o_totalprice < 100000 then 'bronze' when o_totalprice < 250000 then 'silver'
                else 'gold' end as loyalty_tier,
           o_orderpriority = '5-LOW' as arrives_late
    from {orders}""",
    "driver_changes": """
    select cast(l_suppkey as int) as driver_id, l_shipdate as changed_at,
           l_orderkey * 10 + l_linenumber as change_seq, l_partkey * 1000 + cast(l_quantity as int) as change_sub,
           case l_returnflag when 'A' then 'active' when 'N' then 'inactive' else 'suspended' end as driver_status,
           case when l_linestatus = 'F' then 'economy' else null end as vehicle_type
    from {lineitem}""",
    "raw_payments": """
    select 'P' || cast(o_orderkey as varchar(20)) as payment_id,
           cast(o_orderkey as varchar(20)) || '-' || cast(coalesce(first_line, 0) as varchar(9)) as trip_id,
           cast(substr(o_orderpriority, 1, 1) as int) as payment_method_id,
           cast(o_totalprice as decimal(10,2)) as payment_amount,
           cast(cast(o_totalprice as decimal(10,2)) * 0.03 as decimal(10,2)) as processing_fee,
           case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'failed' end as payment_status,
           o_orderdate + (o_orderkey % 1440) * interval '1' minute as payment_timestamp
    from {orders}
    left join (select l_orderkey, min(l_linenumber) as first_line from {lineitem} group by l_orderkey) as lines
      on o_orderkey = l_orderkey""",
    # Trips and payments with keys of their own and minute keys, for the constraint check.
    "keyed_trips": f"""
    select cast(split_part(trip_id, '-', 1) as bigint) * 10 + cast(split_part(trip_id, '-', 2) as bigint) as trip_sk, trip_id,
           driver_sk, rider_sk, pickup_location_sk, dropoff_location_sk, trip_status_sk,
           {_minute('pickup_timestamp')} as pickup_time_sk, {_minute('dropoff_timestamp')} as dropoff_time_sk
    from {{fact_trips}}""",
    "keyed_payments": f"""
    select cast(substr(payment_id, 2) as bigint) as payment_sk, payment_id,
           cast(split_part(trip_id, '-', 1) as bigint) * 10 + cast(split_part(trip_id, '-', 2) as bigint) as trip_sk,
           cast(payment_method_id as bigint) as payment_method_sk,
           {_minute('payment_timestamp')} + case when payment_amount < 2000 then 60 else 0 end as payment_time_sk, payment_status
    from {{raw_payments}}""",
    "method_updates": """
    select cast(substr(o_orderpriority, 1, 1) as int) as payment_method_id, o_orderkey as update_seq,
           case when o_totalprice < 200000 then 'credit_card' else 'cash' end as payment_type,
           case o_orderstatus when 'F' then 'visa' when 'O' then 'mastercard' else 'paypal' end as provider
    from {orders}""",
    "holidays": """
    select cast(d as date) as holiday_date, n as holiday_name
    from (values ('2001-01-01', 'New Year'), ('2001-12-25', 'Christmas Day'), ('2024-01-01', 'New Year'),
                 ('2024-12-25', 'Christmas Day')) as t(d, n)""",
    "data_classification": """
    select t as table_name, c as column_name, l as classification_level, r as masking_rule,
           cast(p as int) as retention_period_days
    from (values ('security_users', 'email', 'CONFIDENTIAL', 'hash', 900),
                 ('security_users', 'last_name', 'RESTRICTED', 'full', 900),
                 ('security_users', 'user_id', 'INTERNAL', 'last4', 900),
                 ('security_users', 'last_login_at', 'INTERNAL', 'year', 900),
                 ('security_audit_log', 'ip_address', 'CONFIDENTIAL', 'hash', 20),
                 ('security_audit_log', 'event_type', 'PUBLIC', null, 90)) as v(t, c, l, r, p)""",
    "access_policies": """
    select n_nationkey + 1 as policy_sk, 'dim_locations' as resource_pattern,
           'city = ' || chr(39) || n_name || chr(39) as policy_condition, 'READ' as action_type,
           n_nationkey % 6 <> 0 as is_active, 100 - n_nationkey as priority_order
    from {nation}
    union all
    select 1000 + n_nationkey, 'dim_locations', 'zone_id=Z' || cast(n_nationkey % 7 as varchar(9)), 'READ', true,
           80 + n_nationkey
    from {nation}
    union all
    select 2000 + n_nationkey, 'dim_locations', 'city = x or 1 = 1', 'READ', true, 1
    from {nation}
    union all
    select 3000 + n_nationkey, 'dim_locations', 'city = ' || n_name, 'WRITE', n_nationkey % 2 = 0, 70 + n_nationkey
    from {nation}""",
    "row_requests": """
    select event_id as request_id, user_id as user_sk, 10000000 + event_id % 10 as location_sk
    from {events}""",
    "security_users": """
    select c_custkey as user_sk, c_name as user_id, lower(c_name) || '@x.io' as email, c_mktsegment as first_name,
           case when c_custkey % 50 = 7 then null else c_name end as last_name,
           case when c_custkey % 5 = 4 then 'SUSPENDED' else 'ACTIVE' end as user_status,
           case c_custkey % 3 when 0 then 'DRIVER' when 1 then 'RIDER' else 'STAFF' end as account_type,
           timestamp '2024-01-01 00:00:00' + (c_custkey % 1000) * interval '1' minute as last_login_at,
           c_custkey % 2 = 0 as email_verified, c_custkey % 6 = 0 as mfa_enabled
    from {customer}""",
    "user_roles": """
    select c_custkey as user_sk, c_custkey % 8 + 1 as role_sk, c_custkey % 7 <> 0 as is_active,
           case when c_custkey % 3 = 1 then timestamp '2024-01-01 00:00:00' + (c_custkey % 60) * interval '1' day
                end as expires_at
    from {customer}
    union all
    select c_custkey, cast(3 as bigint), true, timestamp '2024-03-01 00:00:00'
    from {customer} where c_custkey % 3 = 0""",
    "security_roles": _values(
        [(n, *role, True, True) for n, role in enumerate(ROLES, 1)],
        "role_sk, role_code, role_name, role_description, is_system_role, is_active"),
    "security_permissions": _values(
        [(n, *permission, True) for n, permission in enumerate(PERMISSIONS, 1)],
        "permission_sk, permission_code, permission_name, resource_type, resource_name, action_type, is_active"),
    "role_permissions": """
    select r.role_sk, g.permission_sk, true as is_active
    from (select permission_sk, 'SUPER_ADMIN' as role_code from {security_permissions}
          union all
          select permission_sk, 'DATA_ANALYST' from {security_permissions}
          where action_type = 'READ' and resource_type in ('TABLE', 'VIEW')) as g
    join {security_roles} r on r.role_code = g.role_code""",
    # A permission catalogue that grows with the data: the seeds and four actions' worth of parts.
    "permission_catalogue": """
    select permission_sk, permission_code, resource_type, action_type from {security_permissions}
    union all
    select 1000 + p_partkey, 'part.' || cast(p_partkey as varchar(20)),
           case p_size % 4 when 0 then 'TABLE' when 1 then 'VIEW' when 2 then 'FUNCTION' else 'API_ENDPOINT' end,
           case p_partkey % 4 when 0 then 'READ' when 1 then 'WRITE' when 2 then 'DELETE' else 'EXECUTE' end
    from {part}""",
    "existing_grants": """
    select cast(1 as bigint) as role_sk, 1000 + p_partkey as permission_sk from {part} where p_partkey % 3 = 0""",
    "security_audit_log": """
    select event_id as audit_sk, case when event_id % 20 = 0 then null else user_id end as user_sk, event_type,
           case when event_type = 'error' then false when event_id % 11 = 0 then null else true end as success,
           '10.0.0.' || cast(user_id % 50 as varchar(9)) as ip_address, ts as event_timestamp,
           cast(event_id * 13 % 101 as int) as risk_score
    from {events}""",
    "access_requests": """
    select event_id as request_id, c_name as user_id,
           case event_id % 4 when 0 then 'fact_trips.read' when 1 then 'fact_trips.write'
                when 2 then 'audit.read' else 'no.such' end as permission_code
    from {events} join {customer} on user_id = c_custkey""",
    "login_attempts": """
    select event_id as attempt_id, user_id as user_sk, ts as attempt_ts,
           event_type in ('purchase', 'signup') as password_ok,
           '10.0.0.' || cast(user_id % 50 as varchar(9)) as ip_address, 'agent' as user_agent
    from {events}""",
    "named_attempts": """
    select event_id as attempt_id,
           case when event_id % 25 = 0 then 'ghost' || cast(event_id % 7 as varchar(9))
                when event_id % 2 = 0 then c_name else lower(c_name) || '@x.io' end as username,
           ts as attempt_ts, '10.0.0.' || cast(user_id % 50 as varchar(9)) as ip_address, 'agent' as user_agent
    from {events} join {customer} on user_id = c_custkey""",
    "failed_login_attempts": """
    select event_id as attempt_sk, 'user' || cast(user_id as varchar(20)) as username_attempted,
           '10.0.0.' || cast(user_id % 50 as varchar(9)) as ip_address,
           case when event_id % 3 = 0 then 'USER_NOT_FOUND' else 'INVALID_PASSWORD' end as failure_reason,
           ts as attempt_timestamp
    from {events} where event_type not in ('purchase', 'signup')""",
    "user_sessions": """
    select event_id as session_sk, 'S' || cast(event_id as varchar(20)) as session_id, user_id as user_sk,
           ts as login_timestamp, ts + (event_id % 30) * interval '1' minute as last_activity,
           case when event_id % 17 = 0 then null else ts + (event_id % 240) * interval '1' hour end as expires_at,
           event_id % 9 <> 0 as is_active,
           case event_id % 3 when 0 then 'WEB' when 1 then 'MOBILE' else 'API' end as session_type
    from {events}""",
    # The record of a freshness report run after each month: a table's rows so far, those without a time from the first run on.
    "report_runs": f"""
    select table_name, month + interval '1' month as run_at, row_count
    from (select table_name, month, cast(sum(row_count) over (partition by table_name order by month nulls first) as bigint) as row_count
          from ({_monthly('fact_trips', 'pickup_timestamp')}
                union all
                {_monthly('staging_raw_trips', 'ingestion_timestamp')}
                union all
                {_monthly('security_audit_log', 'event_timestamp')}) as months) as sums
    where month is not null""",
    "user_attributes": """
    select c_custkey as user_sk, 'city' as attribute_name, n_name as attribute_value, c_custkey % 13 <> 0 as is_active
    from {customer} join {nation} on c_nationkey = n_nationkey""",
}

_REFERENCE = re.compile(r"\{(\w+)\}")


def depends_on(name: str) -> list[str]:
    """Tables a mapping names directly."""
    return sorted(set(_REFERENCE.findall(MAPPINGS[name])))


# Every trip table is a projection of lines joined with their orders. That join is written once per session and folder,
# with the source columns alone; the trip tables are read through it, so a query computes the columns it
# uses and no wide copy of the input is shuffled or written.
_RIDE_JOIN = "from {lineitem} join {orders} on l_orderkey = o_orderkey"
# The pickup time is stored as a column, so that a filter on it is pushed down to the files.
_PICKUP = """case when l_returnflag = 'R' and l_linestatus = 'O' then null
                else l_shipdate + (l_partkey * 37 % 1440) * interval '1' minute end"""
JOINED_LINES = f"""
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
           l_returnflag, l_shipdate, o_custkey, {_PICKUP} as pickup_timestamp
    {_RIDE_JOIN}"""
# What Spark reads in place of a mapping's own text, which stays the one that DuckDB runs.
READ_AS = {"joined_lines": JOINED_LINES,
           "ride_lines": MAPPINGS["ride_lines"].replace(_RIDE_JOIN, "from {joined_lines}").replace(_PICKUP, "pickup_timestamp")}

# Tables that hold a join or many scans and are written on first use, with the test tables that are dealt out by key before
# it: a test table may be one row group, which one task reads. A join that shuffles finds its rows dealt out so already.
STORED = {"joined_lines": {"lineitem": "l_orderkey", "orders": "o_orderkey"}, "raw_payments": {"orders": "o_orderkey"},
          "driver_attributes": {}, "rider_attributes": {}}
_stored_paths: dict[tuple[str, str, str], str] = {}


class SampleWarehouse(dict):
    """Warehouse tables by name, built lazily over one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark = configure(spark)
        self.sf_dir = sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name in TEST_TABLES:
            frame = self.spark.read.schema(TEST_TABLES[name]).parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in STORED:
            frame = self._stored(name)
        else:
            frame = self._mapped(name)
        self[name] = frame
        return frame

    def _mapped(self, name: str) -> DataFrame:
        text = READ_AS.get(name) or MAPPINGS[name]
        return self.spark.sql(text, **{d: self[d] for d in sorted(set(_REFERENCE.findall(text)))})

    def _stored(self, name: str) -> DataFrame:
        """The mapped table, written on first use and read from disk."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _stored_paths:
            source = SampleWarehouse(self.spark, self.sf_dir)
            for table, column in STORED[name].items():
                source[table] = self[table].repartition(column)
            path = scratch_dir(self.spark, f"sample-{name}")
            with freed_shuffles(self.spark):
                source._mapped(name).write.option("compression", CODEC).parquet(path)
            _stored_paths[key] = path
        return self.spark.read.parquet(_stored_paths[key])

    def load(self) -> None:
        """Write all stored tables now."""
        for name in STORED:
            self[name]


def cte_chain(*names: str) -> str:
    """``WITH`` clause that defines the named mappings over the test tables."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in TEST_TABLES or name in ordered:
            return
        for needed in depends_on(name):
            visit(needed)
        ordered.append(name)

    for name in names:
        visit(name)
    return "with " + ",\n".join(f"{n} as ({_REFERENCE.sub(r'\1', MAPPINGS[n])})" for n in ordered)
