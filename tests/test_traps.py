"""Hand-written rows for the places where a plausible reading gives a wrong result."""

import datetime as dt
import hashlib
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from farelake.functions import aggregates as A, scalars as S
from farelake.plans import access, facts, views
from farelake.sources.seeds import seed_permissions, seed_roles
from farelake.sources.tables import conform

TS = dt.datetime


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(
        f"{k} {'timestamp_ntz' if isinstance(v, TS) else 'int' if isinstance(v, int) else 'string'}"
        for k, v in values.items()))


@pytest.fixture(scope="module")
def wh(spark):
    """Two drivers (one with an old version), two riders, two places, five trips."""
    trip = ("trip_id string, driver_sk bigint, rider_sk bigint, pickup_location_sk bigint, dropoff_location_sk bigint, "
            "trip_status_sk bigint, pickup_timestamp timestamp_ntz, dropoff_timestamp timestamp_ntz, "
            "actual_duration_minutes int, actual_distance_miles decimal(8,2), total_fare decimal(10,2), "
            "driver_earnings decimal(10,2), company_commission decimal(10,2), rider_rating_given decimal(3,2), "
            "driver_rating_given decimal(3,2)")
    t = TS(2024, 3, 31, 12, 0)

    def row(i, driver, status, at, minutes, fare, rating, drop=2):
        return (i, driver, 1, 1, drop, status, at, at, minutes, D("1.00"), D(fare), D("1.00"), D("0.50"),
                None if rating is None else D(rating), None)

    return {
        "fact_trips": spark.createDataFrame([
            row("a", 1, 1, t, 10, "10.00", "4.00"), row("b", 2, 1, t, 5, "10.01", None),
            row("b", 2, 1, t, 6, "10.01", "3.90"), row("c", 3, 2, t, None, "7.00", None, drop=None),
            row("d", 3, 1, None, 8, "3.00", None)], trip),
        "dim_drivers": spark.createDataFrame(
            [(1, 7, "A", "B", False, D("4.50"), 10, "X"), (2, 7, "A", "C", True, D("4.50"), 10, "X"),
             (3, 8, "A", None, True, D("4.50"), 10, "X")],
            "driver_sk bigint, driver_id int, first_name string, last_name string, is_current boolean, "
            "driver_rating decimal(3,2), total_trips int, city_code string"),
        "dim_riders": spark.createDataFrame([(1, 1, "R", "S", True)],
                                            "rider_sk bigint, rider_id int, first_name string, last_name string, "
                                            "is_current boolean"),
        "dim_locations": spark.createDataFrame([(1, "p", "X"), (2, "q", "Y")],
                                               "location_sk bigint, address string, city string"),
        "dim_trip_status": spark.createDataFrame([(1, "COMPLETED"), (2, "CANCELLED")],
                                                 "trip_status_sk bigint, status_code string"),
    }


def test_trips_of_an_old_driver_version_are_dropped(wh):
    assert {r.trip_id for r in views.v_trip_summary(wh).collect()} == {"b", "d"}
    assert {r.trip_id for r in views.trip_summary_all_versions(wh).collect()} == {"a", "b", "d"}


def test_null_name_part_gives_null_name(wh):
    names = {r.trip_id: r.driver_name for r in views.v_trip_summary(wh).collect()}
    assert names == {"b": "A C", "d": None}


def test_null_pickup_has_its_own_date_group(wh):
    rows = {r.trip_date: r for r in views.v_daily_revenue(wh).collect()}
    assert set(rows) == {None, dt.date(2024, 3, 31)}
    assert rows[None].total_trips == 1
    assert rows[dt.date(2024, 3, 31)].total_revenue == D("30.02")


def test_two_completed_statuses_are_an_error_and_none_selects_nothing(spark, wh):
    two = {**wh, "dim_trip_status": wh["dim_trip_status"].union(wh["dim_trip_status"])}
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        views.v_daily_revenue(two).collect()
    none = {**wh, "dim_trip_status": wh["dim_trip_status"].where("trip_status_sk = 2")}
    assert views.v_daily_revenue(none).collect() == []


def test_city_performance(wh):
    r = views.v_city_performance(wh, "2024-04-30 12:00:00").first()
    assert (r.total_trips, r.active_drivers, r.active_riders) == (3, 3, 1)   # trip b twice, cancelled c counted
    assert r.avg_trip_duration == 7                                           # 21 over 3, c has none
    assert r.rider_satisfaction_rate == 25.0                                  # 1 of 4 rows, unrated ones included


def test_whole_mean_is_cut(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "n int")
    assert df.agg(A.whole_mean("n").alias("x")).first().x == 1
    assert df.where("n is null").agg(A.whole_mean("n").alias("x")).first().x is None


def test_month_cutoff_clamps_and_keeps_time(spark):
    r = spark.range(1).select(S.months_before("2024-03-31 12:30:00", 1).alias("x")).first()
    assert r.x == TS(2024, 2, 29, 12, 30)


def test_date_equal_to_cutoff_date_fails_after_midnight(spark, wh):
    days = spark.createDataFrame([(2, dt.date(2024, 2, 29), D("1.0"), 4.0, 90.0), (2, dt.date(2024, 3, 1), D("2.0"), 4.0, 90.0)],
                                 "driver_sk bigint, activity_date date, gross_earnings decimal(10,2), "
                                 "average_rating double, acceptance_rate double")
    rows = views.v_top_drivers({**wh, "fact_driver_daily": days}, "2024-03-31 12:00:00").collect()
    assert [r.monthly_earnings for r in rows] == [D("2.00")]
    rows = views.v_top_drivers({**wh, "fact_driver_daily": days}, "2024-03-29 00:00:00").collect()
    assert len(rows) == 2


def test_earnings_mark_applies_after_the_first_hundred(spark, wh):
    days = [(2, dt.date(2024, 1, 1) + dt.timedelta(days=i), D("10.0"), 4.0, 90.0) for i in range(100)]
    days.append((2, dt.date(2024, 6, 1), D("9000.0"), 5.0, 90.0))
    df = spark.createDataFrame(days, "driver_sk bigint, activity_date date, gross_earnings decimal(10,2), "
                                     "average_rating double, acceptance_rate double")
    tables = {**wh, "fact_driver_daily": df}
    assert views.v_top_drivers(tables, "2024-01-15 00:00:00").count() == 100
    assert views.high_earning_drivers(tables, "2024-01-15 00:00:00").collect() == []


def test_codes_ignore_case_and_trailing_blanks(spark):
    r = one(spark, c="Completed  ").select(S.code("c").alias("x")).first()
    assert r.x == "COMPLETED"


@pytest.mark.parametrize("text, valid", [
    ('{"a": 1}', True), ("  [1]", True), ('{"a":', False), ("17", False), ('"x"', False), ("", False), (None, None),
    ('{"a":1,"a":2}', True)])
def test_json_documents(spark, text, valid):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(S.is_json_document("t").alias("x")).first().x is valid


def test_null_json_passes_validation(spark):
    df = spark.createDataFrame([("t", None, '{"a":1}'), ("u", "17", None), (None, None, None)],
                               "trip_id string, fare_breakdown string, raw_data string")
    assert [r.trip_id for r in facts.valid_rows(df).collect()] == ["t"]
    assert facts.quarantined_rows(df).count() == 2


def test_bad_fare_part_is_null_and_spares_the_others(spark):
    df = spark.createDataFrame([('{"base": 99999999999, "tips": "x", "tolls": 1.005, "surge": 1.5}',)],
                               "fare_breakdown string")
    r = facts.parse_fare_breakdown(df).first()
    assert (r.base_fare, r.tips_amount, r.tolls_fare, r.surge_multiplier) == (None, None, D("1.01"), D("1.50"))


def test_measures_add_up(spark):
    cols = ("requested_timestamp timestamp_ntz, pickup_timestamp timestamp_ntz, dropoff_timestamp timestamp_ntz, "
            "base_fare decimal(10,2), distance_fare decimal(10,2), time_fare decimal(10,2), "
            "surge_multiplier decimal(4,2), tolls_fare decimal(10,2), tips_amount decimal(10,2), "
            "discount_amount decimal(10,2)")
    df = spark.createDataFrame([
        (TS(2024, 1, 1, 9, 0, 30), TS(2024, 1, 1, 9, 5, 29), TS(2024, 1, 1, 10, 5, 29), D(5), D(10), D(5), D("1.50"),
         D(2), D(3), D(1)),
        (TS(2024, 1, 1), None, None, D(5), None, None, None, None, None, None)], cols)
    a, b = facts.trip_measures(df).collect()
    assert (a.wait_time_minutes, a.actual_duration_minutes) == (4, 60)
    assert (a.surge_fare, a.total_fare) == (D("10.00"), D("34.00"))
    assert (a.driver_earnings, a.company_commission) == (D("27.80"), D("6.20"))
    assert (b.total_fare, b.driver_earnings, b.company_commission, b.wait_time_minutes) == (D(5), D(4), D(1), None)


def test_seed_grants(spark):
    grants = access.expand_role_grants(seed_roles(spark), seed_permissions(spark))
    rows = {(r.role_sk, r.permission_sk) for r in grants.collect()}
    assert len(rows) == 17 and grants.count() == 17
    assert (3, 10) in rows                       # the audit log is a readable table
    again = access.expand_role_grants(seed_roles(spark), seed_permissions(spark), grants)
    assert again.count() == 0


def test_expired_role_counts_in_the_view_only(spark):
    tables = {
        "security_users": spark.createDataFrame([(1, "u", "e", "ACTIVE"), (2, "v", "f", "SUSPENDED")],
                                                "user_sk bigint, user_id string, email string, user_status string"),
        "user_roles": spark.createDataFrame([(1, 3, True, TS(2024, 1, 1)), (2, 1, True, None)],
                                            "user_sk bigint, role_sk bigint, is_active boolean, expires_at timestamp_ntz"),
        "security_roles": seed_roles(spark), "security_permissions": seed_permissions(spark),
        "role_permissions": access.expand_role_grants(seed_roles(spark), seed_permissions(spark))
        .withColumn("is_active", F.lit(True)),
    }
    seen = access.v_user_permissions(tables)
    assert seen.count() == 6 and {r.user_id for r in seen.collect()} == {"u"}
    assert access.effective_permissions_asof(tables, "2024-01-01 00:00:00").count() == 0
    assert access.effective_permissions_asof(tables, "2023-12-31 23:59:59").count() == 6
    asks = spark.createDataFrame([(1, "u", "audit.read"), (2, "u", "fact_trips.write"), (3, None, "audit.read")],
                                 "request_id int, user_id string, permission_code string")
    got = {r.request_id: r.has_permission for r in access.check_permissions(asks, seen).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def test_audit_rows_without_user_vanish_and_null_is_no_failure(spark):
    log = spark.createDataFrame([(None, "X", False, TS(2024, 1, 2)), (1, "X", None, TS(2024, 1, 2)),
                                 (1, "X", False, TS(2024, 1, 1)), (1, "X", False, TS(2023, 12, 1))],
                                "user_sk bigint, event_type string, success boolean, event_timestamp timestamp_ntz")
    users = spark.createDataFrame([(1, "u", "e")], "user_sk bigint, user_id string, email string")
    r, = access.v_security_audit_summary({"security_audit_log": log, "security_users": users}, "2024-01-31").collect()
    assert (r.event_count, r.failed_attempts, r.last_event) == (2, 1, TS(2024, 1, 2))


def test_null_and_unknown_names_are_not_found(spark):
    tries = spark.createDataFrame([(1, "u"), (2, "e@x"), (3, None), (4, "ghost")], "attempt_id int, username string") \
        .withColumns({"ip_address": F.lit("i"), "user_agent": F.lit("a"), "attempt_ts": S.clock("2024-01-01")})
    users = spark.createDataFrame([(1, "u", "e@x"), (2, "w", "u")], "user_sk bigint, user_id string, email string")
    assert {r.attempt_id for r in access.unknown_login_attempts(tries, users).collect()} == {3, 4}
    assert {(r.attempt_id, r.user_sk) for r in access.resolve_attempts(tries, users).collect()} == {(1, 1), (2, 1)}


def test_digest_is_hex(spark):
    r = one(spark, p="secret", s="salt").select(S.password_digest("p", "s").alias("x")).first()
    assert r.x == hashlib.sha256(b"secretsalt").hexdigest()


def test_default_fills_a_missing_column_only(spark):
    df = spark.createDataFrame([(1, None)], "location_sk bigint, is_airport boolean")
    r = conform(df, "dim_locations", "2024-01-01 00:00:00").first()
    assert r.is_downtown is True and r.is_airport is None and r.created_at == TS(2024, 1, 1)
    assert r.city is None
