"""Loads work wide expressions and tables out no more often than they must."""

import datetime as dt

from pyspark.sql import functions as F

from farelake.plans import dimensions, facts
from farelake.plans.increment import IncrementalLoad
from tests.test_histories import T0, plan


def test_json_checks_work_each_text_out_once(spark):
    df = spark.range(6).selectExpr(
        "nullif(concat('t', id), 't5') as trip_id", "if(id = 1, null, concat('{\"fare\":', id, if(id = 2, '', '}'))) as fare_breakdown",
        "concat('{\"raw\":', id, if(id = 3, '', '}')) as raw_data")
    checked = {r.trip_id: (r.fare_ok, r.raw_ok, r.is_valid) for r in facts.with_json_check(df).collect()}
    assert checked == {"t0": (True, True, True), "t1": (True, True, True), "t2": (False, True, False), "t3": (True, False, False),
                       "t4": (True, True, True), None: (True, True, False)}
    assert facts.valid_rows(df).columns == df.columns
    assert facts.quarantined_rows(df).columns == [*df.columns, "fare_ok", "raw_ok", "is_valid"]
    assert {r.trip_id for r in facts.valid_rows(df).collect()} == {"t0", "t1", "t4"}
    assert {r.trip_id for r in facts.quarantined_rows(df).collect()} == {"t2", "t3", None}
    for rows in (facts.valid_rows(df), facts.quarantined_rows(df)):
        text = plan(rows)
        assert text.count('{"fare":') == text.count('{"raw":') == 1


def test_minutes_are_made_by_several_tasks(spark):
    days = spark.createDataFrame([(T0 + dt.timedelta(days=d),) for d in range(40)], "at timestamp_ntz")
    made = dimensions.minutes_of(days.unionByName(days), "at").withColumn("task", F.spark_partition_id())
    assert made.count() == 40 * 1440 and made.select("task").distinct().count() > 1


def test_increment_makes_minutes_of_days_that_are_new_or_have_other_holidays(spark, tmp_path):
    job = IncrementalLoad(spark, str(tmp_path), T0, grain="month")
    day = lambda n: T0 + dt.timedelta(days=n)
    calendar = lambda *named: spark.createDataFrame([(day(n).date(), name) for n, name in named], "holiday_date date, holiday_name string")
    states = lambda *at: spark.createDataFrame([(day(n), None, None) for n in at], "requested_at timestamp_ntz, pickup_at timestamp_ntz, dropoff_at timestamp_ntz")
    paid = lambda *at: spark.createDataFrame([(day(n),) for n in at], "payment_timestamp timestamp_ntz")
    whole = lambda last, holidays: dimensions.dim_time(dimensions.minutes_of(
        spark.createDataFrame([(day(n),) for n in range(last + 1)], "at timestamp_ntz"), "at"), holidays)
    job._store(whole(4, calendar((1, "one"), (2, "two"))), "dim_time")
    cases = [(calendar((1, "one"), (2, "two"), (90, "far")), [0, 4], [3], []), (calendar((1, "one"), (2, "other"), (3, "three")), [2], [], [2, 3]),
             (calendar((2, "two")), [], [6], [1, 5, 6]), (calendar((1, "one"), (1, "again"), (2, "two")), [1], [1], [1])]
    for holidays, at, payments, want in cases:
        new = {"holidays": holidays, "raw_payments": paid(*payments)}
        days = job._new_days(new, states(*at))
        assert {r.full_date for r in days.collect()} == {day(n).date() for n in want}
        got = job._times(new, days)
        assert sorted(map(str, got.collect())) == sorted(map(str, job.table("dim_time").limit(0).unionByName(
            whole(max([4, *payments]), holidays)).collect()))
