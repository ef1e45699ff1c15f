"""Streams over several micro-batches equal the batch jobs."""

import datetime as dt

from pyspark.sql import Window, functions as F

from farelake.operators import logins
from farelake.plans import views
from farelake.sources.samples import SampleWarehouse
from farelake.streaming import jobs

SF = "/root/testdata/sf0.001"


def write_in_order(df, path, order, parts):
    """One file per time range, oldest file first."""
    rows = df.withColumn("_part", F.ntile(parts).over(Window.orderBy(order)))
    for i in range(1, parts + 1):
        rows.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(path)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_logins_over_many_batches(spark, tmp_path):
    wh = SampleWarehouse(spark, SF)
    attempts = wh["login_attempts"]
    source = str(tmp_path / "in")
    write_in_order(attempts, source, "attempt_ts", 4)
    stream = jobs.file_stream(spark, source, attempts.schema, max_files=1)
    got = jobs.run_available(jobs.stream_login_outcomes(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert as_set(got) == as_set(logins.login_outcomes(attempts))


def test_stopped_stream_goes_on(spark, tmp_path):
    wh = SampleWarehouse(spark, SF)
    attempts = wh["login_attempts"]
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "cp"))
    middle = dt.datetime(2024, 1, 15)
    attempts.where(F.col("attempt_ts") < middle).coalesce(1).write.parquet(source)
    run = lambda: jobs.run_available(
        jobs.stream_login_outcomes(jobs.file_stream(spark, source, attempts.schema)), out, progress)
    run()
    attempts.where(F.col("attempt_ts") >= middle).coalesce(1).write.mode("append").parquet(source)
    assert as_set(run()) == as_set(logins.login_outcomes(attempts))


def test_daily_revenue_over_many_batches(spark, tmp_path):
    wh = SampleWarehouse(spark, SF)
    trips = wh["fact_trips"].where("pickup_timestamp is not null")
    source = str(tmp_path / "in")
    write_in_order(trips, source, "pickup_timestamp", 3)
    stream = jobs.file_stream(spark, source, trips.schema, max_files=1)
    got = jobs.run_available(jobs.stream_daily_revenue(stream, wh), str(tmp_path / "out"), str(tmp_path / "cp"))
    last = trips.agg(F.max("pickup_timestamp").alias("x")).first().x - dt.timedelta(days=3)
    want = views.v_daily_revenue(wh).where(F.date_add("trip_date", 1) <= F.lit(last.date()))
    assert as_set(got) == as_set(want)
    assert got.count() > 1000


def test_redelivered_rows_are_dropped_and_updates_kept(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 10)
    cols = "trip_id string, fare_breakdown string, raw_data string, ingestion_timestamp timestamp_ntz"
    batches = [[("t", None, '{"s":1}', at), ("t", None, '{"s":1}', at), ("u", "{", '{"s":1}', at)],
               [("t", None, '{"s":1}', at + dt.timedelta(hours=1)), ("t", None, '{"s":2}', at + dt.timedelta(hours=2))]]
    source = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(source)
    stream = jobs.file_stream(spark, source, spark.createDataFrame([], cols).schema, max_files=1)
    got = jobs.run_available(jobs.stream_staging(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted((r.trip_id, r.raw_data) for r in got.collect()) == [("t", '{"s":1}'), ("t", '{"s":2}')]


def test_updates_without_a_raw_record_are_kept(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 10)
    cols = "trip_id string, status string, fare_breakdown string, raw_data string, ingestion_timestamp timestamp_ntz"
    rows = [("t", "REQUESTED", None, None, at), ("t", "COMPLETED", None, None, at + dt.timedelta(hours=1)),
            ("t", "COMPLETED", None, None, at + dt.timedelta(hours=2)), ("t", None, None, None, at)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, cols).write.parquet(source)
    stream = jobs.file_stream(spark, source, spark.createDataFrame([], cols).schema)
    got = jobs.run_available(jobs.stream_staging(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(str(r.status) for r in got.collect()) == ["COMPLETED", "None", "REQUESTED"]


def test_staging_state_is_a_digest_a_delivery(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 10)
    cols = "trip_id string, status string, fare_breakdown string, raw_data string, ingestion_timestamp timestamp_ntz"
    rows = [("t", "A", None, None, at), ("u", "A", None, None, at), ("u", "A", None, None, at + dt.timedelta(hours=1)), (None, "A", None, None, at)]
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "cp"))
    spark.createDataFrame(rows, cols).write.parquet(source)
    got = jobs.run_available(jobs.stream_staging(jobs.file_stream(spark, source, spark.createDataFrame([], cols).schema)), out, progress)
    assert sorted(r.trip_id for r in got.collect()) == ["t", "u"]
    state = spark.read.format("statestore").option("batchId", 0).load(progress)
    assert {len(r.d) for r in state.select(F.col("key._delivery").alias("d")).collect()} == {32} and state.count() == 2
    assert state.schema["key"].dataType.names == ["_delivery"]
    assert all(".zstd." in f for f in got.inputFiles())
