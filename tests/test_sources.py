"""The test tables as warehouse tables: what is written and read for a query, and how streams are delivered."""

import datetime as dt
import glob

from pyspark.sql import functions as F

from farelake.catalog import streams
from farelake.operators.latest import latest_per_key
from farelake.sources import samples
from farelake.sources.samples import TEST_TABLES, SampleWarehouse

DAY = dt.datetime(1998, 5, 1)


def folder(spark, path):
    """Two orders with three lines, and a line without an order."""
    lines = [(k, 10 + k, 5, n, 2.0, 100.5, 0.05, 0.02, "A", "F", DAY) for k, n in ((1, 1), (1, 2), (2, 1), (9, 1))]
    orders = [(1, 7, "F", 300.0, DAY, "1-URGENT"), (2, 8, "O", 200.0, DAY, "5-LOW")]
    spark.createDataFrame(lines, TEST_TABLES["lineitem"]).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame(orders, TEST_TABLES["orders"]).write.parquet(f"{path}/orders.parquet")
    return str(path)


def test_trip_tables_are_read_through_the_stored_join_by_column(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(samples, "scratch_dir", lambda s, purpose: written.append(purpose) or str(tmp_path / purpose))
    wh = SampleWarehouse(spark, folder(spark, tmp_path / "in"))
    newest = wh["staging_raw_trips"].agg(F.max("ingestion_timestamp"))
    assert newest.first()[0] > DAY
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" in plan and "l_extendedprice" not in plan and "raw_data" not in plan
    assert {r[0]: r[1] for r in wh["fact_trips"].select("trip_id", "rider_sk").collect()} == {"1-1": 15, "1-2": 15, "2-1": 18}
    assert [r[0] for r in wh["driver_changes"].select("driver_id").distinct().collect()] == [5]
    assert written == ["sample-joined_lines"]


def test_latest_row_is_the_same_one_among_equals(spark):
    rows = [("a", 1, 5, "x"), ("a", 1, 7, None), ("a", 0, 9, "z"), ("b", None, 1, "x"), ("b", None, 2, "w")]
    for part in (rows, rows[::-1]):
        got = latest_per_key(spark.createDataFrame(part, "k string, at int, n int, s string").repartition(3), ["k"], ["at"])
        assert sorted(map(tuple, got.collect())) == [("a", 1, 7, None), ("b", None, 2, "w")]


class Tables(dict):
    spark = None


def test_a_delivery_of_trips_is_as_many_files_as_its_rows_fill(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "scratch_dir", lambda s, purpose: str(tmp_path / purpose))
    kinds = ("trip_id string, trip_status_sk bigint, pickup_location_sk bigint, pickup_timestamp timestamp_ntz, total_fare decimal(10,2), "
             "driver_earnings decimal(10,2), company_commission decimal(10,2)")
    when = [DAY - dt.timedelta(days=700 * (i % 3)) for i in range(60)]
    rows = spark.range(60, numPartitions=4).select("id")
    days = F.array(*[F.lit(w) for w in when])
    trips = rows.select(F.col("id").cast("string").alias("trip_id"), F.lit(1).cast("bigint").alias("trip_status_sk"),
                        F.lit(3).cast("bigint").alias("pickup_location_sk"), days[F.col("id").cast("int")].cast("timestamp_ntz").alias("pickup_timestamp"),
                        *[F.lit("2.00").cast("decimal(10,2)").alias(c) for c in ("total_fare", "driver_earnings", "company_commission")])
    wh = Tables(fact_trips=trips, dim_locations=spark.createDataFrame([(3, "Y")], "location_sk bigint, city string"),
                dim_trip_status=spark.createDataFrame([(1, "COMPLETED", True)], "trip_status_sk bigint, status_code string, is_completed boolean"))
    wh.spark = spark
    assert trips.schema.simpleString() == spark.createDataFrame([], kinds).schema.simpleString()
    got = {(r.trip_date, r.city): (r.total_trips, r.total_revenue) for r in streams.stream_daily_revenue(wh).collect()}
    assert got == {(w.date(), "Y"): (20, 40) for w in when}
    assert len(glob.glob(f"{tmp_path}/trip-source/*.parquet")) > 3
