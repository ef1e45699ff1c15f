"""Plans stay the ones a large cluster needs."""

import re

import pytest

import __spark_entry__ as entry
from farelake import registry
from farelake.plans import views
from farelake.sources import tables
from farelake.sources.samples import SampleWarehouse

SF = "/root/testdata/sf0.001"
PYTHON_ALLOWED = {"login_outcomes", "login_state", "login_audit_rows", "users_after_logins"}
RUNS_A_STREAM = {n for n in registry.QUERIES if n.startswith("stream_")}
RUNS_A_LOAD = {"two_step_load"}  # its result is a plain read of stored tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - RUNS_A_STREAM - RUNS_A_LOAD))
def test_no_pairwise_join_and_no_python(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON_ALLOWED:
        assert not re.search(r"Python|Pandas|Arrow", text)


def test_city_performance_reads_few_columns_and_pushes_the_cutoff(spark):
    wh = SampleWarehouse(spark, SF)
    text = plan(views.v_city_performance(wh, registry.TRIP_CLOCK))
    scan = next(line for line in text.splitlines() if "FileScan parquet" in line and "pickup_timestamp" in line)
    assert "GreaterThanOrEqual(pickup_timestamp" in scan
    assert "tips_amount" not in scan and "dropoff_timestamp" not in scan


def test_top_drivers_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan(entry.queries()["v_top_drivers"](spark, SF))


def test_stored_facts_skip_old_dates(spark, tmp_path):
    wh = SampleWarehouse(spark, SF)
    tables.write_table(tables.conform(wh["fact_trips"], "fact_trips", "2001-08-01"), str(tmp_path), "fact_trips",
                       grain="month")
    stored = tables.read_table(spark, str(tmp_path), "fact_trips", "month")
    assert stored.count() == 6000
    pruned = views.v_city_performance({**wh, "fact_trips": stored, "dim_locations": wh["dim_locations"]},
                                      registry.TRIP_CLOCK)
    text = plan(pruned)
    assert "pickup_month" in re.search(r"PartitionFilters: \[(.*?)\]", text.split("pickup_timestamp", 1)[1]).group(1)
    plain = views.v_city_performance(wh, registry.TRIP_CLOCK)
    assert sorted(map(tuple, pruned.collect())) == sorted(map(tuple, plain.collect()))


def test_overwrite_replaces_only_touched_dates(spark, tmp_path):
    wh = SampleWarehouse(spark, SF)
    trips = tables.conform(wh["fact_trips"], "fact_trips", "2001-08-01").where("pickup_timestamp >= '2001-02-20' and pickup_timestamp < '2001-03-10'")
    tables.write_table(trips, str(tmp_path), "fact_trips")
    before = tables.read_table(spark, str(tmp_path), "fact_trips").count()
    day = trips.where("pickup_timestamp >= '2001-03-01' and pickup_timestamp < '2001-03-02'").limit(1)
    in_day = trips.where("pickup_timestamp >= '2001-03-01' and pickup_timestamp < '2001-03-02'").count()
    rows = spark.createDataFrame(day.collect(), day.schema)
    tables.write_table(rows, str(tmp_path), "fact_trips")
    assert tables.read_table(spark, str(tmp_path), "fact_trips").count() == before - in_day + rows.count()


def test_sample_queries_run_as_sql(spark):
    wh = SampleWarehouse(spark, SF)
    for name in ("fact_trips", "dim_locations", "dim_drivers", "dim_riders", "dim_trip_status", "fact_driver_daily",
                 "security_users", "user_roles", "security_roles", "role_permissions", "security_permissions",
                 "security_audit_log"):
        wh[name]
    views.register_views(wh, registry.TRIP_CLOCK)
    cities = spark.sql("select * from v_city_performance order by total_trips desc").collect()
    assert len(cities) == 25 and cities[0].total_trips >= cities[-1].total_trips
    days = spark.sql("select trip_date, sum(total_revenue) as daily_revenue from v_daily_revenue "
                     "group by trip_date order by trip_date desc").collect()
    assert len(days) == 1371 and days[0].trip_date > days[1].trip_date
    rich = spark.sql("select * from v_top_drivers where monthly_earnings > 5000 order by recent_rating desc")
    assert rich.count() == 97
    assert spark.sql("select count(*) as n from v_user_permissions").first().n == 432
