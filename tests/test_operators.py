"""Operators on small and on skewed tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window, functions as F

from farelake.functions.calendar import calendar_columns
from farelake.operators import masking, policies, quality, retention
from farelake.operators.joins import join_spreading_nulls
from farelake.operators.keys import assign_surrogate_keys
from farelake.operators.latest import latest_per_key
from farelake.operators.neighbours import add_chunk, with_neighbour, with_neighbour_chunked
from farelake.operators.scd2 import build_versions, join_version, merge_versions, with_version_keys, unversioned_changes
from farelake.plans import dimensions, facts

TS = dt.datetime
OPEN = TS(9999, 12, 31)


def feed(spark, n=600, seed=1):
    """A change feed in which key 1 holds a third of all rows."""
    rng = random.Random(seed)
    rows = [(1 if i % 3 == 0 else rng.randrange(2, 20), TS(2020, 1, 1) + dt.timedelta(days=rng.randrange(900)), i,
             rng.choice(["bronze", "silver", None]), rng.random() < 0.2) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, at timestamp_ntz, seq int, tier string, late boolean")


def versions_of(rows):
    """Versions straight from the rules."""
    out = set()
    for key in {r[0] for r in rows}:
        last = {}
        for _, at, seq, tier, _ in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            last[at] = tier
        starts = []
        for at in sorted(last):
            if not starts or starts[-1][1] != last[at]:
                starts.append((at, last[at]))
        for i, (at, tier) in enumerate(starts):
            end = starts[i + 1][0] if i + 1 < len(starts) else OPEN
            out.add((key, tier, at, end, i + 1 == len(starts)))
    return out


def as_set(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("chunk", ["month", "year", "day"])
def test_versions_of_a_skewed_feed(spark, chunk):
    rows, df = feed(spark)
    got = build_versions(df, "id", "at", ["seq"], ["tier"], chunk)
    assert as_set(got) == versions_of(rows)
    assert got.where("is_current").groupBy("id").count().where("count <> 1").count() == 0


def test_changes_without_key_or_time_make_no_version(spark):
    rows, df = feed(spark)
    odd = df.limit(3).withColumn("id", F.lit(None).cast(df.schema["id"].dataType)).unionByName(
        df.limit(2).withColumn("at", F.lit(None).cast(df.schema["at"].dataType)))
    got = build_versions(df.unionByName(odd), "id", "at", ["seq"], ["tier"])
    assert as_set(got) == versions_of(rows)
    assert unversioned_changes(df.unionByName(odd), "id", "at").count() == 5


def test_late_changes_split_versions_and_keep_keys(spark):
    rows, df = feed(spark, seed=2)
    first = with_version_keys(build_versions(df.where("not late"), "id", "at", ["seq"], ["tier"]), "id", "sk").cache()
    merged = merge_versions(first, df, df.where("late"), "id", "sk", "at", ["seq"], ["tier"]).cache()
    assert as_set(merged.drop("sk")) == versions_of(rows)
    assert merged.select("sk").distinct().count() == merged.count()
    old = {(r.id, r.effective_start_date): r.sk for r in first.collect()}
    new = {(r.id, r.effective_start_date): r.sk for r in merged.collect()}
    assert all(new[k] == old[k] for k in new.keys() & old.keys())
    assert min(new[k] for k in new.keys() - old.keys()) > max(old.values())


def test_replaying_a_merge_changes_nothing(spark):
    _, df = feed(spark, seed=3)
    first = with_version_keys(build_versions(df, "id", "at", ["seq"], ["tier"]), "id", "sk").cache()
    again = merge_versions(first, df, df, "id", "sk", "at", ["seq"], ["tier"])
    columns = ["id", "sk", "tier", "effective_start_date", "effective_end_date", "is_current"]
    assert as_set(again.select(columns)) == as_set(first.select(columns))


def test_version_join_takes_start_and_leaves_end(spark):
    v = spark.createDataFrame([(1, 10, TS(2024, 1, 1), TS(2024, 2, 1)), (1, 11, TS(2024, 2, 1), OPEN)],
                              "k int, sk bigint, effective_start_date timestamp_ntz, effective_end_date timestamp_ntz")
    f = spark.createDataFrame([("a", 1, TS(2024, 1, 1)), ("b", 1, TS(2024, 2, 1)), ("c", 1, TS(2023, 1, 1)),
                               ("d", None, TS(2024, 1, 1)), ("e", 2, TS(2024, 1, 1))], "id string, k int, at timestamp_ntz")
    got = {r.id: r.sk for r in join_version(f, v, "k", "sk", F.col("at"), -1).collect()}
    assert got == {"a": 10, "b": 11, "c": -1, "d": -1, "e": -1}


@pytest.mark.parametrize("side", ["previous", "next"])
def test_neighbour_equals_plain_window(spark, side):
    _, df = feed(spark)
    df = df.groupBy("id", "at").agg(F.max("seq").alias("seq"))
    w = Window.partitionBy("id").orderBy("at")
    plain = df.select("id", "at", (F.lag("seq") if side == "previous" else F.lead("seq")).over(w).alias("n"))
    ours = with_neighbour_chunked(add_chunk(df, "at", "month"), "id", "at", ["seq"], side, "n")
    assert as_set(ours.select("id", "at", "n.seq")) == as_set(plain)
    assert as_set(with_neighbour(df, "id", "at", ["seq"], side, "n").select("id", "at", "n.seq")) == as_set(plain)


def test_latest_row_per_key(spark):
    df = spark.createDataFrame([("a", 1, None, "x"), ("a", 1, 5, "y"), ("b", 2, 1, "z"), ("b", 1, 9, "w")],
                               "k string, t int, u int, v string")
    assert as_set(latest_per_key(df, ["k"], ["t", "u"])) == {("a", 1, 5, "y"), ("b", 2, 1, "z")}


def test_keys_are_dense_stable_and_go_on(spark):
    names = [f"trip-{i}" for i in range(500)]
    df = spark.createDataFrame([(n,) for n in names + names[:100] + [None]], "id string")
    keys = assign_surrogate_keys(df, "id", "sk").cache()
    assert sorted(r.sk for r in keys.collect()) == list(range(1, 501))
    assert as_set(keys) == as_set(assign_surrogate_keys(df.repartition(7), "id", "sk"))
    more = df.union(spark.createDataFrame([(f"new-{i}",) for i in range(20)], "id string"))
    fresh = assign_surrogate_keys(more, "id", "sk", existing=keys)
    assert sorted(r.sk for r in fresh.collect()) == list(range(501, 521))


def test_null_keys_are_spread_and_kept(spark):
    left = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.col("id") % 5).alias("k"))
    right = spark.createDataFrame([(0, "a"), (1, "b"), (None, "never")], "kk bigint, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = join_spreading_nulls(left, right, "k", "kk", "id").cache()
        assert joined.count() == 3000
        assert joined.where("k is null and v is not null").count() == 0
        assert joined.where("k = 0 and v <> 'a'").count() == 0 and joined.where("k = 1 and v is null").count() == 0
        tasks = joined.where("k is null").select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64MB")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "64MB")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_quality_counts(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "B ", 200), (None, None, None), (4, "zz", 0)], "k int, c string, n int")
    parent = spark.createDataFrame([(1,), (1,)], "k int")
    rows = quality.quality_report([
        quality.row_rules_report(df, "t", [quality.not_null("k"), quality.accepted("c", ["a", "b"]),
                                           quality.in_range("n", 0, 100), quality.max_length("c", 1)]),
        quality.unique_report(df, "t", ["k"]), quality.foreign_key_report(df, "t", "k", parent, "k")]).collect()
    assert {(r.rule, r.column_name): (r.rows_checked, r.failures) for r in rows} == {
        ("not_null", "k"): (4, 1), ("accepted_values", "c"): (4, 1), ("in_range", "n"): (4, 1),
        ("max_length", "c"): (4, 2), ("unique", "k"): (4, 1), ("foreign_key", "k"): (4, 1)}
    assert as_set(quality.orphans(df, "k", parent, "k").select("k")) == {(4,)}


def test_masks(spark):
    df = spark.createDataFrame([("abcdef", "abc", TS(2024, 5, 6, 7)), (None, "abcd", None)],
                               "a string, b string, t timestamp_ntz")
    got = masking.mask_columns(df, {"a": "last4", "b": "last4", "t": "year"}).collect()
    assert [tuple(r) for r in got] == [("****cdef", "****", dt.date(2024, 1, 1)), (None, "****", None)]
    both = masking.mask_for_readers(df, {"a": "full"}, F.col("b") == "abc").collect()
    assert [r.a for r in both] == ["abcdef", None]
    with pytest.raises(ValueError):
        masking.masked("a", "rot13")


def test_stored_conditions_are_data_not_code(spark):
    p = spark.createDataFrame(
        [(1, "t", "city = 'NYC'", "READ", True, 50), (2, "t", "city=NYC", "READ", True, 50),
         (3, "t", "city = 'x' or 1 = 1", "READ", True, 1), (4, "t", "true", "READ", True, 1),
         (5, "t", "zone = 'Z'", "READ", True, 60), (6, "t", "city = 'NYC'", "READ", False, 1)],
        "policy_sk bigint, resource_pattern string, policy_condition string, action_type string, is_active boolean, "
        "priority_order int")
    rows = spark.createDataFrame([(1, "NYC", "Z"), (2, "LA", "Z"), (3, "LA", "Y")], "id int, city string, zone string")
    got = policies.first_policy(rows, "id", ["city", "zone"], policies.parsed_policies(p, "t", "READ"))
    assert as_set(got) == {(1, 1, 50), (2, 5, 60)}


def test_archive_keeps_rows_without_time(spark):
    df = spark.createDataFrame([(1, TS(2024, 1, 1)), (2, TS(2023, 12, 31)), (3, None)], "id int, at timestamp_ntz")
    split = {r.id: r.is_archived for r in retention.archive_split(df, "at", "2024-01-31 00:00:00", 30).collect()}
    assert split == {1: False, 2: True, 3: False}
    kept, gone = (f(df, "at", "2024-01-31 00:00:00", 30) for f in (retention.kept_rows, retention.archived_rows))
    assert kept.count() == 2 and gone.count() == 1


def test_no_retention_period_purges_nothing(spark):
    df = spark.createDataFrame([(1, TS(2000, 1, 1))], "id int, at timestamp_ntz")
    rules = spark.createDataFrame([("t", None), ("u", 1)], "table_name string, retention_period_days int")
    assert retention.retention_purge(df, "t", "at", rules, "2024-01-01").count() == 0
    assert retention.retention_purge(df, "u", "at", rules, "2024-01-01").count() == 1


@pytest.mark.parametrize("at, key, weekday, week, hour12, label, rush", [
    (TS(2024, 12, 30, 0, 5), 202412300005, 1, 1, 12, "night", "off_peak"),
    (TS(2024, 6, 2, 7, 0), 202406020700, 7, 22, 7, "morning", "off_peak"),
    (TS(2024, 6, 3, 18, 59), 202406031859, 1, 23, 6, "evening", "evening_rush"),
    (TS(2024, 6, 3, 12, 0), 202406031200, 1, 23, 12, "afternoon", "off_peak")])
def test_calendar(spark, at, key, weekday, week, hour12, label, rush):
    r = spark.createDataFrame([(at,)], "t timestamp_ntz").select(calendar_columns("t")).first()
    assert (r.time_sk, r.day_of_week, r.week_of_year, r.hour_12, r.business_hours, r.rush_hour) == (
        key, weekday, week, hour12, label, rush)


def test_date_range_is_whole(spark):
    df = spark.createDataFrame([(TS(2024, 2, 27, 5),), (TS(2024, 3, 1),), (None,)], "t timestamp_ntz")
    assert [r.day.day for r in dimensions.date_range(df, "t").orderBy("day").collect()] == [27, 28, 29, 1]


def test_replayed_load_gives_the_same_facts_and_only_new_rows(spark):
    from farelake.sources.samples import SampleWarehouse
    wh = SampleWarehouse(spark, "/root/testdata/sf0.001")
    staging = facts.ingest_staging(facts.valid_rows(wh["staging_raw_trips"]))
    dims = {n: wh[n] for n in ("dim_drivers", "dim_riders", "dim_trip_status")}
    places = dimensions.with_location_keys(dimensions.load_locations(wh["staging_raw_trips"]))
    dims["dim_locations"] = places
    part = facts.load_fact_trips(staging.where("processed"), dims).cache()
    rest = facts.load_fact_trips(staging, dims, existing=part).cache()
    assert part.join(rest, "trip_id").count() == 0
    assert part.count() + rest.count() == staging.count()
    assert part.unionByName(rest).select("trip_sk").distinct().count() == staging.count()
    assert facts.load_fact_trips(staging, dims, existing=part.unionByName(rest)).count() == 0
    totals = part.where("total_fare is not null").select(
        F.sum("total_fare").alias("a"), F.sum(F.col("driver_earnings") + F.col("company_commission")).alias("b")).first()
    assert totals.a == totals.b
    assert dimensions.with_location_keys(places.drop("location_sk"), places).count() == 0


def test_daily_totals_equal_fact_totals(spark):
    from farelake.sources.samples import SampleWarehouse
    wh = SampleWarehouse(spark, "/root/testdata/sf0.001")
    days = facts.driver_daily(wh["fact_trips"], wh["dim_trip_status"])
    a = days.agg(F.sum("total_trips").alias("n"), F.sum("gross_earnings").alias("g")).first()
    b = wh["fact_trips"].where("pickup_timestamp is not null").agg(
        F.count("*").alias("n"), F.sum("total_fare").alias("g")).first()
    assert (a.n, a.g) == (b.n, b.g)
