"""Attribute histories, as-of joins, constraints and folder archives against plain computations."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from farelake.operators import constraints, policies, retention
from farelake.operators.scd2 import build_sparse_versions, join_version
from farelake.sources.samples import SampleWarehouse
from farelake.sources.tables import read_table, write_table

SF = "/root/testdata/sf0.001"
OPEN = dt.datetime(9999, 12, 31)
T0 = dt.datetime(2024, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def plain_histories(log, attributes):
    """Versions by replaying each key's log in order."""
    out = set()
    for key in {r[0] for r in log if r[0] is not None}:
        state, versions = {}, []
        own = sorted((r for r in log if r[0] == key and r[1] is not None and r[3] in attributes), key=lambda r: (r[1], r[2]))
        for at in sorted({r[1] for r in own}):
            for r in own:
                if r[1] == at:
                    state[r[3]] = r[4]
            values = tuple(state.get(a) for a in attributes)
            if not versions or versions[-1][1] != values:
                versions.append((at, values))
        for k, (at, values) in enumerate(versions):
            end = versions[k + 1][0] if k + 1 < len(versions) else OPEN
            out.add((key, *values, at, end, k + 1 == len(versions)))
    return out


def test_sparse_histories_equal_a_replay(spark):
    r = random.Random(11)
    log = []
    for seq in range(900):
        key = r.choice([1, 1, 1, 2, 3, None])  # one key with most of the rows
        at = None if r.random() < 0.02 else T0 + dt.timedelta(days=r.randrange(400), hours=r.choice([0, 0, 5]))
        log.append((key, at, seq, r.choice(["a", "b", "c", "unused"]), r.choice(["x", "y", None])))
    df = spark.createDataFrame(log, "id int, at timestamp_ntz, seq int, attribute string, value string").repartition(5)
    attributes = {"a": "string", "b": "string", "c": "string"}
    want = plain_histories(log, list(attributes))
    for chunk in ("day", "month", "year"):
        got = build_sparse_versions(df, "id", "at", ["seq"], attributes, chunk)
        assert {tuple(x) for x in got.select("id", "a", "b", "c", "effective_start_date", "effective_end_date", "is_current").collect()} == want
        assert got.count() == len(want)


def test_sparse_values_that_do_not_fit_are_null(spark):
    df = spark.createDataFrame([(1, T0, 1, "n", "7"), (1, T0 + dt.timedelta(days=1), 2, "n", "seven"), (2, T0, 1, "n", None)],
                               "id int, at timestamp_ntz, seq int, attribute string, value string")
    got = build_sparse_versions(df, "id", "at", ["seq"], {"n": "int", "m": "date"})
    assert {(x.id, x.n, x.m) for x in got.collect()} == {(1, 7, None), (1, None, None), (2, None, None)}
    assert build_sparse_versions(df.limit(0), "id", "at", ["seq"], {"n": "int"}).count() == 0


def test_as_of_join_of_a_key_with_very_many_versions(spark):
    """100,000 versions and 100,000 facts of one key: linear, where pairs would be 10 ** 10."""
    n = 100_000
    versions = spark.range(n).select(
        F.lit(1).alias("k"), (F.col("id") + 10).alias("sk"),
        (F.lit(T0) + F.make_dt_interval(mins=F.col("id").cast("int") * 5)).cast("timestamp_ntz").alias("effective_start_date"),
        (F.lit(T0) + F.make_dt_interval(mins=F.col("id").cast("int") * 5 + 4)).cast("timestamp_ntz").alias("effective_end_date"))
    facts = spark.range(n).select("id", F.lit(1).alias("k"),
                                  (F.lit(T0) + F.make_dt_interval(mins=F.col("id").cast("int") * 5 - 3 + F.col("id").cast("int") % 5)).cast("timestamp_ntz").alias("at"))
    got = join_version(facts, versions, "k", "sk", F.col("at"), -1)
    minute = F.col("id") * 5 - 3 + F.col("id") % 5
    want = F.when((minute < 0) | (F.pmod(minute, F.lit(5)) == 4), F.lit(-1)).otherwise(F.floor(minute / 5) + 10)
    assert got.count() == n and got.where(F.col("sk") != want).count() == 0


def test_as_of_join_carries_versions_over_months_and_takes_null_keys(spark):
    versions = spark.createDataFrame([(1, 10, T0, T0 + dt.timedelta(days=200)), (1, 11, T0 + dt.timedelta(days=200), OPEN), (2, 12, T0, OPEN)],
                                     "k int, sk bigint, effective_start_date timestamp_ntz, effective_end_date timestamp_ntz")
    facts = spark.createDataFrame([(i, k, at, "x") for i, (k, at) in enumerate(
        [(1, T0 + dt.timedelta(days=d)) for d in (-1, 0, 40, 199, 200, 900)] + [(None, T0), (2, None), (2, T0 + dt.timedelta(days=3000)), (3, T0)])],
        "id int, k int, at timestamp_ntz, _at string")
    got = {r.id: r.sk for r in join_version(facts.drop("_at"), versions, "k", "sk", F.col("at"), -1).collect()}
    assert got == {0: -1, 1: 10, 2: 10, 3: 10, 4: 11, 5: 11, 6: -1, 7: -1, 8: 12, 9: -1}
    assert join_version(facts.limit(0), versions, "k", "sk", F.col("at"), -1).count() == 0


def test_keys_of_all_tables_are_one_shuffle(spark):
    t = {"fact_trips": spark.createDataFrame([(1, 5, 200101010000), (1, None, 200101012460), (2, 6, 200101020000), (3, 6, None)],
                                             "trip_sk long, driver_sk long, pickup_time_sk long"),
         "dim_drivers": spark.createDataFrame([(5,), (5,)], "driver_sk long"),
         "dim_time": spark.range(1440).select((F.lit(200101010000) + F.floor(F.col("id") / 60) * 100 + F.col("id") % 60).alias("time_sk"))}
    report = constraints.key_report(t)
    got = {(r.table_name, r.rule, r.column_name): (r.rows_checked, r.failures) for r in report.collect()}
    assert got[("fact_trips", "unique", "trip_sk")] == (4, 1) and got[("dim_drivers", "unique", "driver_sk")] == (2, 1)
    assert got[("fact_trips", "foreign_key", "driver_sk")] == (4, 2)
    assert got[("fact_trips", "foreign_key", "pickup_time_sk")] == (4, 2)  # minute 60 and a day the dimension lacks
    assert got[("dim_time", "unique", "time_sk")] == (1440, 0)
    # All pairs of all tables meet in one exchange; no parent is broadcast.
    assert len(re.findall(r"Exchange hashpartitioning\(c#\d+, k#", plan(constraints.key_report(t)))) == 1
    empty = constraints.key_report({n: df.limit(0) for n, df in t.items()})
    assert {(r.rows_checked, r.failures) for r in empty.collect()} == {(0, 0)}


def test_row_rules_take_declared_limits(spark):
    df = spark.createDataFrame([(1, None, "x" * 21, "gold"), (None, 2, "y", "tin")], "rider_sk long, rider_id int, phone string, loyalty_tier string")
    got = {(r.rule, r.column_name): r.failures for r in constraints.row_report({"dim_riders": df}).collect()}
    assert got == {("not_null", "rider_sk"): 1, ("not_null", "rider_id"): 1, ("max_length", "phone"): 1, ("max_length", "loyalty_tier"): 0,
                   ("accepted_values", "loyalty_tier"): 1}


def test_archive_moves_folders_unread(spark, tmp_path):
    wh = SampleWarehouse(spark, SF)
    trips, root, archive = wh["fact_trips"], str(tmp_path / "t"), str(tmp_path / "a")
    write_table(trips, root, "fact_trips", grain="month", whole=True)
    # A file that cannot be read lies in a folder that is moved whole: it is moved, not opened.
    old = sorted((tmp_path / "t" / "fact_trips").glob("pickup_month=199[0-9]-*"))[0]
    (old / "part-broken.parquet").write_bytes(b"no parquet")
    moved = retention.archive_folders(spark, root, archive, "fact_trips", "2001-07-31 12:00:00", 730, "month")
    assert len(moved) > 10 and (tmp_path / "a" / "fact_trips" / old.name / "part-broken.parquet").exists()
    (tmp_path / "a" / "fact_trips" / old.name / "part-broken.parquet").unlink()
    cutoff = dt.datetime(1999, 8, 1, 12)
    kept = spark.read.parquet(f"{root}/fact_trips")
    gone = spark.read.parquet(f"{archive}/fact_trips")
    assert kept.where(F.col("pickup_timestamp") < F.lit(cutoff)).count() == 0 and gone.where(F.col("pickup_timestamp") >= F.lit(cutoff)).count() == 0
    assert kept.count() + gone.count() == trips.count() and kept.where("pickup_timestamp is null").count() > 0
    # Again changes nothing.
    assert retention.archive_folders(spark, root, archive, "fact_trips", "2001-07-31 12:00:00", 730, "month") == []
    assert spark.read.parquet(f"{archive}/fact_trips").count() == gone.count()


def test_folders_of_no_table(spark, tmp_path):
    classes = spark.createDataFrame([("security_audit_log", None)], "table_name string, retention_period_days int")
    assert retention.purge_folders(spark, str(tmp_path), "security_audit_log", classes, "2024-01-31") == []
    assert retention.stored_folders(spark, str(tmp_path), "security_audit_log", "day") == []


def test_first_policy_decides(spark):
    rows = spark.createDataFrame([(1, "A", "Z1"), (2, "B", "Z1"), (3, "C", None), (4, None, None)], "k long, city string, zone_id string")
    rules = [(1, "r", "city = 'A'", "READ", True, 5), (2, "r", "zone_id = Z1", "WRITE", True, 7), (3, "r", "city = B", "READ", True, 9),
             (4, "r", "city = C or 1 = 1", "READ", True, 1), (5, "r", "city = C", "READ", False, 1), (6, "other", "city = C", "READ", True, 1)]
    policy = spark.createDataFrame(rules, "policy_sk long, resource_pattern string, policy_condition string, action_type string, is_active boolean, priority_order int")
    got = {r.k: (r.policy_sk, r.is_allowed) for r in policies.rows_by_policy(rows, "k", ["city", "zone_id"], policy, "r", "READ").collect()}
    assert got == {1: (1, True), 2: (2, False), 3: (None, False), 4: (None, False)}
    assert [r.k for r in policies.visible_rows(rows, "k", ["city", "zone_id"], policy, "r", "READ").collect()] == [1]
    assert [r.k for r in policies.visible_rows(rows, "k", ["city", "zone_id"], policy, "r", "WRITE").collect()] == [2]


def test_pruned_facts_of_touched_folders(spark, tmp_path):
    from farelake.sources.tables import in_folders

    wh = SampleWarehouse(spark, SF)
    write_table(wh["fact_trips"], str(tmp_path), "fact_trips", grain="month", whole=True)
    stored = read_table(spark, str(tmp_path), "fact_trips", "month")
    some = in_folders(stored, "pickup_month", [dt.date(1999, 3, 1), None])
    assert "PartitionFilters: [" in plan(some) and "pickup_month" in plan(some).split("PartitionFilters: [")[1].split("]")[0]
    assert some.count() == wh["fact_trips"].where("pickup_timestamp is null or (pickup_timestamp >= '1999-03-01' and pickup_timestamp < '1999-04-01')").count()
