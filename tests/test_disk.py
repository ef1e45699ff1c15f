"""Loads store and shuffle wide rows no more often than they must."""

import datetime as dt
import os
import re

from pyspark.sql import functions as F

from farelake.operators.scd2 import build_sparse_versions, join_version, join_versions
from farelake.plans.increment import IncrementalLoad
from farelake.session import CLEANUP, freed_shuffles
from tests.test_histories import OPEN, T0, plan

STAGING = ("trip_id string, driver_id int, requested_at timestamp_ntz, pickup_at timestamp_ntz, dropoff_at timestamp_ntz, rider_id int, "
           "raw_data string, status string, fare_breakdown string, ingestion_timestamp timestamp_ntz, ingestion_date date, note string")


def staging(spark, rows):
    return spark.createDataFrame([(t, d, T0, T0, None, 1, raw, s, None, T0 + dt.timedelta(days=day), (T0 + dt.timedelta(days=day)).date(), n)
                                  for t, d, raw, s, day, n in rows], STAGING)


def test_wide_staging_rows_of_a_batch_are_stored_once(spark, tmp_path):
    job = IncrementalLoad(spark, str(tmp_path), T0, grain="month")
    job._log(staging(spark, [("a", 1, "{}", "OLD", 2, "s"), ("b", 1, "{}", "OLD", 2, "s"), ("c", 1, "{}", "SAME", 2, "s"),
                             ("e", 1, "{}", "OLD", 2, "s"), ("z", 1, "{}", "OLD", 2, "s")]), "clean_staging")
    job._log(staging(spark, [("e", 1, "{}", "OLD", 4, "t")]), "clean_staging", 1)
    new = staging(spark, [("a", 2, "{}", "new ", 3, "n"), ("a", 2, "{}", "newer", 5, "n"),  # two later states of a stored trip
                          ("b", 2, "{}", "old", 1, "n"),                       # comes late, is no state
                          ("c", 1, "{}", "same", 2, "x"),                      # the stored row again
                          ("d", 4, "{}", "first", 1, "n"), ("d", 4, "{}", "last", 2, "n"), ("d", 4, "{}", "last", 2, "o"),
                          ("e", 1, "{}", "mid", 3, "n"),                       # older than the state of a batch between
                          ("z", 9, "{", "bad", 9, "n"), ("y", 9, "{", "bad", 9, "n"), (None, 9, "{}", "no id", 9, "n")])
    states = job._states({"staging_raw_trips": new}, 2)
    assert {(r.trip_id, r.status, r.note) for r in states.collect()} == {("a", "NEWER", "n"), ("d", "LAST", "o")}
    assert states.count() == 2 and set(states.columns) == set(new.columns)
    assert job.logged("clean_staging", 3).count() == 8
    folder = tmp_path / "_work" / "batches" / "2"
    wide = [n for n in os.listdir(folder) if "raw_data" in spark.read.parquet(str(folder / n)).columns]
    assert wide == ["quarantined"] and spark.read.parquet(str(folder / "quarantined")).count() == 3
    assert job._states({"staging_raw_trips": new.limit(0)}, 2).count() == 2  # complete, so taken up as it is


def test_as_of_join_of_two_tables_deals_out_the_facts_once(spark):
    days = [T0 + dt.timedelta(days=d) for d in range(0, 300, 7)]
    facts = spark.createDataFrame([(f"t{i}", k, at, "wide" * 9) for i, (k, at) in enumerate(
        (k, at) for k in (1, 2, None) for at in [*days, None])], "id string, k int, at timestamp_ntz, raw string")
    schema = "k bigint, sk bigint, effective_start_date timestamp_ntz, effective_end_date timestamp_ntz"
    one = spark.createDataFrame([(1, 1, days[3], days[9]), (1, 2, days[12], OPEN), (2, 3, T0, days[1])], schema)
    two = spark.createDataFrame([(1, 7, T0, days[20]), (2, 8, days[1], days[1]), (2, 9, days[30], OPEN)], schema)
    got = join_versions(facts, {"p": (one, "sk"), "q": (two, "sk")}, "k", F.col("at"), -1, keep=["id"])
    want = join_version(facts, one, "k", "sk", F.col("at"), -1).select("id", F.col("sk").alias("p")).join(
        join_version(facts, two, "k", "sk", F.col("at"), -1).select("id", F.col("sk").alias("q")), "id")
    assert got.columns == ["id", "p", "q"] and got.count() == facts.count()
    assert set(map(tuple, got.collect())) == set(map(tuple, want.collect()))
    plain = {(r.id, next((v[1] for v in ((1, 1, days[3], days[9]), (1, 2, days[12], OPEN), (2, 3, T0, days[1]))
                          if r.k == v[0] and r["at"] is not None and v[2] <= r["at"] < v[3]), -1)) for r in facts.collect()}
    assert {(r.id, r.p) for r in got.collect()} == plain
    # The facts are packed once for both tables, as their ids alone.
    text = plan(join_versions(facts, {"p": (one, "sk"), "q": (two, "sk")}, "k", F.col("at"), -1, keep=["id"]))
    assert re.findall(r"struct\(([^)]*)\) AS _fact#", text) and all(
        "raw" not in packed for packed in re.findall(r"struct\(([^)]*)\) AS _fact#", text))
    assert len(re.findall(r"struct\([^)]*\) AS _fact#", text)) == 1
    whole = join_version(facts, one, "k", "sk", F.col("at"), -1)
    assert whole.dtypes == [*facts.dtypes, ("sk", "bigint")]


def test_sparse_versions_look_back_with_one_table_of_attributes(spark):
    log = spark.createDataFrame([(1, T0, 1, "a", "x"), (1, T0 + dt.timedelta(days=40), 2, "a", "x"), (1, T0 + dt.timedelta(days=41), 3, "b", None),
                                 (1, T0 + dt.timedelta(days=80), 4, "b", "7"), (1, T0 + dt.timedelta(days=120), 5, "b", "seven"),
                                 (2, T0, 1, "b", None)], "id int, at timestamp_ntz, seq int, attribute string, value string")
    got = build_sparse_versions(log, "id", "at", ["seq"], {"a": "string", "b": "int"})
    day = lambda d: T0 + dt.timedelta(days=d)
    assert {tuple(r) for r in got.select("id", "a", "b", "effective_start_date", "effective_end_date", "is_current").collect()} == {
        (1, "x", None, day(0), day(80), False), (1, "x", 7, day(80), day(120), False), (1, "x", None, day(120), OPEN, True),
        (2, None, None, T0, OPEN, True)}
    assert "max_by(_value" not in plan(got) and "min_by(_value" not in plan(got)


def test_shuffle_files_go_with_their_statement(spark, tmp_path):
    before = spark.conf.get(CLEANUP)
    with freed_shuffles(spark):
        assert spark.conf.get(CLEANUP) == "true"
        df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
        df.write.parquet(str(tmp_path / "a"))
        assert df.count() == 7 and len(df.collect()) == 7 and len(df.collect()) == 7
    assert spark.conf.get(CLEANUP) == before
