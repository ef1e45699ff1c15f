"""Login outcomes against a plain fold, on the direct path and on the sliced path for hot users."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from farelake.operators import logins

SCHEMA = "attempt_id bigint, user_sk bigint, attempt_ts timestamp_ntz, password_ok boolean"
T0 = dt.datetime(2024, 1, 30, 22, 0)


def fold(rows, start=None):
    """Outcomes by attempt id, straight from the rules."""
    state, out = dict(start or {}), {}
    for attempt, user, ts, ok in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        counter, lock = state.get(user, (0, None))
        if lock is not None and lock > ts:
            result = -1
        elif ok:
            result, counter, lock = 1, 0, None
        else:
            result, counter = 0, counter + 1
            lock = ts + dt.timedelta(minutes=30) if counter >= 5 else None
        state[user] = (counter, lock)
        out[attempt] = (result, counter, lock)
    return out


def outcomes(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    got = logins.login_outcomes(df, **kw).collect()
    assert len(got) == len(rows)
    return {r.attempt_id: (r.result, r.failed_login_attempts, r.locked_until) for r in got}


def attack(seed, users=6, n=400):
    """Users with different gaps and success rates, crossing hours, days and a month's end."""
    rng, rows, attempt = random.Random(seed), [], 0
    for user in range(users):
        ts = T0 + dt.timedelta(minutes=rng.randrange(300))
        gap, good = rng.choice([20, 120, 600, 1800, 3600]), rng.choice([0.0, 0.05, 0.3, 0.6])
        for _ in range(n):
            ts += dt.timedelta(seconds=rng.choice([0, 1, gap, rng.randrange(2 * gap)]))
            rows.append((attempt, user, ts, rng.random() < good))
            attempt += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sliced_path_equals_fold(spark, seed):
    rows = attack(seed)
    assert outcomes(spark, rows, hot_rows=0) == fold(rows)


def test_direct_path_equals_fold(spark):
    rows = attack(4)
    assert outcomes(spark, rows) == fold(rows)


def test_mixed_hot_and_cold_users(spark):
    rows = attack(5, users=3) + [(10_000 + i, 99, T0 + dt.timedelta(minutes=7 * i), False) for i in range(9)]
    assert outcomes(spark, rows, hot_rows=100) == fold(rows)


def test_lock_is_over_exactly_at_its_end(spark):
    rows = [(i, 1, T0 + dt.timedelta(seconds=i), False) for i in range(5)]
    end = T0 + dt.timedelta(seconds=4, minutes=30)
    rows += [(10, 1, end - dt.timedelta(microseconds=1), True), (11, 1, end, False), (12, 1, end, True)]
    for hot in (0, 100):
        got = outcomes(spark, rows, hot_rows=hot)
        assert got == fold(rows)
        assert got[10][0] == -1                 # the right password does not open a lock
        assert got[11][:2] == (0, 6)            # the counter outlives the lock and locks at once
        assert got[12][0] == -1


def test_run_goes_on_from_kept_state(spark):
    rows = attack(6, users=4, n=120)
    cut = sorted(r[2] for r in rows)[len(rows) // 2]
    first, rest = [r for r in rows if r[2] < cut], [r for r in rows if r[2] >= cut]
    kept = logins.login_state(logins.login_outcomes(spark.createDataFrame(first, SCHEMA)))
    for hot in (0, 1000):
        got = logins.login_outcomes(spark.createDataFrame(rest, SCHEMA), kept, hot_rows=hot).collect()
        want = fold(rows)
        assert {r.attempt_id: r.result for r in got} == {r[0]: want[r[0]][0] for r in rest}


def test_state_keeps_lock_of_last_failure(spark):
    rows = [(i, 1, T0 + dt.timedelta(seconds=i), False) for i in range(5)]
    rows.append((9, 1, T0 + dt.timedelta(hours=2), True))
    state = logins.login_state(logins.login_outcomes(spark.createDataFrame(rows, SCHEMA))).first()
    assert state.failed_login_attempts == 0
    assert state.account_locked_until == T0 + dt.timedelta(seconds=4, minutes=30)
    assert state.last_login_at == T0 + dt.timedelta(hours=2)
    assert state.evaluated_attempts == 6


def test_no_task_holds_a_hot_users_attempts(spark):
    """A user with most attempts is spread over hourly slices."""
    rows = [(i, 1, T0 + dt.timedelta(minutes=i), i % 11 == 0) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    slices = df.withColumn("h", F.date_trunc("hour", "attempt_ts")).groupBy("h").count()
    assert slices.agg(F.max("count")).first()[0] <= 60
    assert outcomes(spark, rows, hot_rows=10) == fold(rows)
