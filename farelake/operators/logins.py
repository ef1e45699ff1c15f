"""Login outcomes with lockout, per user in time order.

Rules for one attempt, given the user's failure counter and lock:

* locked while the lock lies after the attempt: outcome -1, nothing changes;
* right password: outcome 1, the counter goes to 0;
* else: outcome 0, the counter goes up, and from five on locks for 30 minutes.

Each outcome depends on the ones before it, so a user's attempts are folded in
time order. Most users are one fold each. A user with more than ``hot_rows``
attempts is cut into hours, counted from the first attempt: each hour is first
summed up as a small table "state at its start -> state at its end", those
tables are chained by day and by month, and once every hour's start state is
known all hours are folded at the same time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Failures that lock an account, and the lock's length in minutes.
LOCK_AFTER = 5
LOCK_MINUTES = 30
LOCK_US = LOCK_MINUTES * 60 * 1_000_000

HOT_ROWS = 100_000
BLOCKS = ("day", "month")

OUTCOME_SCHEMA = ("attempt_id bigint, user_sk bigint, attempt_ts timestamp_ntz, event_type string, success boolean, "
                  "result int, failed_login_attempts int, locked_until timestamp_ntz")
NAMES = {1: "LOGIN_SUCCESS", 0: "LOGIN_FAILED", -1: "LOGIN_ATTEMPT"}
NO_LOCK = np.iinfo(np.int64).min


def step(counter: int, lock: int, now: int, password_ok: bool) -> tuple[int, int, int]:
    """(outcome, counter, lock) after one attempt; times in microseconds."""
    if lock > now:
        return -1, counter, lock
    if password_ok:
        return 1, 0, NO_LOCK
    counter += 1
    return 0, counter, now + LOCK_US if counter >= LOCK_AFTER else NO_LOCK


def to_us(times: pd.Series) -> np.ndarray:
    """Microseconds since 1970, with NO_LOCK for a missing time."""
    return times.to_numpy("datetime64[us]").astype("int64")


def to_times(us) -> np.ndarray:
    return np.asarray(us, dtype="int64").astype("datetime64[us]")


def outcome_frame(ids, users, times, results, counters, locks) -> pd.DataFrame:
    results = np.asarray(results, dtype="int32")
    return pd.DataFrame({
        "attempt_id": ids, "user_sk": users, "attempt_ts": times,
        "event_type": [NAMES[r] for r in results.tolist()], "success": results == 1, "result": results,
        "failed_login_attempts": np.asarray(counters, dtype="int32"), "locked_until": to_times(locks)})


def _replay(batches: Iterator[pd.DataFrame], carry: Sequence[str] = ()) -> Iterator[pd.DataFrame]:
    """Fold rows sorted by (user, slice, time); only the running state is held."""
    group, counter, lock = None, 0, NO_LOCK
    for pdf in batches:
        keys = zip(pdf["user_sk"].tolist(), to_us(pdf["_slice"]).tolist())
        starts = zip(pdf["_counter"].tolist(), to_us(pdf["_lock"]).tolist())
        results, counters, locks = [], [], []
        rows = zip(keys, starts, to_us(pdf["attempt_ts"]).tolist(), pdf["password_ok"].tolist())
        for key, start, now, password_ok in rows:
            if key != group:
                group, (counter, lock) = key, start
            result, counter, lock = step(counter, lock, now, password_ok)
            results.append(result)
            counters.append(counter)
            locks.append(lock)
        out = outcome_frame(pdf["attempt_id"], pdf["user_sk"], pdf["attempt_ts"], results, counters, locks)
        yield out.assign(**{c: pdf[c] for c in carry})


# --- hot users: start-to-end tables per time slice -------------------------------------------

# A slice's table has one entry per possible start: counters 0 to 4, "5 or more", and then one
# per attempt in its first half hour at which a lock may have just run out, and one for later.
# ``fails`` counts failures since ``reset`` (a success) or else since the start.
TABLE_SCHEMA = ("user_sk bigint, _slice timestamp_ntz, entries array<bigint>, fails array<int>, "
                "reset array<boolean>, lock array<bigint>")
START_SCHEMA = "user_sk bigint, _slice timestamp_ntz, _counter int, _lock timestamp_ntz"


def _table_row(user, begin, entries, outs) -> pd.DataFrame:
    fails, reset, lock = zip(*outs)
    return pd.DataFrame({"user_sk": [user], "_slice": [begin], "entries": [list(entries)], "fails": [list(fails)],
                         "reset": [list(reset)], "lock": [list(lock)]})


def _slice_table(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Start-to-end table of one user's slice, by one backward pass."""
    pdf = pdf.sort_values(["attempt_ts", "attempt_id"])
    times, good = to_us(pdf["attempt_ts"]), pdf["password_ok"].to_numpy(dtype=bool)
    n = len(times)
    places = np.arange(n)
    failures_so_far = places - np.maximum.accumulate(np.where(good, places, -1))
    lock_places = np.flatnonzero(failures_so_far == LOCK_AFTER)
    next_lock_place = np.searchsorted(lock_places, places, side="right")
    after_lock = np.searchsorted(times, times + LOCK_US, side="left")
    # outs[i]: evaluation goes on at attempt i with a counter of five or more.
    outs = [None] * n + [(0, False, NO_LOCK)]

    def locked_at(place: int, fails: int, reset: bool):
        nxt = int(after_lock[place])
        if nxt == n:
            return fails, reset, int(times[place]) + LOCK_US
        later_fails, later_reset, lock = outs[nxt]
        return (later_fails, True, lock) if later_reset else (fails + later_fails, reset, lock)

    for i in range(n - 1, -1, -1):
        if not good[i]:
            outs[i] = locked_at(i, 1, False)
        elif next_lock_place[i] < len(lock_places):
            outs[i] = locked_at(int(lock_places[next_lock_place[i]]), LOCK_AFTER, True)
        else:
            outs[i] = (int(failures_so_far[-1]), True, NO_LOCK)

    first_good = int(np.argmax(good)) if good.any() else n
    starts = []
    for counter in range(LOCK_AFTER):
        needed = LOCK_AFTER - counter
        if first_good >= needed:
            starts.append(locked_at(needed - 1, needed, False))
        else:
            starts.append(outs[first_good] if first_good < n else (n, False, NO_LOCK))
    starts.append(outs[0])
    begin = int(np.datetime64(key[1], "us").astype("int64"))
    first = int(np.searchsorted(times, begin + LOCK_US, side="left"))
    return _table_row(key[0], key[1], times[:first].tolist(), starts + outs[:first + 1])


def _advance(table, counter: int, lock: int) -> tuple[int, int, bool]:
    """(counter, lock, whether a success reset it) at a slice's end, from its start."""
    if lock == NO_LOCK:
        at = min(counter, LOCK_AFTER)
    else:
        at = LOCK_AFTER + 1 + int(np.searchsorted(table.entries, lock, side="left"))
    reset = bool(table.reset[at])
    return int(table.fails[at]) + (0 if reset else counter), int(table.lock[at]), reset


def _chain_tables(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One table for a run of slices; it has the first slice's possible starts."""
    tables = list(pdf.sort_values("_slice").itertuples(index=False))
    entries = [int(e) for e in tables[0].entries]
    begins = [(c, NO_LOCK) for c in range(LOCK_AFTER + 1)]
    begins += [(LOCK_AFTER, e) for e in entries] + [(LOCK_AFTER, entries[-1] + 1 if entries else 0)]
    outs = []
    for begin, lock in begins:
        counter, was_reset = begin, False
        for table in tables:
            counter, lock, reset = _advance(table, counter, lock)
            was_reset = was_reset or reset
        outs.append((counter if was_reset else counter - begin, was_reset, lock))
    return _table_row(key[0], key[1], entries, outs)


def _slice_starts(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """State at the start of each slice, from the state at the first one's start."""
    pdf = pdf.sort_values("_slice")
    counter, lock = int(pdf["_counter"].iloc[0]), int(to_us(pdf["_lock"])[0])
    counters, locks = [], []
    for table in pdf.itertuples(index=False):
        counters.append(counter)
        locks.append(lock)
        counter, lock, _ = _advance(table, counter, lock)
    return pd.DataFrame({"user_sk": pdf["user_sk"], "_slice": pdf["_slice"],
                         "_counter": np.asarray(counters, dtype="int32"), "_lock": to_times(locks)})


def _block(level: str):
    return F.date_trunc(level, F.col("_slice")).cast("timestamp_ntz")


def _hot_slice_starts(hot: DataFrame, state: DataFrame | None) -> DataFrame:
    """State at the start of every hour of the hot users."""
    tables = [hot.groupBy("user_sk", "_slice").applyInPandas(_slice_table, TABLE_SCHEMA)]
    for level in BLOCKS:
        tables.append(tables[-1].groupBy("user_sk", _block(level).alias("_block"))
                      .applyInPandas(_chain_tables, TABLE_SCHEMA))
    starts = (_with_state(tables[-1], state).groupBy("user_sk").applyInPandas(_slice_starts, START_SCHEMA))
    for finer, level in zip(reversed(tables[:-1]), reversed(BLOCKS)):
        blocks = starts.withColumnRenamed("_slice", "_block")
        starts = (finer.withColumn("_block", _block(level)).join(blocks, ["user_sk", "_block"])
                  .groupBy("user_sk", "_block").applyInPandas(_slice_starts, START_SCHEMA))
    return starts


def _with_state(rows: DataFrame, state: DataFrame | None) -> DataFrame:
    """Add the state each user starts from: counter 0 and no lock unless given."""
    if state is None:
        return rows.withColumns({"_counter": F.lit(0), "_lock": F.lit(None).cast("timestamp_ntz")})
    begin = state.select("user_sk", F.col("failed_login_attempts").alias("_c"),
                         F.col("account_locked_until").alias("_l"))
    return (rows.join(begin, "user_sk", "left")
            .withColumn("_counter", F.coalesce("_c", F.lit(0)))
            .withColumn("_lock", F.when(F.col("_counter") >= LOCK_AFTER, F.col("_l")))
            .drop("_c", "_l"))


def login_outcomes(attempts: DataFrame, state: DataFrame | None = None, hot_rows: int = HOT_ROWS,
                   carry: Sequence[str] = ()) -> DataFrame:
    """Outcome of each attempt (attempt_id, user_sk, attempt_ts, password_ok).

    ``state`` holds counters and locks from an earlier run (``login_state``);
    the columns in ``carry`` are kept. Attempts without a user or time have no
    place in any order and are left out. Finding the hot users is one small job
    that counts attempts per user.
    """
    usable = attempts.where(F.col("user_sk").isNotNull() & F.col("attempt_ts").isNotNull())
    rows = usable.select("attempt_id", "user_sk", "attempt_ts",
                         F.coalesce("password_ok", F.lit(False)).alias("password_ok"), *carry)
    hot_users = (rows.groupBy("user_sk").agg(F.count(F.lit(1)).alias("_n"), F.min("attempt_ts").alias("_first"))
                 .where(F.col("_n") > hot_rows).select("user_sk", "_first"))
    whole = F.lit(None).cast("timestamp_ntz").alias("_slice")
    if hot_users.isEmpty():
        prepared = _with_state(rows.select("*", whole), state)
    else:
        cold = _with_state(rows.join(hot_users, "user_sk", "left_anti").select("*", whole), state)
        hours = (F.col("attempt_ts") - F.col("_first")).cast("interval hour").cast("int")
        hot = (rows.join(hot_users, "user_sk")
               .withColumn("_slice", F.col("_first") + F.make_dt_interval(hours=hours)).drop("_first"))
        starts = _hot_slice_starts(hot.select("attempt_id", "user_sk", "attempt_ts", "password_ok", "_slice"), state)
        prepared = cold.unionByName(hot.join(starts, ["user_sk", "_slice"]))
    return (prepared.repartition("user_sk", "_slice")
            .sortWithinPartitions("user_sk", "_slice", "attempt_ts", "attempt_id")
            .mapInPandas(partial(_replay, carry=tuple(carry)), _with_types(OUTCOME_SCHEMA, rows, carry)))


def _with_types(schema: str, rows: DataFrame, carry: Sequence[str]) -> str:
    return ", ".join([schema, *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carry)])


def login_audit_rows(outcomes: DataFrame) -> DataFrame:
    """The audit log rows of evaluated and refused attempts (carry ip_address and user_agent)."""
    # Descriptions by outcome.
    description = (F.when(F.col("result") == 1, "User authenticated").when(F.col("result") == 0, "Invalid password")
                   .otherwise("Account locked"))
    return outcomes.select("user_sk", "event_type", description.alias("event_description"), "success",
                           "ip_address", "user_agent", F.col("attempt_ts").alias("event_timestamp"))


def users_after_logins(users: DataFrame, state: DataFrame) -> DataFrame:
    """The user table as a new snapshot with the counters, locks and times of a run.

    A user without attempts keeps its row; a value the run did not set is kept.
    """
    columns = ("failed_login_attempts", "last_failed_login", "account_locked_until", "last_login_at")
    new = state.select("user_sk", F.lit(True).alias("_seen"), *[F.col(c).alias(f"_{c}") for c in columns],
                       F.col("last_failed_login").isNotNull().alias("_failed"))
    rows = users.join(new, "user_sk", "left")
    value = {
        "failed_login_attempts": F.coalesce("_failed_login_attempts", "failed_login_attempts"),
        "last_failed_login": F.coalesce("_last_failed_login", "last_failed_login"),
        # A failure sets the lock or clears it; without one the lock stays.
        "account_locked_until": F.when(F.col("_failed"), F.col("_account_locked_until"))
        .otherwise(F.col("account_locked_until")),
        "last_login_at": F.coalesce("_last_login_at", "last_login_at"),
    }
    return rows.select([value[c].alias(c) if c in value else F.col(c) for c in users.columns])


def login_state(outcomes: DataFrame) -> DataFrame:
    """Each user's state after its last attempt, as the user table keeps it."""
    when = F.struct("attempt_ts", "attempt_id")
    evaluated, failed = F.col("result") >= 0, F.col("result") == 0
    return outcomes.groupBy("user_sk").agg(
        F.coalesce(F.max_by("failed_login_attempts", when), F.lit(0)).alias("failed_login_attempts"),
        F.max(F.when(failed, F.col("attempt_ts"))).alias("last_failed_login"),
        F.max_by("locked_until", F.when(failed, when)).alias("account_locked_until"),
        F.max(F.when(F.col("result") == 1, F.col("attempt_ts"))).alias("last_login_at"),
        F.count(F.when(evaluated, 1)).alias("evaluated_attempts"),
    )
