"""Login outcomes of a stream whose attempts come out of order.

An attempt waits in keyed state until the watermark has passed the time bucket
it lies in; then the user's buckets are folded in time order from the counter and
lock kept so far. Waiting attempts are stored in packs: the buckets of one arriving batch in time order,
a new pack wherever one has ``PACK`` attempts or more. An ordinary user is one pack a batch; of a hot user, whose
packs are single buckets, neither a micro-batch nor the whole delay is ever held in one piece: memory is
bounded by one user's attempts of one bucket and by ``PACK`` attempts a batch within the delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from farelake.operators import logins
from farelake.streaming.jobs import event_time

MINUTE_US = 60_000_000
# Attempts from which on a pack takes up no further bucket.
PACK = 10_000


def packs_of(buckets: np.ndarray) -> Iterator[slice]:
    """Runs of ascending ``buckets``: whole buckets, as many as begin before a run has ``PACK`` rows."""
    starts = np.flatnonzero(np.diff(buckets, prepend=buckets[:1] - 1)).tolist()
    begin = 0
    for start in starts[1:]:
        if start - begin >= PACK:
            yield slice(begin, start)
            begin = start
    if len(buckets):
        yield slice(begin, len(buckets))


class OrderedLogins(StatefulProcessor):
    """Per user: the account's state, waiting packs by number with an index of their buckets, and one timer."""

    def __init__(self, bucket_us: int):
        self.bucket_us = bucket_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # The next pack's number and, of each waiting pack, its number, first and last bucket.
        self.account = handle.getValueState("account", "counter int, lock_us bigint, next int, numbers array<int>, "
                                                       "firsts array<bigint>, lasts array<bigint>, timer bigint")
        self.waiting = handle.getMapState("waiting", "pack int", "ids array<bigint>, times array<bigint>, good array<boolean>")

    def _known(self) -> list:
        """[counter, lock, next pack, waiting packs as (first, last, number), bucket of the timer or -1]."""
        held = self.account.get()
        if held is None:
            return [0, logins.NO_LOCK, 0, [], -1]
        counter, lock, following, numbers, firsts, lasts, timer = held
        return [counter, lock, following, list(zip(firsts, lasts, numbers)), timer]

    def _keep(self, known: list) -> None:
        """Store the state, with the timer at the end of the first waiting bucket."""
        counter, lock, following, packs, timer = known
        first = min((p[0] for p in packs), default=-1)
        if first != timer:
            if timer >= 0:
                self.handle.deleteTimer(self._end(timer))
            if first >= 0:
                self.handle.registerTimer(self._end(first))
        self.account.update((counter, int(lock), following, [p[2] for p in packs], [p[0] for p in packs], [p[1] for p in packs], first))

    def _end(self, bucket: int) -> int:
        """The end of a bucket in milliseconds."""
        return (bucket + 1) * self.bucket_us // 1000

    def _store(self, known: list, ids: np.ndarray, times: np.ndarray, good: np.ndarray) -> None:
        """Put attempts in time order into new packs."""
        buckets = times // self.bucket_us
        for run in packs_of(buckets):
            self.waiting.updateValue((known[2],), (ids[run].tolist(), times[run].tolist(), good[run].tolist()))
            known[3].append((int(buckets[run][0]), int(buckets[run][-1]), known[2]))
            known[2] += 1

    def _take(self, number: int) -> list[np.ndarray]:
        """A pack, which leaves the state."""
        ids, times, good = self.waiting.getValue((number,))
        self.waiting.removeKey((number,))
        return [np.asarray(ids, dtype="int64"), np.asarray(times, dtype="int64"), np.asarray(good, dtype=bool)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self._known()
        for pdf in rows:
            ids, times, good = (pdf[c].to_numpy() for c in ("attempt_id", "at_us", "password_ok"))
            order = np.argsort(times, kind="stable")
            self._store(known, ids[order], times[order], good[order])
        self._keep(known)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Fold all buckets that the watermark has passed, in the order of their times."""
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000 // self.bucket_us
        known = self._known()
        known[4] = -1  # the timer has gone off
        ready = sorted(p for p in known[3] if p[0] < passed)
        known[3] = [p for p in known[3] if p[0] >= passed]
        held = [np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0, bool)]
        while ready or len(held[0]):
            # Packs are taken up until what is held has all of its first buckets, up to the next pack's.
            while ready and (len(held[0]) == 0 or ready[0][0] <= held[1].min() // self.bucket_us):
                held = [np.concatenate(both) for both in zip(held, self._take(ready.pop(0)[2]))]
            until = min(ready[0][0], passed) if ready else passed
            now = held[1] < until * self.bucket_us
            if not now.any():
                break
            yield self._fold(key, known, *(a[now] for a in held))
            held = [a[~now] for a in held]
            if not ready:
                break
        if len(held[0]):
            order = np.argsort(held[1], kind="stable")
            self._store(known, *(a[order] for a in held))
        self._keep(known)

    def _fold(self, key, known: list, ids: np.ndarray, times: np.ndarray, good: np.ndarray) -> pd.DataFrame:
        """Outcomes of some attempts, which go on from the account's state."""
        order = np.lexsort((good, ids, times))
        ids, times = ids[order], times[order]
        counter, lock = known[:2]
        results, counters, locks = [], [], []
        for at, password_ok in zip(times.tolist(), good[order].tolist()):
            result, counter, lock = logins.step(counter, lock, at, password_ok)
            results.append(result)
            counters.append(counter)
            locks.append(lock)
        known[:2] = counter, lock
        return logins.outcome_frame(ids, [key[0]] * len(ids), logins.to_times(times), results, counters, locks)

    def close(self) -> None:
        pass


def ordered_login_outcomes(attempts: DataFrame, delay: str = "1 day", bucket_minutes: int = 60) -> DataFrame:
    """The batch job's outcomes for attempts at most ``delay`` out of order.

    An outcome is emitted once the watermark passes the end of its attempt's bucket.
    Attempts without a user or a time have no outcome, but the time of a row without a user moves the watermark: such rows
    serve as heartbeats when no one logs in. Attempts that come later than the
    delay are dropped, as are times before 1970; repeated rows are repeated attempts.
    """
    rows = (attempts.select("attempt_id", "user_sk", event_time("attempt_ts").alias("_event"),
                            F.coalesce("password_ok", F.lit(False)).alias("password_ok"))
            .withWatermark("_event", delay)
            # One condition on the event time, which Spark does not move before the watermark.
            .where(F.when(F.col("_event").isNotNull(), F.col("user_sk").isNotNull()))
            .select("attempt_id", "user_sk", "password_ok", F.unix_micros("_event").alias("at_us"), "_event"))
    return rows.groupBy("user_sk").transformWithStateInPandas(
        OrderedLogins(bucket_minutes * MINUTE_US), logins.OUTCOME_SCHEMA, "append", "EventTime")
