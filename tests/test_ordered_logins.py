"""The stream over attempts that come out of order against the plain fold."""

import datetime as dt
import random

from farelake.operators import logins
from farelake.streaming import jobs
from farelake.streaming.ordered_logins import ordered_login_outcomes
from tests.test_logins import SCHEMA, T0, attack, fold

END = dt.datetime(2024, 6, 1)


def delivered(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, source, **kw):
    stream = jobs.file_stream(spark, source, spark.createDataFrame([], SCHEMA).schema, max_files=1)
    return jobs.run_available(ordered_login_outcomes(stream, **kw), str(tmp_path / "out"), str(tmp_path / "cp"))


def as_fold(df):
    rows = df.collect()
    out = {r.attempt_id: (r.result, r.failed_login_attempts, r.locked_until) for r in rows}
    assert len(out) == len(rows)
    return out


def test_shuffled_batches_equal_batch_result(spark, tmp_path):
    """Each attempt comes up to one delivery late; a heartbeat moves the watermark past the last one."""
    rows = [r for r in attack(11, users=4, n=150) if r[2] < T0 + dt.timedelta(days=4)]
    rng, day = random.Random(1), lambda r: (r[2] - T0).days
    batches = [[] for _ in range(6)]
    for r in rows:
        batches[day(r) + rng.randrange(2)].append(r)
    for b in batches:
        rng.shuffle(b)
    source = str(tmp_path / "in")
    delivered(spark, source, [b for b in batches if b] + [[(None, None, END, None)]])
    got = run(spark, tmp_path, source, delay="2 days", bucket_minutes=30)
    assert as_fold(got) == fold(rows)
    batch = logins.login_outcomes(spark.createDataFrame(rows, SCHEMA))
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_stopped_stream_goes_on_and_rows_without_place_are_left_out(spark, tmp_path):
    rows = [(i, 1, T0 + dt.timedelta(minutes=i), False) for i in range(8)]
    odd = [(90, None, T0, True), (91, 1, None, True), (92, None, None, None)]
    source = str(tmp_path / "in")
    delivered(spark, source, [rows[4:] + odd])
    assert run(spark, tmp_path, source).count() == 0                  # still within the delay
    delivered(spark, source, [rows[:4], [(99, None, END, True)]])     # earlier attempts, then a heartbeat
    want = fold(rows)
    assert as_fold(run(spark, tmp_path, source)) == want
    late = [(50, 1, T0, True)]
    delivered(spark, source, [late])
    assert as_fold(run(spark, tmp_path, source)) == want              # behind the watermark


def test_no_rows(spark, tmp_path):
    source = str(tmp_path / "in")
    delivered(spark, source, [[]])
    assert run(spark, tmp_path, source).count() == 0
