"""Jobs as keyed state: equal to the batch query, however batches are cut, repeated or interrupted."""

import random

import pytest
from pyspark.sql import functions as F

from chalkline.operators import ops
from chalkline.streaming import events as stream_events
from chalkline.streaming import jobs

SCHEMA = "job_id long, event_id long, at timestamp, kind string, retryable boolean, count int"


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(jobs.STATE_STORE[0])
    spark.conf.set(*jobs.STATE_STORE)
    yield
    spark.conf.set(jobs.STATE_STORE[0], before)


def random_events(n_jobs=40, seed=2):
    """Job events by time, a few of them twice, and at the end one that moves the watermark past all others."""
    rng, rows = random.Random(seed), []
    for j in range(n_jobs):
        at, event = rng.randint(0, 400), j * 100
        rows.append((j, event, at, "submitted", None, rng.choice([3, 12])))
        for i in range(rng.randint(0, 8)):
            at += rng.randint(0, 150)
            rows.append((j, event + i + 1, at, rng.choice(["failed"] * 6 + ["succeeded", "cancelled", "odd"]), rng.random() < 0.9, 0))
        if rng.random() < 0.3:
            rows.append(rng.choice(rows[-2:]))
    rows += [(900, 1, 50, "failed", True, 0), (900, 2, 60, "succeeded", True, 0)]  # never submitted
    return sorted(rows, key=lambda r: r[2] + rng.randint(0, 50))  # out of order, within the delay


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA.replace("at timestamp", "at long")).withColumn("at", F.timestamp_seconds("at"))


def write(spark, rows, folder, parts):
    step = -(-len(rows) // parts)
    for i in range(parts):
        frame(spark, rows[i * step : (i + 1) * step]).coalesce(1).write.mode("append").parquet(folder)


def last(changes):
    best = changes.groupBy("job_id").agg(F.max_by(F.struct("at", "status", "attempts", "reason"), F.struct("at", F.col("status").isin(*ops._ENDED), "attempts")).alias("x"))
    return {(r.job_id, *r.x) for r in best.collect()}


def expected(spark, rows, now):
    return {tuple(r) for r in ops.job_outcomes(spark.createDataFrame(rows, SCHEMA.replace("at timestamp", "at long")), now).collect()}


def test_stream_is_the_batch_query(spark, rocksdb, tmp_path):
    rows, end = random_events(), (999, 1, 10_000, "submitted", False, 0)
    write(spark, rows, str(tmp_path / "in"), 6)
    write(spark, [end], str(tmp_path / "in"), 1)
    stream = stream_events.read_events(spark, str(tmp_path / "in"), frame(spark, [end]).schema, 1)
    handled, sink = [], jobs.batch_sink(str(tmp_path / "out"))

    def handle(batch, number):
        sink(batch, number)
        sink(batch, number)  # a batch that is repeated after a failure replaces itself
        handled.append(number)

    stream_events.run_available(jobs.job_changes(stream, "60 seconds"), str(tmp_path / "check"), handle)
    assert len(handled) >= 7
    found = jobs.read_sink(spark, str(tmp_path / "out"))
    assert found.count() == found.distinct().count()
    assert last(found) == expected(spark, rows, 9_000)
    # A second run from the checkpoint finds nothing new
    before = len(handled)
    stream_events.run_available(jobs.job_changes(stream, "60 seconds"), str(tmp_path / "check"), handle)
    assert last(jobs.read_sink(spark, str(tmp_path / "out"))) == expected(spark, rows, 9_000) and len(handled) - before <= 1


def test_restart_after_a_failed_batch(spark, rocksdb, tmp_path):
    rows, end = random_events(15, 5), (999, 1, 10_000, "submitted", False, 0)
    write(spark, rows, str(tmp_path / "in"), 4)
    write(spark, [end], str(tmp_path / "in"), 1)
    stream = stream_events.read_events(spark, str(tmp_path / "in"), frame(spark, [end]).schema, 1)
    sink, failed = jobs.batch_sink(str(tmp_path / "out")), []

    def handle(batch, number):
        sink(batch, number)
        if number == 2 and not failed:
            failed.append(number)
            raise RuntimeError("lost after writing")

    with pytest.raises(Exception, match="lost after writing"):
        stream_events.run_available(jobs.job_changes(stream, "60 seconds"), str(tmp_path / "check"), handle)
    stream_events.run_available(jobs.job_changes(stream, "60 seconds"), str(tmp_path / "check"), handle)
    found = jobs.read_sink(spark, str(tmp_path / "out"))
    assert failed == [2] and found.count() == found.distinct().count() and last(found) == expected(spark, rows, 9_000)


def test_outcomes_by_hand(spark):
    rows = [(1, 1, 0, "submitted", None, 3), (1, 2, 10, "failed", True, 0), (1, 3, 20, "succeeded", None, 0), (1, 4, 30, "failed", False, 0)]
    rows += [(2, 1, 0, "submitted", None, 3)] + [(2, i, i * 10, "failed", True, 0) for i in range(2, 9)]
    rows += [(3, 1, 0, "submitted", None, 3), (3, 2, 5, "failed", False, 0), (4, 1, 0, "submitted", None, 11), (4, 2, 400, "cancelled", None, 0), (5, 1, 0, "submitted", None, 10), (5, 2, 300, "succeeded", None, 0)]
    rows += [(6, 1, 0, "submitted", None, 3), (6, 2, 10, "failed", True, 0), (6, 2, 10, "failed", True, 0), (7, 2, 10, "succeeded", True, 0), (None, 1, 0, "submitted", True, 0), (8, 1, 350, "submitted", None, None)]
    assert expected(spark, rows, 420) == {(1, 20, "succeeded", 1, None), (2, 60, "dead_letter", 5, "attempts"), (3, 5, "failed", 1, "fatal"), (4, 400, "cancelled", 0, None), (5, 300, "failed", 0, "deadline"), (6, 300, "failed", 1, "deadline"), (8, 350, "queued", 0, None)}
    assert expected(spark, [], 10) == set()
