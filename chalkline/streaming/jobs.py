"""Jobs as keyed streaming state with timers: attempts, retryable and fatal errors, dead letters, deadlines, cancellation.

Events of a job wait in its state until the watermark passes them and are then handled in the order of their times, so
batches may bring them in any order within the delay; an event id that comes again is known. A timer stands for each
waiting time and for the job's deadline. The result is that of ``operators.ops.job_outcomes`` over all events up to the
watermark.

The state needs Spark's RocksDB provider (``STATE_STORE``), which keeps it on disk and checkpoints changes.
"""

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chalkline.operators.ops import MAX_ATTEMPTS, Job

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUTCOME = "job_id long, at long, status string, attempts int, reason string"


class _Jobs(StatefulProcessor):
    def __init__(self, max_attempts: int):
        self.max_attempts = max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, attempts int, deadline long")
        self.waiting = handle.getMapState("waiting", "event_id long", "at long, kind string, retryable boolean, count int")
        self.seen = handle.getMapState("seen", "event_id long", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for r in frame.itertuples(index=False):
                at = int(r.at.timestamp())
                if not self.waiting.containsKey((r.event_id,)) and not self.seen.containsKey((r.event_id,)):
                    self.waiting.updateValue((r.event_id,), (at, r.kind, bool(r.retryable), int(r.count)))
                    self.handle.registerTimer(at * 1000)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        job = Job(*self.job.get()) if self.job.exists() else Job()
        due = sorted((v[0], k[0], *v[1:]) for k, v in self.waiting.iterator() if v[0] <= now)
        out = []
        for at, event_id, kind, retryable, count in due:
            before = job.deadline
            out += job.step(at, kind, retryable, count, self.max_attempts)
            if job.deadline != before:
                self.handle.registerTimer(job.deadline * 1000)
            self.waiting.removeKey((event_id,))
            if not job.ended():  # what comes for an ended job changes nothing, known or not
                self.seen.updateValue((event_id,), (at,))
        out += job.until(now)
        if job.ended() and self.seen.exists():
            self.seen.clear()
        self.job.update((job.status, job.attempts, job.deadline))
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=["job_id", "at", "status", "attempts", "reason"])

    def close(self) -> None:
        pass


def job_changes(events: DataFrame, delay: str, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(job_id, at, status, attempts, reason): every change of a job's status, when the watermark has passed it.

    events: job_id, event_id (longs), at (timestamp), kind (submitted, failed, succeeded, cancelled), retryable, count.
    """
    from pyspark.sql.types import StructType

    keyed = events.withWatermark("at", delay).groupBy("job_id")
    return keyed.transformWithStateInPandas(_Jobs(max_attempts), StructType.fromDDL(OUTCOME), "Append", "EventTime")


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that is idempotent: a batch writes its own partition, and replaces it when it is repeated."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_sink(spark: SparkSession, path: str, columns: Iterable[str] = ("job_id", "at", "status", "attempts", "reason")) -> DataFrame:
    return spark.read.schema(OUTCOME + ", batch int").parquet(path).select(*columns)
