"""Structured Streaming forms of the queue and telemetry operators."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """An event folder as a stream; new Parquet files are new events."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deliver_once(events: DataFrame, ts: str, keys: list[str], delay: str) -> DataFrame:
    """Each idempotency key once within the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def error_ratio(events: DataFrame, ts: str, failed: Column, window: str, delay: str) -> DataFrame:
    """Failures over events in tumbling windows; a window is final when the watermark passes it."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, window)).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("errors"))


def retry_states(events: DataFrame, key: str, failed: str, limit: int = 5) -> DataFrame:
    """(key, failures, state) after every batch: a counter for each key, dead_letter at ``limit``, done after a success.

    ``events`` has the key (long) and a boolean ``failed``. State expires with the query; a key's events of a batch
    come in any order, since only counts matter.
    """

    def step(key_values: tuple, frames, state: GroupState):
        failures, done = state.get if state.exists else (0, False)
        for frame in frames:
            failures += int(frame[failed].sum())
            done = done or bool((~frame[failed]).any())
        state.update((failures, done))
        yield pd.DataFrame({key: [key_values[0]], "failures": [failures], "state": ["dead_letter" if failures >= limit else "done" if done else "queued"]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} long, failures long, state string", "failures long, done boolean", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Handle all that is there, batch by batch, and stop; the checkpoint makes a rerun go on after the last batch.

    ``handle`` must be idempotent for a batch number, as a batch may be repeated after a failure.
    """
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start().awaitTermination()
