"""Epoch numbers of timestamps without a zone, whatever the session's zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _since_epoch(unit: str, ts: Column | str) -> Column:
    return F.timestamp_diff(unit, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(ts) if isinstance(ts, str) else ts)


def epoch_seconds(ts: Column | str) -> Column:
    return _since_epoch("SECOND", ts)


def epoch_micros(ts: Column | str) -> Column:
    return _since_epoch("MICROSECOND", ts)
