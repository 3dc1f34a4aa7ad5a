"""Finite state machines over the ordered events of a key, by composed transition functions.

An event is a function from states to states. Functions compose associatively, so the events of all keys are cut into
ranges of about RANGE_ROWS in order, whatever key they belong to: a range's functions are composed in parallel (a prefix
of them for every event), a key that spans several ranges has a function for each, and these few are folded to the state
in which the key enters each range. No key has to be in one task.
"""

import base64
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.operators.folds import ordered_fold
from chalkline.sources.scratch import scratch_table

RANGE_ROWS = 200_000


def prefixes(maps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The composition of each row's function with all before it from the row where ``first`` was last set; doubling steps."""
    out = maps.copy()
    start = np.maximum.accumulate(np.where(first, np.arange(len(maps)), 0))
    step = 1
    while step < len(maps):
        use = np.flatnonzero(np.arange(len(maps)) - step >= start)
        if not len(use):
            break
        out[use] = np.take_along_axis(out[use], out[use - step], axis=1)
        step *= 2
    return out


def _table(actions: dict[str, dict[int, int]], n_states: int) -> tuple[dict[str, int], np.ndarray]:
    """Numbers of the actions, and their functions; what isn't named stays."""
    table = np.tile(np.arange(n_states, dtype=np.uint8), (len(actions) + 1, 1))
    for i, moves in enumerate(actions.values(), 1):
        for a, b in moves.items():
            table[i, a] = b
    return {a: i for i, a in enumerate(actions, 1)}, table


def run_machine(events: DataFrame, keys: list[str], order: list[str], action: str, actions: dict[str, dict[int, int]], n_states: int, start: int = 0) -> DataFrame:
    """``events`` with ``state_before`` and ``state_after`` of each (numbers below ``n_states``, 256 at most).

    ``actions`` says for each action which states it changes, and to what; other actions (also null) change nothing.
    ``order`` tells all events of a key apart, else equal ones come in any order; null keys are a key of their own.
    """
    numbers, table = _table(actions, n_states)
    n = events.count()
    ranges = max(1, -(-n // RANGE_ROWS))
    ranged = events.repartitionByRange(ranges, *keys, *order).withColumn("__range", F.spark_partition_id())
    ranged = scratch_table(ranged, "ranges")
    by = [(c, "ascending") for c in [*keys, *order]]

    def composed(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        rows = rows.sort_by(by)
        code = np.array([numbers.get(a, 0) for a in rows.column(action).to_pylist()], np.int64)
        first = np.zeros(len(code), bool)
        first[:1] = True
        for k in keys:
            c = rows.column(k).combine_chunks()
            own = c.dictionary_encode(null_encoding="encode")
            own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
            index = own.indices.to_numpy()
            first[1:] |= index[1:] != index[:-1]
        return rows, first, prefixes(table[code], first)

    columns, key_types = events.columns, [events.schema[k] for k in keys]

    def whole(rows: pa.Table) -> pa.Table:
        rows, first, maps = composed(rows)
        last = np.append(np.flatnonzero(first)[1:] - 1, len(first) - 1) if len(first) else np.zeros(0, int)
        ends = rows.take(pa.array(last)).select([*keys, "__range"])
        return ends.append_column("map", pa.array([m.tobytes() for m in maps[last]], pa.binary()))

    schema = T.StructType([*key_types, T.StructField("__range", T.IntegerType()), T.StructField("map", T.BinaryType())])
    summary = ranged.groupBy("__range").applyInArrow(whole, schema)
    several = summary.groupBy(*keys).agg(F.count(F.lit(1)).alias("__k")).filter("__k > 1").drop("__k") if ranges > 1 else None
    out = T.StructType([*events.schema, T.StructField("state_before", T.IntegerType()), T.StructField("state_after", T.IntegerType())])

    def stated(rows: pa.Table, entries: pa.Table) -> pa.Table:
        rows, first, maps = composed(rows)
        state = {tuple(k): s for *k, s in zip(*(entries.column(c).to_pylist() for c in [*keys, "state"]), strict=True)} if entries.num_rows else {}
        heads = np.flatnonzero(first)
        names = zip(*(rows.column(k).take(pa.array(heads)).to_pylist() for k in keys), strict=True)
        entry = np.array([state.get(k, start) for k in names], np.int64)[np.cumsum(first) - 1] if len(first) else np.zeros(0, np.int64)
        after = maps[np.arange(len(maps)), entry].astype(np.int32)
        before = np.where(first, entry, np.roll(after, 1)).astype(np.int32)
        return rows.select(columns).append_column("state_before", pa.array(before)).append_column("state_after", pa.array(after))

    if several is None:
        return ranged.groupBy("__range").applyInArrow(lambda rows: stated(rows, rows.slice(0, 0)), out)
    summary = scratch_table(summary, "functions")
    few = summary.join(several, [F.equal_null(summary[k], several[k]) for k in keys], "left_semi").withColumn("map", F.base64("map"))

    def step(held: dict, row: dict) -> Iterable[tuple]:
        before = held.setdefault("state", start)
        held["state"] = base64.b64decode(row["map"])[before]
        return [(row["__range"], before)]

    entries = ordered_fold(few, keys, [F.col("__range")], "part int, state int", dict, step).withColumnRenamed("part", "__range")
    return ranged.groupBy("__range").cogroup(scratch_table(entries, "entries").groupBy("__range")).applyInArrow(stated, out)
