"""Folds over a key's rows in order, for rules that windows can't say (what a row does depends on what earlier ones did)."""

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered_fold(rows: DataFrame, keys: list[str], order: list[Column], schema: str, start: Callable[[], object], step: Callable[[object, dict], Iterable[tuple]], finish: Callable[[object], Iterable[tuple]] = lambda state: ()) -> DataFrame:
    """``keys`` and the columns of ``schema``: what ``step`` gives for each row of a key in order, and ``finish`` at its end.

    Rows are dealt by key, sorted within partitions and streamed, so a task holds one batch and the state of one key,
    however many rows that has. ``step`` changes the state in place.
    """
    read = rows.select(*rows.columns).repartition(*(F.col(k) for k in keys)).sortWithinPartitions(*keys, *order)
    out = T.StructType([*(rows.schema[k] for k in keys), *T._parse_datatype_string(schema)])
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            found: list[tuple] = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if state is None or key != held:
                    if state is not None:
                        found += [held + x for x in finish(state)]
                    held, state = key, start()
                found += [key + x for x in step(state, row)]
            yield _batch(found, arrow)
        if state is not None:
            yield _batch([held + x for x in finish(state)], arrow)

    return read.mapInArrow(run, out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    names = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    return names[kind.simpleString()]
