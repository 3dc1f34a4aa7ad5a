"""Row comparison of Spark results with DuckDB's."""

import math
import numbers

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def norm(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float | np.floating) and math.isnan(v)):
            return "NULL"
        return f"{float(v):.6f}" if isinstance(v, numbers.Number) and not isinstance(v, bool | np.bool_) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(norm(v) for v in r) for r in frame.itertuples(index=False, name=None))


def assert_same(found: pd.DataFrame, expected: pd.DataFrame) -> None:
    assert sorted(found.columns) == sorted(expected.columns)
    a, b = rows(found), rows(expected)
    assert len(a) == len(b), (len(a), len(b))
    different = [x for x in zip(a, b, strict=True) if x[0] != x[1]]
    assert not different, different[:3]
