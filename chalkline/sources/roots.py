"""Checks of a source root, and reports written once."""

import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.sources.artifacts import write_new


def checked_root(path: str, below: str | None = None) -> str:
    """The real path of a readable folder; relative paths, files and links that lead out of ``below`` are refused."""
    given = Path(path)
    if not given.is_absolute():
        raise ValueError("a source root must be an absolute path")
    real = given.resolve()
    if below is not None and not real.is_relative_to(Path(below).resolve()):
        raise ValueError("a source root must stay below its parent")
    if not real.is_dir():
        raise ValueError("a source root must be a folder")
    if not os.access(real, os.R_OK | os.X_OK):
        raise PermissionError("a source root must be readable")
    return str(real)


def write_report(rows: DataFrame, path: str) -> None:
    """JSON lines in one file that its owner alone may read, at a path that doesn't exist yet; else an error.

    For reports, which are small: rows come to the driver a partition at a time.
    """
    lines = rows.select(F.to_json(F.struct("*")).alias("line"))
    write_new(path, (r["line"] + "\n" for r in lines.toLocalIterator()))
