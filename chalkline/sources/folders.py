"""A folder tree as a table: a Python data source whose partitions are folders, with checksums and types of all files.

For source roots that every executor mounts. Hidden folders and files, those of SKIPPED and links are pruned while the tree
is walked, by name alone; sizes, checksums (in blocks of BLOCK bytes) and types are found in the tasks. Conditions on
``relative_path`` (equal, in a list, starting with) prune folders and files before anything is read.
"""

import codecs
import hashlib
import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from chalkline.operators.ingest import MIME_BY_EXTENSION

# What is never a source.
SKIPPED = ("__MACOSX", ".DS_Store", "Thumbs.db")
BLOCK = 64 << 10
#: Names of a folder that one partition takes.
PART_FILES = 1000
SCHEMA = "relative_path string, size_bytes long, checksum string, mime string, error string"


def checked_names(names: list[str]) -> list[str]:
    """The names of an include list; absolute ones and steps upwards are refused."""
    for name in names:
        if os.path.isabs(name) or ".." in name.replace("\\", "/").split("/"):
            raise ValueError(f"paths must be relative and stay below the root: {name!r}")
    return names


def digest_and_type(path: str) -> tuple[int, str, str]:
    """Size, SHA-256 and type of a file, read once in blocks: by extension, by its first bytes, or text if all is UTF-8."""
    known = MIME_BY_EXTENSION.get(os.path.splitext(path)[1][1:].lower())
    sha, size, head, decoder = hashlib.sha256(), 0, b"", codecs.getincrementaldecoder("utf-8")()
    with open(path, "rb") as file:
        while block := file.read(BLOCK):
            sha.update(block)
            head = head or block[:4]
            size += len(block)
            if known is None and decoder is not None:
                try:
                    decoder.decode(block)
                except UnicodeDecodeError:
                    decoder = None
    if known is None and head == b"%PDF":
        known = "application/pdf"
    if known is None and decoder is not None:
        try:
            decoder.decode(b"", final=True)
            known = "text/plain"
        except UnicodeDecodeError:
            pass
    return size, sha.hexdigest(), known or "application/octet-stream"


@dataclass
class _Names(InputPartition):
    folder: str
    names: tuple[str, ...]


class _Reader(DataSourceReader):
    def __init__(self, root: str, part_files: int):
        self.root, self.part_files = root, part_files
        self.wanted: list[set[str]] = []
        self.prefixes: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            match f:
                case EqualTo(("relative_path",), value):
                    self.wanted.append({value})
                case In(("relative_path",), values):
                    self.wanted.append(set(values))
                case StringStartsWith(("relative_path",), value):
                    self.prefixes.append(value)
                case _:
                    yield f

    def _takes(self, path: str) -> bool:
        return all(path in w for w in self.wanted) and all(path.startswith(p) for p in self.prefixes)

    def _enters(self, folder: str) -> bool:
        """May a file below ``folder`` (with a slash at its end) be taken?"""
        return all(any(w.startswith(folder) for w in names) for names in self.wanted) and all(p.startswith(folder) or folder.startswith(p) for p in self.prefixes)

    def partitions(self) -> list[InputPartition]:
        found, todo = [], [""]
        while todo:
            folder, names = todo.pop(), []
            with os.scandir(os.path.join(self.root, folder)) as entries:
                for e in entries:
                    if e.name.startswith(".") or e.name in SKIPPED or e.is_symlink():
                        continue
                    if e.is_dir(follow_symlinks=False):
                        if self._enters(f"{folder}{e.name}/"):
                            todo.append(f"{folder}{e.name}/")
                    elif e.is_file(follow_symlinks=False) and self._takes(folder + e.name):
                        names.append(e.name)
            names.sort()
            found += [_Names(folder, tuple(names[i : i + self.part_files])) for i in range(0, len(names), self.part_files)]
        return found or [_Names("", ())]

    def read(self, partition: _Names) -> Iterator[tuple]:
        for name in partition.names:
            path = os.path.join(self.root, partition.folder, name)
            try:
                if not stat.S_ISREG(os.lstat(path).st_mode):  # a link by now
                    continue
                size, checksum, mime = digest_and_type(path)
                yield partition.folder + name, size, checksum, mime, None
            except OSError as problem:
                yield partition.folder + name, None, None, None, f"{type(problem).__name__}: {problem.strerror}"


class FolderSource(DataSource):
    """``spark.read.format("folder").load(root)``; option ``partFiles``: names of a folder in a partition."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        root = self.options.get("path")
        if not root:
            raise ValueError("a folder is needed")
        return _Reader(root.removeprefix("file://").rstrip("/") or "/", int(self.options.get("partfiles", PART_FILES)))


def scan_folder(spark: SparkSession, root: str, include: list[str] | None = None, part_files: int = PART_FILES) -> DataFrame:
    """(relative_path, size_bytes, checksum, mime, error) of a folder's files; ``error`` says why one couldn't be read.

    ``include`` names the files to take. Cases: an empty folder has no rows; a missing one is an error; names with any
    characters are kept as they are; a file that goes while the tree is read is a row with its error.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderSource)
    rows = spark.read.format("folder").option("partFiles", part_files).load(root)
    return rows if include is None else rows.filter(rows["relative_path"].isin(checked_names(include)))


def sources(rows: DataFrame) -> DataFrame:
    """The readable files of ``scan_folder`` whose type a parser may know."""
    return rows.filter("error IS NULL AND mime <> 'application/octet-stream'").drop("error")
