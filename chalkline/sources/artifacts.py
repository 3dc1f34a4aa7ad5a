"""Content-addressed files and reports, written by tasks and put in place by a commit.

A task writes below a folder of its own attempt. What it reports to the driver is that folder; the commit moves each
committed attempt's files to their final names and drops the rest, an abort drops all. A file's name is its SHA-256, so
a second run finds its files there and changes nothing. The manifest (JSON lines of keys and sizes, by key) is created
exclusively; the same one is left as it is, another one is an error before anything is moved.
"""

import hashlib
import heapq
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# Fixed value: where artifacts are.
PREFIX = "artifacts/sha256/"


def artifact_key(checksum: str) -> str:
    if len(checksum) != 64 or set(checksum.lower()) - set("0123456789abcdef"):
        raise ValueError("a checksum has 64 hexadecimal digits")
    return f"{PREFIX}{checksum[:2].lower()}/{checksum.lower()}"


def write_new(path: str, lines: Iterator[str]) -> None:
    """A file that only its owner reads, whole or not at all; an existing one is an error."""
    part = f"{path}.{uuid.uuid4().hex}"
    try:
        with open(os.open(part, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600), "w", encoding="utf-8") as out:
            out.writelines(lines)
        os.link(part, path)  # fails where the path is taken
    finally:
        if os.path.exists(part):
            os.unlink(part)


@dataclass
class _Attempt(WriterCommitMessage):
    folder: str


class _Writer(DataSourceWriter):
    def __init__(self, root: str, manifest: str | None):
        self.root, self.manifest = root, manifest
        self.run = os.path.join(root, f".run-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        context = TaskContext.get()
        folder = os.path.join(self.run, f"{context.partitionId()}-{context.taskAttemptId()}")
        os.makedirs(folder)
        sizes: dict[str, int] = {}
        try:
            for row in iterator:
                content = bytes(row["content"] or b"")
                checksum = hashlib.sha256(content).hexdigest()
                if checksum not in sizes:
                    sizes[checksum] = len(content)
                    if not os.path.exists(os.path.join(self.root, artifact_key(checksum))):
                        with open(os.path.join(folder, checksum), "xb") as out:
                            out.write(content)
            with open(os.path.join(folder, "manifest"), "x", encoding="utf-8") as out:
                out.writelines(f"{artifact_key(c)}\t{n}\n" for c, n in sorted(sizes.items()))
        except BaseException:
            shutil.rmtree(folder, ignore_errors=True)
            raise
        return _Attempt(folder)

    def _lines(self, folders: list[str]) -> Iterator[str]:
        """The manifest's lines: those of the attempts, merged, each key once."""
        files = [open(os.path.join(f, "manifest"), encoding="utf-8") for f in folders]  # noqa: SIM115
        try:
            last = None
            for line in heapq.merge(*files):
                if line != last:
                    key, size = line.rstrip("\n").split("\t")
                    yield json.dumps({"key": key, "size": int(size)}) + "\n"
                last = line
        finally:
            for f in files:
                f.close()

    def _same(self, path: str, lines: Iterator[str]) -> bool:
        with open(path, encoding="utf-8") as found:
            for line in lines:
                if found.readline() != line:
                    return False
            return not found.readline()

    def commit(self, messages: list) -> None:
        folders = [m.folder for m in messages if m is not None]
        try:
            path = self.manifest and os.path.join(self.root, self.manifest)
            if path and os.path.exists(path) and not self._same(path, self._lines(folders)):
                raise FileExistsError(f"another manifest exists: {self.manifest}")
            for folder in folders:
                for name in os.listdir(folder):
                    if name != "manifest":
                        target = os.path.join(self.root, artifact_key(name))
                        os.makedirs(os.path.dirname(target), exist_ok=True)
                        os.replace(os.path.join(folder, name), target)
            if path and not os.path.exists(path):
                write_new(path, self._lines(folders))
        finally:
            shutil.rmtree(self.run, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.run, ignore_errors=True)


class ArtifactSink(DataSource):
    """``df.select("content").write.format("artifacts").option("manifest", name).mode("append").save(root)``."""

    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        return "content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("artifacts are only added")
        return _Writer(self.options["path"].removeprefix("file://"), self.options.get("manifest"))


def put_artifacts(rows: DataFrame, root: str, manifest: str | None = None) -> None:
    """Put the ``content`` of all rows below ``root`` (a folder that driver and executors share), each content once.

    Null is an empty content. Tasks that fail leave nothing; repeating the call changes nothing; with ``manifest`` the
    keys and sizes of all contents are listed there.
    """
    rows.sparkSession.dataSource.register(ArtifactSink)
    rows.select("content").write.format("artifacts").options(**({"manifest": manifest} if manifest else {})).mode("append").save(root)
