"""Parsers as a table function that is called laterally: a row for each fragment, or one that says why there is none.

A parser yields (line, anchor_type, anchor_value, chunk_class) of a file's content. Whatever happens to a file is a row: a
type without a parser and a file without fragments are quarantined, an error in a parser fails that file alone, and so
does a part that is too large to be taken apart in memory.
"""

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from chalkline.operators.ingest import MIME_BY_EXTENSION
from chalkline.sources import office

Fragment = tuple[str, str, str, str]
FRAGMENTS = "ordinal int, line string, anchor_type string, anchor_value string, chunk_class string, status string, reason string"
_HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
_ASKS = re.compile(r"\?|exercise|question", re.I)


def markdown(content: bytes) -> Iterator[Fragment]:
    for i, line in enumerate(content.decode("utf-8").splitlines(), 1):
        if found := _HEADING.match(line):
            yield found[2].strip(), "heading", str(i), "content"
        elif line.strip():
            yield line.strip(), "line_range", str(i), "content"


def plain(content: bytes) -> Iterator[Fragment]:
    """Lines keep their spaces; bytes that aren't UTF-8 are replaced."""
    for i, line in enumerate(content.decode("utf-8", "replace").splitlines(), 1):
        if line.strip():
            yield line, "line_range", str(i), "content"


def slides(content: bytes) -> Iterator[Fragment]:
    for slide, _, _, line in office.paragraphs(content, slides=True):
        if line.strip():
            yield line.strip(), "slide", str(slide), "exercise_question" if _ASKS.search(line) else "content"


def words(content: bytes) -> Iterator[Fragment]:
    """Anchors are numbers of paragraphs, blank ones included."""
    for _, i, style, line in office.paragraphs(content, slides=False):
        if line.strip():
            yield line.strip(), "heading" if re.search("heading|title", style.lower()) else "line_range", str(i), "content"


#: The parsers by type.
REGISTRY: dict[str, Callable[[bytes], Iterator[Fragment]]] = {MIME_BY_EXTENSION["md"]: markdown, MIME_BY_EXTENSION["txt"]: plain, MIME_BY_EXTENSION["pptx"]: slides, MIME_BY_EXTENSION["docx"]: words}


def outcomes(mime: str | None, content: bytes | None) -> list[tuple]:
    """The rows of a file (see FRAGMENTS)."""
    none = (None,) * 5
    parser = REGISTRY.get(mime)
    if parser is None:
        return [(*none, "quarantined", f"no parser for MIME type: {mime}")]
    if content is None:
        return [(*none, "failed", "no content")]
    try:
        found = [(i, *fragment, "extracted", None) for i, fragment in enumerate(parser(bytes(content)))]
    except Exception as problem:  # noqa: BLE001  any fault of a parser is that file's outcome
        return [(*none, "failed", f"{type(problem).__name__}: {problem}")]
    return found or [(*none, "quarantined", "nothing extracted")]


class _Parse:
    def eval(self, mime: str, content: bytes):
        yield from outcomes(mime, content)


def parse_files(files: DataFrame, mime: str = "mime", content: str = "content") -> DataFrame:
    """``files`` (without their content) with the rows of the parser of each file's type: FRAGMENTS.

    Cases: null types and contents, empty files, broken archives and wrong encodings are rows with a status and a reason;
    repeated files are parsed each; extra columns stay, those of FRAGMENTS' names must not be among them.
    """
    parse = udtf(_Parse, returnType=FRAGMENTS)
    joined = files.lateralJoin(parse(F.col(mime).outer(), F.col(content).outer()))
    return joined.drop(content)


def file_status(parsed: DataFrame, key: str) -> DataFrame:
    """(key, status, reason, fragments): what became of each file."""
    return parsed.groupBy(key).agg(F.min("status").alias("status"), F.min("reason").alias("reason"), F.count("ordinal").alias("fragments"))


def register(spark: SparkSession) -> None:
    """``parse_file(mime, content)`` for SQL."""
    spark.udtf.register("parse_file", udtf(_Parse, returnType=FRAGMENTS))
