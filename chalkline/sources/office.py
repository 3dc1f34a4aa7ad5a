"""Paragraphs of office documents: the XML parts of PPTX and DOCX archives, a file a row."""

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The namespaces of paragraphs, and where slides and text are.
DRAWING, WORDS = "{http://schemas.openxmlformats.org/drawingml/2006/main}", "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SLIDE, BODY = r"^ppt/slides/slide(\d+)\.xml$", "word/document.xml"
PART_BYTES = 64 << 20


class Refused(ValueError):
    """A part that isn't taken apart."""


def _read(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    """An XML part; one that is larger than PART_BYTES or declares entities is refused."""
    if (size := archive.getinfo(name).file_size) > PART_BYTES:
        raise Refused(f"{name} has {size} bytes, more than {PART_BYTES}")
    data = archive.read(name)
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise Refused(f"{name} declares entities")
    return ElementTree.fromstring(data)


def paragraphs(content: bytes, slides: bool | None = None) -> Iterator[tuple[int, int, str, str]]:
    """(slide, number, style, text) of all paragraphs, numbered from 1 in their part; the slide is 0 in documents.

    ``slides`` says which of both an archive must be, else it may be either.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        numbers = sorted(int(m[1]) for name in archive.namelist() if (m := re.match(SLIDE, name)))
        if slides and not numbers:
            raise Refused("no slides")
        if slides is not False:
            for number in numbers:
                for i, p in enumerate(_read(archive, f"ppt/slides/slide{number}.xml").iter(f"{DRAWING}p"), 1):
                    yield number, i, "", "".join(t.text or "" for t in p.iter(f"{DRAWING}t"))
        if slides is False or slides is None and BODY in archive.namelist():
            for i, p in enumerate(_read(archive, BODY).iter(f"{WORDS}p"), 1):
                style = p.find(f"{WORDS}pPr/{WORDS}pStyle")
                yield 0, i, "" if style is None else style.get(f"{WORDS}val", ""), "".join(t.text or "" for t in p.iter(f"{WORDS}t"))


def office_paragraphs(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, ordinal, line, anchor_type, anchor_value, chunk_class) of PPTX and DOCX files; a broken or refused one yields a row with a null line.

    Slides are anchors, and their paragraphs are exercise questions if they ask; in documents headings and titles are anchors.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch[key], batch[content], strict=True):
                try:
                    rows += [(name, i, p[0], *p[2:]) for i, p in enumerate(x for x in paragraphs(data) if x[3].strip())]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, Refused):
                    rows.append((name, 0, 0, "", None))
            yield pd.DataFrame(rows, columns=[key, "ordinal", "part", "style", "line"])

    found = files.select(key, content).mapInPandas(run, f"{key} string, ordinal int, part int, style string, line string")
    slide, heading = F.col("part") > 0, F.lower("style").rlike("heading|title")
    anchor = F.when(slide, "slide").when(heading, "heading").otherwise("line_range")
    value = F.when(slide, F.col("part").cast("string")).when(heading, F.trim("line")).otherwise((F.col("ordinal") + 1).cast("string"))
    return found.select(key, "ordinal", "line", anchor.alias("anchor_type"), value.alias("anchor_value"), F.when(slide & asks(F.col("line")), "exercise_question").otherwise("content").alias("chunk_class"))


def asks(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(r"\?|exercise|question"), F.lit(False))
