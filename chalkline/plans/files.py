"""File queries: ``pages`` written as a folder tree and scanned, ``documents`` as files of several types and as artifacts."""

import io
import os
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from chalkline.deploy import ship
from chalkline.operators.ingest import MIME_BY_EXTENSION
from chalkline.sources import artifacts, folders, parsers
from chalkline.sources.office import WORDS
from chalkline.sources.scratch import shared_folder
from chalkline.sources.tables import table


def _written(rows, root):
    """Each row's content as a file below the root; the rows are (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
                with open(f"{root}/{path}", "wb") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0]


def folder_scan(spark, d):
    """Checksums and types of a tree with hidden and system folders in it."""
    ship(spark)
    k, root = F.col("page_id"), shared_folder(spark, "tree")
    top = F.when(k % 17 == 0, ".git").when(k % 19 == 0, "__MACOSX").otherwise(F.concat(F.lit("unit "), k % 5))
    name = F.when(k % 23 == 0, F.concat(F.lit("."), k)).otherwise(F.concat(k, F.when(k % 3 == 0, "").otherwise(".html")))
    pages = table(spark, d, "pages").filter("page_id IS NOT NULL")
    _written(pages.select(F.concat_ws("/", top, F.concat(F.lit("week"), k % 11), name).alias("path"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("content")), root)
    return folders.sources(folders.scan_folder(spark, root, part_files=16))


def _as_docx(text: str) -> bytes:
    ns = WORDS.strip("{}")
    body = "".join(f'<w:p>{"<w:pPr><w:pStyle w:val=&quot;Heading1&quot;/></w:pPr>".replace("&quot;", chr(34)) if not i else ""}<w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for i, line in enumerate(text.split("\n")))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


#: Characters that XML can't hold.
_NOT_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\r]"


def _files(spark, d):
    """Documents as files: Markdown, text, word processing, a broken archive, an unknown type, an empty file."""
    kind, text = F.col("doc_id") % 6, F.coalesce("text", F.lit(""))
    types = [MIME_BY_EXTENSION[e] for e in ("md", "txt", "docx", "docx")] + ["application/x-unknown", MIME_BY_EXTENSION["md"]]
    docs = table(spark, d, "documents").filter("doc_id IS NOT NULL").select("doc_id", kind.alias("kind"), F.element_at(F.array(*map(F.lit, types)), (kind + 1).cast("int")).alias("mime"), F.when(kind == 5, "").when(kind == 2, F.regexp_replace(text, _NOT_XML, "")).otherwise(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_as_docx(t) if k == 2 else t.encode() for k, t in zip(batch.column("kind").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mime"), pa.array(made, pa.binary())], names=["doc_id", "mime", "content"])

    return docs.mapInArrow(run, "doc_id long, mime string, content binary")


def parsed_files(spark, d):
    """The fragments of all files, and the reasons where there are none."""
    ship(spark)
    found = parsers.parse_files(_files(spark, d))
    return found.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.md5("line").alias("line_md5"), "anchor_type", "anchor_value", "status", "reason")


def artifact_put(spark, d):
    """All contents put twice, and what is there then."""
    ship(spark)
    root = shared_folder(spark, "store")
    rows = table(spark, d, "documents").select(F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    for _ in range(2):
        artifacts.put_artifacts(rows, root, "manifest.jsonl")
    listed = spark.read.schema("key string, size long").json(f"file://{root}/manifest.jsonl")
    there = folders.scan_folder(spark, root).filter(F.col("relative_path").startswith(artifacts.PREFIX))
    return listed.join(there.select(F.col("relative_path").alias("key"), "size_bytes", "checksum"), "key", "full").select("key", "size", "size_bytes", "checksum")


_LINES = r"regexp_split_to_array(t, '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]')"
_SPACES = "' ' || " + " || ".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 160, 12288))
QUERIES = {f.__name__: f for f in (folder_scan, parsed_files, artifact_put)}

SQL = {
    "folder_scan": """SELECT 'unit ' || (page_id % 5) || '/week' || (page_id % 11) || '/' || page_id || CASE WHEN page_id % 3 = 0 THEN '' ELSE '.html' END AS relative_path, octet_length(encode(coalesce(html, '')))::BIGINT AS size_bytes, sha256(coalesce(html, '')) AS checksum,
CASE WHEN page_id % 3 = 0 THEN CASE WHEN left(html, 4) = '%PDF' THEN 'application/pdf' ELSE 'text/plain' END ELSE 'text/html' END AS mime FROM pages WHERE page_id % 17 <> 0 AND page_id % 19 <> 0 AND page_id % 23 <> 0""",
    "parsed_files": f"""WITH f AS (SELECT doc_id, doc_id % 6 AS k, CASE doc_id % 6 WHEN 5 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\r]', '', 'g') ELSE coalesce(text, '') END AS t FROM documents),
l AS (SELECT doc_id, k, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT *, CASE WHEN k = 2 THEN string_split(t, chr(10)) ELSE {_LINES} END AS ls FROM f WHERE k <= 2)),
r AS (SELECT *, regexp_extract(line, '^(#{{1,6}})\\s+(.+)$', 2) AS h FROM l WHERE trim(line, {_SPACES}) <> ''),
x AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ordinal, md5(CASE WHEN k = 1 THEN line WHEN k = 0 AND h <> '' THEN trim(h, {_SPACES}) ELSE trim(line, {_SPACES}) END) AS line_md5, CASE WHEN k = 0 AND h <> '' OR k = 2 AND i = 1 THEN 'heading' ELSE 'line_range' END AS anchor_type, i::VARCHAR AS anchor_value FROM r)
SELECT *, 'extracted' AS status, NULL AS reason FROM x UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, CASE WHEN k = 3 THEN 'failed' ELSE 'quarantined' END, CASE k WHEN 3 THEN 'BadZipFile: File is not a zip file' WHEN 4 THEN 'no parser for MIME type: application/x-unknown' ELSE 'nothing extracted' END FROM f WHERE doc_id NOT IN (SELECT doc_id FROM x)""",
    "artifact_put": "SELECT DISTINCT 'artifacts/sha256/' || left(c, 2) || '/' || c AS key, n AS size, n AS size_bytes, c AS checksum FROM (SELECT sha256(coalesce(text, '')) AS c, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents)",
}
