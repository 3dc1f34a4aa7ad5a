"""Incremental ingestion: parsers as rows, chunks, snapshots, versions and reuse."""

import hashlib
import itertools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.functions import text as X

# Types by file extension.
MIME_BY_EXTENSION = {"md": "text/markdown", "txt": "text/plain", "pdf": "application/pdf", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "html": "text/html"}
SPARSE_CHARS, BYTES_PER_PAGE = 80, 10 * 1024


def scan_files(spark, root: str, include: list[str] | None = None) -> DataFrame:
    """(relative_path, checksum, size_bytes, mime) of a folder's visible files; hidden folders and system files go.

    ``include`` names the files to take; absolute paths and steps upwards are refused.
    """
    if any(p.startswith("/") or ".." in p.split("/") for p in include or ()):
        raise ValueError("paths must be relative and stay below the root")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace("path", r"^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    rows = files.select(relative.alias("relative_path"), F.sha2("content", 256).alias("checksum"), F.col("length").alias("size_bytes"), sniff_mime(F.col("path"), F.col("content")).alias("mime"))
    rows = rows.filter("mime <> 'application/octet-stream'").filter(~F.col("relative_path").rlike(r"(^|/)(\.|__MACOSX/|Thumbs\.db$)"))
    if include is not None:
        rows = rows.filter(F.col("relative_path").isin(include))
    return rows


def sniff_mime(path: Column, content: Column) -> Column:
    """By extension, then by magic bytes, then text if it is valid UTF-8."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*(F.lit(x) for kv in MIME_BY_EXTENSION.items() for x in kv))
    return F.coalesce(F.try_element_at(known, extension), F.when(F.substring(content, 1, 4) == F.encode(F.lit("%PDF"), "utf-8"), "application/pdf"), F.when(F.is_valid_utf8(content.cast("string")), "text/plain"), F.lit("application/octet-stream"))


def fragments(docs: DataFrame, text: str = "text", mime: Column | None = None) -> DataFrame:
    """A row for each non-blank line: (ordinal, line, anchor_type, anchor_value); headings of Markdown are anchors.

    Plain text keeps a line's spaces. Other types than text and Markdown yield no rows (see ``dispatch``).
    """
    lines = docs.select("*", F.posexplode(F.split(F.col(text), r"\R")).alias("ordinal", "line")).filter(F.trim("line") != "")
    heading = F.regexp_extract("line", r"^(#{1,6})\s+(.+)$", 2)
    is_heading = (heading != "") if mime is None else (mime == "text/markdown") & (heading != "")
    return lines.withColumn("anchor_type", F.when(is_heading, "heading").otherwise("line_range")).withColumn("anchor_value", F.when(is_heading, F.trim(heading)).otherwise((F.col("ordinal") + 1).cast("string")))


def dispatch(files: DataFrame, mime: str = "mime", text: str = "text") -> DataFrame:
    """``status`` of each file: extracted, quarantined (no parser, or nothing extracted) or failed (no content)."""
    parsed = F.col(mime).isin("text/markdown", "text/plain", "text/html")
    return files.withColumn("status", F.when(F.col(text).isNull(), "failed").when(~parsed | (F.trim(text) == ""), "quarantined").otherwise("extracted"))


def choose_pages(pages: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """The text of each page: reviewed override, else OCR where the page is sparse and OCR found more, else the text.

    OCR is asked for in files larger than 10 KiB a page. Columns: checksum, page_count, page, text, ocr_text, file_size.
    """
    if overrides is not None:
        pages = pages.join(overrides.select("checksum", "page_count", "page", F.col("text").alias("reviewed")), ["checksum", "page_count", "page"], "left")
    else:
        pages = pages.withColumn("reviewed", F.lit(None).cast("string"))
    length = lambda c: F.length(F.trim(F.coalesce(c, F.lit(""))))
    sparse = (length(F.col("text")) < SPARSE_CHARS) & (F.col("file_size") > F.col("page_count") * BYTES_PER_PAGE)
    ocr = sparse & (length(F.col("ocr_text")) > length(F.col("text")))
    chosen = F.coalesce(F.col("reviewed"), F.when(ocr, F.col("ocr_text")), F.col("text"))
    return pages.withColumn("needs_ocr", sparse).withColumn("chosen", chosen).withColumn("confidence", F.when(ocr & F.col("reviewed").isNull(), 0.7).otherwise(0.95))


def chunk_windows(sizes: list[int], target: int, overlap: int, joined: str, starts: list[int]) -> list[tuple[int, int, str, bool]]:
    """(first, end, text, carries) of the chunks of one segment, whose fragments stand in ``joined`` at ``starts``.

    A chunk is a window of the joined text: its own fragments, and before them up to ``overlap`` characters that the
    chunk before ended with. It ends before the fragment that would take its length beyond ``target``.
    """
    found, first, carried = [], 0, 0
    while first < len(sizes):
        begin = starts[first] - (carried + 1 if carried else 0)
        end = first + 1
        while end < len(sizes) and starts[end] + sizes[end] - begin <= target:
            end += 1
        text = joined[begin : starts[end - 1] + sizes[end - 1]].strip()
        found.append((first, end, text, carried > 0))
        first, carried = end, min(overlap, len(text))
    return found


def page_fragments(pages: DataFrame) -> DataFrame:
    """The non-blank lines of chosen page texts (``choose_pages``), anchored to their pages, with the page's confidence."""
    lines = pages.select("page", "confidence", F.posexplode(F.split("chosen", r"\R")).alias("ordinal", "line")).filter(F.trim("line") != "")
    return lines.select("page", "ordinal", "line", F.lit("page").alias("anchor_type"), F.col("page").cast("string").alias("anchor_value"), "confidence")


def coalesce_chunks(docs: DataFrame, pieces: str = "pieces", target: int = 1000, overlap: int = 200) -> DataFrame:
    """Chunks of ``target`` characters of (doc_id, pieces), where pieces is an array of (line, anchor_type, anchor_value, chunk_class).

    Type, class, and (on pages and slides) place are boundaries. Everything happens on the row, so nothing is shuffled; a
    fragment is never split. A chunk's place is its first and last distinct anchor, of which the chunk before it that
    it carries text from counts as one.
    """
    names = ["chunk", "text", "anchor_type", "anchor_value", "chunk_class"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kept = [(p["line"].strip(), p["anchor_type"], p["anchor_value"], p["chunk_class"]) for p in own or () if p["line"].strip()]
                segments = itertools.groupby(kept, key=lambda p: (p[1], p[3], p[2] if p[1] in ("page", "slide") else None))
                chunk = 0
                for (kind, named, _), members in segments:
                    lines, _, anchors, _ = zip(*members, strict=True)
                    sizes = list(map(len, lines))
                    starts = list(itertools.accumulate((n + 1 for n in sizes[:-1]), initial=0))
                    place = ""
                    for first, end, text, carries in chunk_windows(sizes, target, overlap, " ".join(lines), starts):
                        seen = list(dict.fromkeys([*([place] if carries else []), *anchors[first:end]]))
                        place = seen[0] if len(seen) == 1 else f"{seen[0]}-{seen[-1]}"[:120]
                        rows.append((doc_id, chunk, text, kind, place, named))
                        chunk += 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.string()) for c in columns[2:])], names=["doc_id", *names])

    read = docs.select("doc_id", F.col(pieces))
    schema = T.StructType([read.schema["doc_id"], T.StructField("chunk", T.LongType()), *(T.StructField(c, T.StringType()) for c in names[1:])])
    return read.mapInArrow(run, schema).withColumn("token_count", X.approximate_tokens(F.col("text")))


def line_pieces(text: Column, chunk_class: Callable[[Column], Column]) -> Column:
    """The non-blank lines of a text as pieces for ``coalesce_chunks``; headings of Markdown are anchors of their own."""
    lines = F.transform(F.split(text, r"\R"), lambda line, i: F.struct(line.alias("line"), (i + 1).cast("string").alias("n"), F.regexp_extract(line, r"^(#{1,6})\s+(.+)$", 2).alias("h")))
    kept = F.filter(lines, lambda x: F.trim(x["line"]) != "")
    return F.transform(kept, lambda x: F.struct(x["line"].alias("line"), F.when(x["h"] != "", "heading").otherwise("line_range").alias("anchor_type"), F.when(x["h"] != "", F.trim(x["h"])).otherwise(x["n"]).alias("anchor_value"), chunk_class(x["line"]).alias("chunk_class")))


def snapshot_hash(entries: DataFrame, keys: list[str], path: str = "path", checksum: str = "checksum") -> DataFrame:
    """A digest of each group's sorted (path, checksum) entries, so every change shows; order doesn't.

    Two levels: entries are hashed, sorted by path, in 4,096 buckets of their path's digest, and the buckets' digests in
    order. A group with a third of all files is thus spread over the buckets.
    """
    bucket = F.substring(F.sha2(F.col(path), 256), 1, 3).alias("bucket")
    entry = F.collect_list(F.struct(F.col(path).alias("p"), F.col(checksum).alias("c")))
    body = F.array_join(F.transform(F.array_sort(entry), lambda e: F.concat(e["p"], F.lit("\0"), e["c"], F.lit("\n"))), "")
    parts = entries.groupBy(*keys, bucket).agg(F.sha2(body, 256).alias("digest"), F.count(F.lit(1)).alias("n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda e: e["digest"]), "")
    return parts.groupBy(*keys).agg(F.sha2(whole, 256).alias("snapshot"), F.sum("n").alias("n_files"))


def snapshot_diff(old: DataFrame, new: DataFrame, on: str = "path", checksum: str = "checksum") -> DataFrame:
    """(path, change): added, deleted, edited, unchanged, or renamed (the checksum is at another path before)."""
    a, b = old.select(on, F.col(checksum).alias("c0")), new.select(on, F.col(checksum).alias("c1"))
    both = a.join(b, on, "full_outer")
    gone = both.filter("c1 IS NULL").select(F.col("c0").alias("c1")).distinct().withColumn("moved", F.lit(True))
    change = F.when(F.col("c1").isNull(), "deleted").when(F.col("c0").isNull() & F.col("moved"), "renamed").when(F.col("c0").isNull(), "added").when(F.col("c0") == F.col("c1"), "unchanged").otherwise("edited")
    return both.join(gone, "c1", "left").select(on, change.alias("change"))


def reuse_latest(files: DataFrame, earlier: DataFrame, keys: list[str], order: list[Column], payload: str) -> DataFrame:
    """``files`` with ``payload`` of the latest earlier row of the same keys; null where there is none."""
    latest = earlier.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1")
    return files.join(latest.select(*keys, payload), keys, "left")


def next_sequence(versions: DataFrame, runs: DataFrame, key: str, sequence: str = "sequence") -> DataFrame:
    """The next version number of every run, 1 where it has none."""
    last = versions.groupBy(key).agg(F.max(sequence).alias("last"))
    return runs.select(key).distinct().join(last, key, "left").select(key, (F.coalesce("last", F.lit(0)) + 1).cast("long").alias("next_sequence"))


def mode_offset(pairs: DataFrame, key: str, offset: str = "offset", position: str = "position", support: int = 2) -> DataFrame:
    """The most frequent offset of each key with enough support; the first seen wins ties."""
    counts = pairs.groupBy(key, offset).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    best = counts.groupBy(key).agg(F.max_by(offset, F.struct("n", F.negative("first"))).alias("offset"), F.max("n").alias("support"))
    return best.filter(F.col("support") >= support)


def artifact_key(checksum: Column) -> Column:
    return F.concat(F.lit("artifacts/sha256/"), F.substring(checksum, 1, 2), F.lit("/"), checksum)


def outline_id(version: Column, title: Column) -> Column:
    return F.concat(F.lit("ol_"), F.substring(F.sha2(F.concat(version, F.lit("|"), title), 256), 1, 24))


def with_batches(rows: DataFrame, provider, schema: T.StructType | str) -> DataFrame:
    """Rows through an injected provider, which maps a pandas batch to a pandas batch of ``schema``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = provider(batch)
            if len(out) != len(batch):
                raise ValueError(f"the provider returned {len(out)} rows for {len(batch)}")
            yield out

    return rows.mapInPandas(run, schema)


def sha256_text(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()
