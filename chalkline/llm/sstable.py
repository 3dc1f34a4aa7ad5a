"""Token-id output as sorted-string-table shards.

A shard file holds documents in ascending order of their identifier:

    block*            documents in runs of about ``BLOCK_IDS`` ids, compressed with zstandard
    index             for each block: its first key, offset, compressed length, documents, ids before it
    Bloom filter      over the shard's keys
    footer            fixed length: places of index and filter, counts, magic

A key is nine bytes (null flag, then the identifier, sign flipped, big-endian), so byte order is id order and null
comes first. Within a block keys are prefix-compressed: shared length, rest; a value is the document's number of
ids and the ids as little-endian unsigned 32-bit integers. ``lookup`` reads footer, index and filter, then one block.

The Spark job encodes where the texts are read and moves only compressed ids: documents go by identifier range to
shards (bounds from the identifiers alone), each task sorts its shard's rows with Spark's external sort and streams
them into a file under a name of its attempt, which is then renamed; a repeated task writes the same bytes again.

Cases: a null or empty text has the end id alone; a very long text is encoded whole and is one entry of one block;
documents of one identifier (ties) follow one another in any order, each with ids of its own, and so do those without
an identifier, which come first; one identifier is never split over shards, so it costs one shard; an empty table gives
no shard and an empty result; only doc_id and text are read, so extra columns never clash.
"""

import bisect
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm.frames import pick
from chalkline.sources.scratch import scratch_path, scratch_table

MAGIC = b"CHLKSST1"
BLOCK_IDS = 1 << 16
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7
END_ID = 0
#: Documents of a shard: about this many bytes of text.
SHARD_BYTES = 64 << 20
_FOOTER = struct.Struct("<QQQQQQ8s")
_INDEX = struct.Struct("<9sQQQQ")


# --- encoding ------------------------------------------------------------------------------------------------


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: printable Latin-1 stays, others move up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(moved)}


def tokenizer_file(name: str) -> str:
    """A path as it is, or the file of an installed public tokenizer of that name on the machine that asks."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)



class PieceEncoder:
    """Encodes whole texts with a byte-level BPE tokenizer, words at a time, with a bounded cache.

    A single space or line feed between two characters that aren't white space always begins a new piece of this
    tokenizer's pre-tokenization (a line feed is a piece, a space belongs to the next one), so the ids of a text are
    those of its words in a row. A word of Latin letters is one piece and goes to the tokenizer's BPE model at once; a
    mark after such a word is a piece of its own. Texts with other white space, or with a special token's string, are
    given to the tokenizer as one.
    """

    def __init__(self, path: str, cache_entries: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        tokenize, encode, letters = self.tokenizer.model.tokenize, self.whole, _byte_letters()
        marks = {m: encode(m) for m in ".,;:!?"}

        class Words(dict):
            """Ids of words after ``lead``; None for what isn't a word."""

            def __init__(self, lead: str, limit: int):
                super().__init__()
                self.lead, self.letter, self.limit = lead, "".join(letters[ord(c)] for c in lead), limit

            def __missing__(self, word: str) -> bytes | None:
                keep = True
                if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
                    piece = word if word.isascii() else word.encode().decode("latin-1").translate(letters)
                    ids = array("I", [t.id for t in tokenize(self.letter + piece)]).tobytes()
                elif (mark := word[-1:]) in marks and (core := word[:-1]).isalpha() and (core.isascii() or max(core) < "\u0250"):
                    keep = core in self  # a rare word with a mark is rarer still
                    ids = self[core] + marks[mark]
                elif word and not word[0].isspace() and not mark.isspace():
                    ids = encode(self.lead + word)
                else:
                    ids = None
                if keep:
                    if len(self) >= self.limit:
                        self.clear()
                    self[word] = ids
                return ids

        self.first, self.words = Words("", cache_entries // 4), Words(" ", cache_entries)
        self.line_feed = encode("\n")

    def whole(self, text: str) -> bytes:
        """The ids of a text that is given to the tokenizer as one."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers, without the end id."""
        if any(s in text for s in self.special):
            return self.whole(text)
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            parts = [self.first[first], *map(self.words.__getitem__, rest)]
            if None in parts:
                return self.whole(text)
            lines.append(b"".join(parts))
        return self.line_feed.join(lines)


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each tokenizer file in a Python worker."""
    return PieceEncoder(tokenizer_file(path))


# --- file format ---------------------------------------------------------------------------------------------


def encode_key(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def decode_key(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


def write_shard(out, rows: Iterable[tuple[int | None, bytes]]) -> tuple[int, int]:
    """Write rows (identifier, ids) that come in key order; returns documents and ids written."""
    compress = zstandard.ZstdCompressor(level=1).compress
    offset = n_docs = n_ids = 0
    index, keys = [], []
    block, block_ids, first, previous, block_docs, before = [], 0, b"", b"", 0, 0

    def flush():
        nonlocal offset, block, block_ids, previous, block_docs, before
        if block_docs:
            data = compress(b"".join(block))
            out.write(data)
            index.append(_INDEX.pack(first, offset, len(data), block_docs, before))
            offset, before = offset + len(data), before + block_ids
        block, block_ids, previous, block_docs = [], 0, b"", 0

    for doc_id, ids in rows:
        key = encode_key(doc_id)
        if not block_docs:
            first = key
        shared = 0
        while shared < len(previous) and previous[shared] == key[shared]:
            shared += 1
        block += [bytes((shared,)), key[shared:], struct.pack("<Q", len(ids) // 4), ids]
        previous = key
        keys.append(key)
        block_docs, block_ids, n_docs, n_ids = block_docs + 1, block_ids + len(ids) // 4, n_docs + 1, n_ids + len(ids) // 4
        if block_ids >= BLOCK_IDS:
            flush()
    flush()
    bits = max(64, -(-BLOOM_BITS_PER_KEY * n_docs // 8) * 8)
    bloom = bytearray(bits // 8)
    for key in keys:
        for place in _bloom_places(key, bits):
            bloom[place >> 3] |= 1 << (place & 7)
    body = b"".join(index)
    out.write(body)
    out.write(bytes(bloom))
    out.write(_FOOTER.pack(offset, len(body), offset + len(body), len(bloom), n_docs, n_ids, MAGIC))
    return n_docs, n_ids


class ShardReader:
    """Reads one shard from a seekable file."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - _FOOTER.size)
        index_at, index_len, bloom_at, bloom_len, self.n_docs, self.n_ids, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        file.seek(index_at)
        raw = file.read(index_len)
        self.index = [_INDEX.unpack_from(raw, i) for i in range(0, index_len, _INDEX.size)]
        self._bloom_at, self._bloom_len, self._bloom = bloom_at, bloom_len, None

    def block(self, entry) -> Iterator[tuple[bytes, memoryview]]:
        _, offset, length, docs, _ = entry
        self.file.seek(offset)
        data = memoryview(zstandard.ZstdDecompressor().decompress(self.file.read(length)))
        at, key = 0, b""
        for _ in range(docs):
            shared = data[at]
            key = key[:shared] + bytes(data[at + 1 : at + 10 - shared])
            at += 10 - shared
            (n,) = struct.unpack_from("<Q", data, at)
            yield key, data[at + 8 : at + 8 + 4 * n]
            at += 8 + 4 * n

    def scan(self) -> Iterator[tuple[int | None, int, memoryview]]:
        """(identifier, ids of the shard before it, ids) of all documents in order."""
        for entry in self.index:
            start = entry[4]
            for key, ids in self.block(entry):
                yield decode_key(key), start, ids
                start += len(ids) // 4

    def might_hold(self, key: bytes) -> bool:
        if self._bloom is None:
            self.file.seek(self._bloom_at)
            self._bloom = self.file.read(self._bloom_len)
        return all(self._bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, 8 * self._bloom_len))

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all rows with this identifier (repeated identifiers may lie in several blocks)."""
        key = encode_key(doc_id)
        if not self.might_hold(key):
            return []
        firsts = [e[0] for e in self.index]
        found = []
        for i in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)):
            found += [np.frombuffer(bytes(v), "<u4") for k, v in self.block(self.index[i]) if k == key]
        return found


def open_shard(path: str) -> ShardReader:
    fs, name = pafs.FileSystem.from_uri(path)
    return ShardReader(fs.open_input_file(name), fs.get_file_info(name).size)


# --- Spark job -----------------------------------------------------------------------------------------------


def _shard_bounds(docs: DataFrame, shards: int) -> list[int]:
    """Upper bounds (inclusive) of all shards but the last, from the identifiers alone."""
    if shards < 2:
        return []
    cuts = docs.agg(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], 10_000)).first()[0] or []
    return sorted(set(cuts))


def encode_documents(docs: DataFrame, tokenizer_path: str, bounds: list[int]) -> DataFrame:
    """(shard, doc_id, ids): ids with the end id, compressed; a null text has the end id alone."""
    upper = np.array(bounds, np.int64)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, compress = encoder(tokenizer_path), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [compress((encode(t) if t else b"") + end) for t in part.column("text").to_pylist()]
                key = part.column("doc_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
                shard = np.searchsorted(upper, key, side="left").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), part.column("doc_id"), pa.array(ids, pa.binary())], names=["shard", "doc_id", "ids"])

    return pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "shard int, doc_id long, ids binary")


def write_tables(docs: DataFrame, path: str, tokenizer_path: str, shards: int) -> DataFrame:
    """Write ``docs`` as shard files below ``path``; the manifest (shard, file, n_docs, n_ids) as a written table."""
    keys = pick(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    bounds = _shard_bounds(keys, shards)
    n = len(bounds) + 1
    encoded = encode_documents(docs, tokenizer_path, bounds)
    dealt = encoded.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor().decompress
        shard: list[int] = []

        def rows():
            for batch in batches:
                if batch.num_rows and not shard:
                    shard.append(batch.column("shard")[0].as_py())
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                    yield doc_id, decompress(ids.as_buffer())

        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        temporary = f"{root}/.attempt-{TaskContext.get().taskAttemptId()}"
        with fs.open_output_stream(temporary) as out:
            n_docs, n_ids = write_shard(out, rows())
        if not n_docs:
            fs.delete_file(temporary)
            return
        name = f"shard-{shard[0]:06d}.sst"
        fs.move(temporary, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array([f"{path}/{name}"]), pa.array([n_docs]), pa.array([n_ids])], names=["shard", "file", "n_docs", "n_ids"])

    return scratch_table(dealt.mapInArrow(write, "shard int, file string, n_docs long, n_ids long"), "manifest")


def read_tables(manifest: DataFrame, shards: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the shard files, block by block.

    ``start`` counts the ids of all documents before it: those of earlier shards (a running sum over the manifest, a
    row for each shard) and those before it in its own.
    """
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = manifest.select("file", before.alias("before"), "shard").repartitionById(max(1, shards), F.col("shard"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc_id, start, ids in open_shard(file).scan():
                    rows.append((doc_id, before + start, len(ids) // 4, zlib.crc32(ids)))
                    if len(rows) == 10_000:
                        yield _columns(rows)
                        rows = []
                if rows:
                    yield _columns(rows)

    return starts.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_tables(docs: DataFrame, tokenizer_path: str, path: str | None = None, shards: int | None = None) -> DataFrame:
    """Encode ``docs``, write them as shards and read the shards back.

    ``shards`` defaults to one for each SHARD_BYTES of the optimizer's size estimate of the input, which for Parquet
    is about its compressed length. Cases: null and empty texts have the end id alone; null ids come first; repeated
    ids are kept, ordered by their ids; an empty table writes no shard; other columns are not read.
    """
    spark = docs.sparkSession
    if shards is None:
        size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        shards = max(1, min(-(-size // SHARD_BYTES), 100_000))
        shards = max(shards, min(spark.sparkContext.defaultParallelism, -(-size // (1 << 20))))
    path = path or scratch_path(spark, "tokens")
    path = re.sub(r"^/", "file:///", path)
    path = re.sub(r"^file:/(?!/)", "file:///", path)
    return read_tables(write_tables(docs, path, tokenizer_path, shards), shards)
