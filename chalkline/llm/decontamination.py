"""Benchmark decontamination by winnowing.

Words are runs of letters, digits and non-ASCII characters, in lower case. A window is WINDOW consecutive words of
an item, or a whole item that is shorter. Of the GRAM-word hashes in every window the smallest is its fingerprint
(winnowing: GRAM + SELECT - 1 = WINDOW, so every shared span of WINDOW words or more has a common fingerprint). Items
of fewer words have their own hash of all words as fingerprint. Fingerprints of documents and benchmark are joined,
and a hit is extended to its window and compared word for word.

A benchmark of up to MAX_WORDS words and BROADCAST_BYTES of text is indexed once, on the driver, as arrays (about 30
bytes a window and the text), and sent to the workers, which match their texts in one pass without a shuffle. A
larger one is joined: fingerprints, then the windows of the documents that share one; both sides are distinct and
grouped by text, so copies are matched once and a frequent fingerprint costs a row for each text.

Cases: null and empty texts have no words and are clean; a very long text is matched whole; an item without words
matches nothing; a null item_id marks words but is not listed; ties don't occur; repeated rows and items count once
each in a document's items; an empty benchmark leaves all documents clean; other columns than those named are not
read, and ``prefix`` keeps the result's names apart from those of ``keep``.
"""

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.llm import columnar as C
from chalkline.llm.frames import pick, with_text
from chalkline.sources.scratch import scratch_table

WINDOW, GRAM = 10, 5
SELECT = WINDOW - GRAM + 1
BROADCAST_BYTES, MAX_WORDS = 8 << 20, 1_000_000
#: Words of an item, A-Z not lowered yet.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = np.array([b > 127 or chr(b).isdigit() or chr(b).islower() for b in range(256)])
_BITS = 20


@dataclass
class Words:
    """The words of a chunk of texts: places in ``data``, text index and hash of each."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray
    hashes: np.ndarray
    n_texts: int

    def span(self, i: int, n: int) -> bytes:
        """``n`` words from the i-th, with a space between."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[i : i + n].tolist(), self.ends[i : i + n].tolist(), strict=True))

    def within(self, n: int) -> np.ndarray:
        """For each run of ``n`` words: is it within a text?"""
        return self.of[: len(self.of) - n + 1] == self.of[n - 1 :] if len(self.of) >= n else np.zeros(0, bool)

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and fingerprint of every window of WINDOW words."""
        grams = C.gram_hashes(self.hashes, GRAM)
        inside = self.within(WINDOW)
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        least = grams[: len(inside)].copy()
        for i in range(1, SELECT):
            np.minimum(least, grams[i : len(inside) + i], out=least)
        at = np.flatnonzero(inside)
        return at, least[at]

    def short(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``n`` words, for items of so many words."""
        at = np.flatnonzero(self.within(n))
        return at, C.gram_hashes(self.hashes, n)[at]


def words_of(chunk: C.Chunk) -> Words:
    data = C.LOWER[chunk.data]
    starts, ends, of = C.runs(C.Chunk(chunk.first, data, chunk.offsets), _WORD)
    return Words(data, starts, ends, of, C.span_hashes(C.prefix_sums(data), starts, ends), len(chunk))


@dataclass
class Lookup:
    """Membership of hashes in a set: a bitmap of their low bits first, then a search."""

    values: np.ndarray
    bitmap: np.ndarray = field(init=False)

    def __post_init__(self):
        self.values = np.unique(self.values)
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[self.values & np.uint64((1 << _BITS) - 1)] = True

    def among(self, hashes: np.ndarray) -> np.ndarray:
        """Indices of the hashes that are in the set."""
        at = np.flatnonzero(self.bitmap[hashes & np.uint64((1 << _BITS) - 1)])
        return at[np.isin(hashes[at], self.values)]


@dataclass
class Windows:
    """The windows of one length: their fingerprints, and sorted hashes with the item and the first word of each."""

    marks: Lookup
    hashes: np.ndarray
    item: np.ndarray
    chunk: np.ndarray
    first: np.ndarray


class Index:
    """The windows of a benchmark as arrays, by length."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        self.ids = [i for i, _ in items]
        self.words: list[Words] = []
        found: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
        for chunk in C.text_chunks(pa.array([t for _, t in items], pa.string())):
            w = words_of(chunk)
            size = np.bincount(w.of, minlength=len(chunk))
            for n in np.unique(size[size > 0].clip(max=WINDOW)).tolist():
                first, marks = w.fingerprints() if n == WINDOW else w.short(n)
                own = size[w.of[first]] >= n if n == WINDOW else size[w.of[first]] == n
                first, marks = first[own], marks[own]
                found[n].append((marks, C.gram_hashes(w.hashes, n)[first], w.of[first] + chunk.first, np.full(len(first), len(self.words)), first))
            self.words.append(Words(w.data, w.starts, w.ends, w.of, np.zeros(0, np.uint64), w.n_texts))
        self.windows: dict[int, Windows] = {}
        for n, parts in sorted(found.items()):
            marks, hashes, item, chunk, first = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(hashes, kind="stable")
            self.windows[n] = Windows(Lookup(marks), hashes[order], *(x[order].astype(np.int32) for x in (item, chunk, first)))

    def items(self, n: int, value: np.uint64, span: bytes) -> set[str | None]:
        """The items that have the window ``span``: those of its hash, compared word for word."""
        of = self.windows[n]
        lo, hi = np.searchsorted(of.hashes, value, "left"), np.searchsorted(of.hashes, value, "right")
        return {self.ids[of.item[k]] for k in range(lo, hi) if self.words[of.chunk[k]].span(int(of.first[k]), n) == span}

    def match(self, w: Words) -> tuple[np.ndarray, list[set[str | None]]]:
        """Words hit in each text, and the items that occur in it."""
        change = np.zeros(len(w.starts) + 1, np.int64)
        found: list[set[str | None]] = [set() for _ in range(w.n_texts)]
        for n, windows in self.windows.items():
            first, marks = w.fingerprints() if n == WINDOW else w.short(n)
            first = first[windows.marks.among(marks)]
            if len(first):
                hashes, known = C.gram_hashes(w.hashes, n)[first], {}
                for i, value in zip(first.tolist(), hashes, strict=True):
                    key = w.span(i, n)
                    if key not in known:
                        known[key] = self.items(n, value, key)
                    if known[key]:
                        change[i] += 1
                        change[i + n] -= 1
                        found[w.of[i]] |= known[key]
        return np.bincount(w.of[np.cumsum(change[:-1]) > 0], minlength=w.n_texts), found


def item_windows(w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, Words]]:
    """(length, first words, fingerprints) of the windows of one text."""
    n = len(w.starts)
    if n >= WINDOW:
        yield WINDOW, *w.fingerprints(), w
    elif n:
        yield n, *w.short(n), w


_FOUND = {"n_words": T.LongType(), "n_hit": T.LongType(), "items": T.ArrayType(T.StringType())}


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", broadcast_bytes: int = BROADCAST_BYTES, prefix: str = "") -> DataFrame:
    """``keep`` of every document with n_words, n_hit (words inside a window's occurrence) and its sorted items.

    ``prefix`` is put before these three names, for tables that have such columns.
    """
    own = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))
    size, words = own.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("item_id"), F.lit(0)) + F.lit(32)), F.lit(0)), F.coalesce(F.sum(F.regexp_count("text", F.lit(ITEM_WORD))), F.lit(0))).first()
    if size <= broadcast_bytes and words <= MAX_WORDS:
        return _by_broadcast(docs, [tuple(r) for r in own.collect()], keep, text, prefix)
    return _by_join(docs, own, keep, text, prefix)


def _by_broadcast(docs: DataFrame, items: list[tuple], keep: list[str], text: str, prefix: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Index(items))
    read, name = with_text(docs, keep, text)
    names = [f"{prefix}{c}" for c in _FOUND]
    schema = T.StructType([*pick(read, *keep).schema, *map(T.StructField, names, _FOUND.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            n_words, n_hit, items = [], [], []
            for chunk in C.text_chunks(batch.column(name)):
                w = words_of(chunk)
                hit, found = index.match(w)
                n_words += np.bincount(w.of, minlength=len(chunk)).tolist()
                n_hit += hit.tolist()
                items += [sorted(x for x in f if x is not None) for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))], names=[*keep, *names])

    return read.mapInArrow(run, schema)


def _key(span: bytes) -> bytes:
    return hashlib.blake2b(span, digest_size=16).digest()


def _by_join(docs: DataFrame, own: DataFrame, keep: list[str], text: str, prefix: str) -> DataFrame:
    """Both sides as tables; windows are compared by 128-bit digests of their words."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, item_id in enumerate(batch.column("item_id").to_pylist()):
                for chunk in C.text_chunks(batch.column("text").slice(i, 1)):
                    for n, first, marks, w in item_windows(words_of(chunk)):
                        rows += [(item_id, n, mark, _key(w.span(f, n))) for f, mark in zip(first.tolist(), marks.view(np.int64).tolist(), strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(("item_id", "n", "mark", "span"), r, strict=True)) for r in rows], schema=pa.schema([("item_id", pa.string()), ("n", pa.int32()), ("mark", pa.int64()), ("span", pa.binary())]))

    items = scratch_table(own.mapInArrow(windows, "item_id string, n int, mark long, span binary").distinct(), "windows")
    lengths = sorted(r[0] for r in items.select("n").distinct().collect())
    marks = items.select("n", "mark").distinct()
    texts = docs.select(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("digest"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = batch.column("digest")
            for chunk in C.text_chunks(batch.column("text")):
                w = words_of(chunk)
                for n in lengths:
                    first, mark = w.fingerprints() if n == WINDOW else w.short(n)
                    new = np.ones(len(mark), bool)
                    new[1:] = (mark[1:] != mark[:-1]) | (w.of[first[1:]] != w.of[first[:-1]])
                    which = pa.array(w.of[first[new]] + chunk.first)
                    yield pa.RecordBatch.from_arrays([digests.take(which), pa.array(np.full(int(new.sum()), n, np.int32)), pa.array(mark[new].view(np.int64))], names=["digest", "n", "mark"])

    shared = texts.mapInArrow(prints, "digest string, n int, mark long").join(marks, ["n", "mark"], "left_semi")
    by_text = shared.groupBy("digest").agg(F.collect_set(F.struct("n", "mark")).alias("marks"))
    candidates = texts.dropDuplicates(["digest"]).join(by_text, "digest")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, wanted in enumerate(batch.column("marks").to_pylist()):
                digest = batch.column("digest")[i].as_py()
                by_n: dict[int, list[int]] = defaultdict(list)
                for x in wanted:
                    by_n[x["n"]].append(x["mark"])
                for chunk in C.text_chunks(batch.column("text").slice(i, 1)):
                    w = words_of(chunk)
                    for n, values in by_n.items():
                        first, mark = w.fingerprints() if n == WINDOW else w.short(n)
                        rows += [(digest, n, f, _key(w.span(f, n))) for f in first[np.isin(mark, np.array(values, np.int64).view(np.uint64))].tolist()]
            yield pa.RecordBatch.from_pylist([dict(zip(("digest", "n", "at", "span"), r, strict=True)) for r in rows], schema=pa.schema([("digest", pa.string()), ("n", pa.int32()), ("at", pa.int64()), ("span", pa.binary())]))

    spans = scratch_table(candidates.mapInArrow(extend, "digest string, n int, at long, span binary"), "spans")
    hits = scratch_table(spans.join(items.select("span").distinct(), "span"), "hits")
    words = hits.select("digest", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("word")).distinct().groupBy("digest").agg(F.count("word").alias("__hit"))
    # Ids come to the spans of each text once, not to every place of them
    named = hits.select("digest", "span").distinct().join(items.filter("item_id IS NOT NULL").select("span", "item_id"), "span")
    named = named.select("digest", F.col("item_id").alias("id")).distinct().groupBy("digest").agg(F.sort_array(F.collect_list("id")).alias("__listed"))
    counted = _by_broadcast(docs.withColumn("__digest", F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))), [], [*keep, "__digest"], text, "__")
    found = words.join(named, "digest", "left").withColumnRenamed("digest", "__digest")
    joined = counted.drop("__n_hit", "__items").join(found, "__digest", "left")
    listed = F.coalesce("__listed", F.array().cast("array<string>"))
    return joined.select(*(F.col(f"`{k}`") for k in keep), F.col("__n_words").alias(f"{prefix}n_words"), F.coalesce("__hit", F.lit(0)).cast("long").alias(f"{prefix}n_hit"), listed.alias(f"{prefix}items"))
