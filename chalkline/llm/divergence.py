"""Which terms set a source apart within its language, and how far sources lie from each other.

1. Tasks count the terms of whole texts and combine them over many documents, so that a (language, term, source) is a
   row for each stretch of documents, with how often and in how many of them it occurs.
2. These rows are partitioned by (language, term) and sorted by (language, term, source, stretch of documents); a scan
   of the runs in this order adds them up. A run of a term is a row with the sources that have it and their counts, and
   is left out where too few documents have the term.
3. Sums over the runs give each source's and language's counts. A second scan of the runs gives partial sums for pairs
   of sources, a matrix for each language of a task, which are added up; terms are compared with the language as rows.

All values are whole numbers: probabilities are billionths, rounded down, and plus one.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm import columnar as C
from chalkline.llm.frames import pick
from chalkline.sources.scratch import scratch_table

#: Documents of a language that have a term at least, for it to be kept.
LEAST_DOCS = 3
#: Probabilities are in units of 1 / SCALE.
SCALE = 1_000_000_000
#: Ranks of terms that are reported.
TOP = 200
#: Rows that a task combines before it passes them on.
COMBINED = 1 << 20
#: Sources of a block in the scan for pairs, and cells of a matrix there.
BLOCK_SOURCES, CELLS = 512, 1 << 20
#: Bytes of a table of groups that is broadcast, at most.
BROADCAST_BYTES = 8 << 20

_TERM_BYTES = C.byte_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)
#: Bytes of a term that are its key; a longer term has a number, behind a byte that no text has.
_WIDTH = 16
_LONG = np.uint64(0xFF)


class TermCounts:
    """Counts of terms by group for a stretch of documents: exact, as a term's key is its bytes."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.rows, self.long, self.names = 0, {}, []

    def _keys(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Two numbers for each term: its bytes, or those of its number."""
        padded = np.concatenate((data, np.zeros(_WIDTH, np.uint8)))
        size = ends - starts
        cells = padded[starts[:, None] + np.arange(_WIDTH)]
        cells[np.arange(_WIDTH) >= size[:, None]] = 0
        keys = cells.view(np.uint64)
        for i in np.flatnonzero(size > _WIDTH).tolist():
            term = data[starts[i] : ends[i]].tobytes()
            number = self.long.setdefault(term, len(self.names))
            if number == len(self.names):
                self.names.append(term)
            keys[i] = _LONG, number
        return keys

    def add(self, chunk: C.Chunk, group: np.ndarray) -> None:
        """The texts of a chunk, of which text ``i`` is of ``group[i]``; texts come in the order of their groups."""
        data = C.LOWER[chunk.data]
        starts, ends, of = C.runs(C.Chunk(chunk.first, data, chunk.offsets), _TERM_BYTES)
        if not len(starts):
            return
        keys = self._keys(data, starts, ends)
        order = np.lexsort((keys[:, 1], keys[:, 0]))  # stable: within a term by group and document
        keys, of, groups = keys[order], of[order], group[of[order]]
        new = np.ones(len(order), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1) | (groups[1:] != groups[:-1])
        doc = new.copy()
        doc[1:] |= of[1:] != of[:-1]
        at = np.flatnonzero(new)
        self._take(keys[at], groups[at], np.add.reduceat(doc.astype(np.int64), at), np.diff(np.append(at, len(order))))

    def _take(self, keys: np.ndarray, groups: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> None:
        part = np.empty(len(groups), [("a", np.uint64), ("b", np.uint64), ("g", np.int64), ("docs", np.int64), ("count", np.int64)])
        part["a"], part["b"], part["g"], part["docs"], part["count"] = keys[:, 0], keys[:, 1], groups, docs, counts
        self.parts.append(part)
        self.rows += len(part)
        if self.rows > COMBINED:
            self._combine()

    def _combine(self) -> np.ndarray:
        all_ = np.concatenate(self.parts)
        all_ = all_[np.lexsort((all_["g"], all_["b"], all_["a"]))]
        new = np.ones(len(all_), bool)
        new[1:] = (all_["a"][1:] != all_["a"][:-1]) | (all_["b"][1:] != all_["b"][:-1]) | (all_["g"][1:] != all_["g"][:-1])
        at = np.flatnonzero(new)
        out = all_[at]
        for c in ("docs", "count"):
            out[c] = np.add.reduceat(all_[c], at)
        self.parts, self.rows = [out], len(out)
        return out

    def full(self) -> bool:
        return self.rows > COMBINED // 2

    def rows_by_term(self, langs: pa.Array, sources: pa.Array, stretch: int) -> Iterator[pa.RecordBatch]:
        """lang, term, source, stretch, docs, count of all that was added."""
        if not self.rows:
            return
        all_ = self._combine()
        for at in range(0, len(all_), 1 << 16):
            out = all_[at : at + (1 << 16)]
            cells = np.stack((out["a"], out["b"]), axis=1).view(np.uint8)
            long = np.flatnonzero(out["a"] == _LONG)
            if len(long):
                terms = [bytes(x).rstrip(b"\0") for x in cells]
                for i in long.tolist():
                    terms[i] = self.names[int(out["b"][i])]
                term = pa.array(terms, pa.binary()).cast(pa.string())
            else:
                ends = np.concatenate(([0], np.cumsum((cells > 0).sum(axis=1)))).astype(np.int32)
                term = pa.StringArray.from_buffers(len(out), pa.py_buffer(ends), pa.py_buffer(cells[cells > 0]))
            group = pa.array(out["g"])
            yield pa.RecordBatch.from_arrays([langs.take(group), term, sources.take(group), pa.array(np.full(len(out), stretch)), pa.array(out["docs"]), pa.array(out["count"])], names=["lang", "term", "source", "stretch", "docs", "count"])


_ROWS = "lang string, term string, source string, stretch long, docs long, count long"


def term_rows(docs: DataFrame) -> DataFrame:
    """(lang, term, source, stretch, docs, count): terms of whole texts, combined over stretches of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, groups, stretch = TermCounts(), {}, 0

        def made() -> Iterator[pa.RecordBatch]:
            yield from counts.rows_by_term(pa.array([g[0] for g in groups], pa.string()), pa.array([g[1] for g in groups], pa.string()), stretch)

        for batch in batches:
            own = [groups.setdefault(g, len(groups)) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)]
            order = np.argsort(np.array(own, np.int64), kind="stable")
            group = np.array(own, np.int64)[order]
            for chunk in C.text_chunks(batch.column("text").take(pa.array(order))):
                counts.add(chunk, group[chunk.first : chunk.first + len(chunk)])
            if counts.full() or len(groups) > COMBINED:
                yield from made()
                counts, groups, stretch = TermCounts(), {}, stretch + 1
        yield from made()

    return docs.mapInArrow(run, _ROWS)


def _filled(docs: DataFrame) -> DataFrame:
    return pick(docs, "text", "lang", "source").na.fill("", ["text", "lang", "source"])


def term_runs(rows: DataFrame) -> DataFrame:
    """(lang, term, sources, counts, total) of each term that LEAST_DOCS documents of its language have.

    A scan of the sorted rows; the run at a batch's end is carried to the next. Rows of a term are at most one for each
    source and stretch, and are added up as they come; a run's row has an entry for each source that has the term, of
    which there are no more than ranks in the result of one source.
    """

    def change(*columns: pa.Array) -> np.ndarray:
        out = np.zeros(len(columns[0]), bool)
        out[:1] = True
        for c in columns:
            out[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        return out

    def summed(part: pa.RecordBatch) -> pa.RecordBatch:
        """A row for each (lang, term, source)."""
        at = np.flatnonzero(change(part.column("lang"), part.column("term"), part.column("source")))
        sums = [pa.array(np.add.reduceat(part.column(c).to_numpy(), at)) for c in ("docs", "count")]
        first = part.take(pa.array(at))
        return pa.RecordBatch.from_arrays([*(first.column(c) for c in ("lang", "term", "source")), *sums], names=["lang", "term", "source", "docs", "count"])

    def scanned(part: pa.RecordBatch) -> pa.RecordBatch:
        at = np.flatnonzero(change(part.column("lang"), part.column("term")))
        docs, total = (np.add.reduceat(part.column(c).to_numpy(), at) for c in ("docs", "count"))
        keep = np.flatnonzero(docs >= LEAST_DOCS)
        size = np.diff(np.append(at, len(part)))
        kept = np.repeat(docs >= LEAST_DOCS, size)
        ends = pa.array(np.concatenate(([0], np.cumsum(size[keep]))), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, part.column(c).filter(pa.array(kept))) for c in ("source", "count")]
        first = part.take(pa.array(at[keep]))
        return pa.RecordBatch.from_arrays([first.column("lang"), first.column("term"), *lists, pa.array(total[keep])], names=["lang", "term", "sources", "counts", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        names = ["lang", "term", "source", "docs", "count"]
        for batch in batches:
            if not len(batch):
                continue
            part = summed(batch.select(names))
            if held is not None:
                part = summed(pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0])
            last = int(np.flatnonzero(change(part.column("lang"), part.column("term")))[-1])
            held = part.slice(last)
            if last:
                yield scanned(part.slice(0, last))
        if held is not None:
            yield scanned(held)

    ordered = rows.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "stretch")
    return ordered.mapInArrow(run, "lang string, term string, sources array<string>, counts array<long>, total long")


def with_probability(df: DataFrame, out: str, count: str, total: str, kept: str) -> DataFrame:
    """``out``: 1 + floor(SCALE * (count + 1) / (total + kept)); in decimals where a product might exceed a long."""
    parts = f"({total} + {kept})"
    close = f"({count} + 1) * {SCALE}L div {parts}"
    wide = f"cast({count} + 1 as decimal(19,0)) * {SCALE} div cast({parts} as decimal(19,0))"
    return df.withColumn(out, F.expr(f"1 + CASE WHEN {count} < {2**62 // SCALE} THEN {close} ELSE {wide} END"))


def excess(p: str, q: str) -> Column:
    """floor((p - q)^2 / q)."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def _checked(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def probabilities(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``with_probability`` of a matrix (terms, sources) and the sources' totals with the kept terms."""
    if counts.size and counts.max() >= 2**62 // SCALE:
        return (1 + (counts.astype(object) + 1) * SCALE // n.astype(object)).astype(np.int64)
    return 1 + (counts + 1) * SCALE // n


def pair_sums(counts: np.ndarray, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums over terms of the excess of each source of ``left`` over each of ``right``.

    Terms that none of the sources has are one term with a weight.
    """
    used = counts.any(axis=1)
    weight = np.ones(int(used.sum()) + 1, np.int64)
    weight[-1] = len(counts) - used.sum()
    p = probabilities(np.concatenate((counts[used], np.zeros((1, counts.shape[1]), np.int64))), n)
    out = np.zeros((len(left), len(right)), np.int64)
    step = max(1, CELLS // max(1, len(left) * len(right)))
    for at in range(0, len(p), step):
        a, b = p[at : at + step, left][:, :, None], p[at : at + step, right][:, None, :]
        out += np.einsum("t,tij->ij", weight[at : at + step], (a - b) ** 2 // b)
    return out


def _pair_scan(members: dict[str, dict[str, tuple[int, int]]], sides: dict[str, tuple[np.ndarray, np.ndarray]]) -> Callable:
    """Partial pair sums of a task: ``members`` has place and total with kept terms of each source of the two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs):
                if lang not in members:
                    continue
                rows = batch.filter(pa.array(langs == lang))
                places = pa.array(list(members[lang]), pa.string())
                n = np.array([x[1] for x in members[lang].values()], np.int64)
                left, right = sides[lang]
                for at in range(0, len(rows), step := max(1, CELLS // len(n))):
                    part = rows.slice(at, step)
                    lists, counts = part.column("sources"), part.column("counts")
                    of = pc.list_parent_indices(lists).to_numpy()
                    where = pc.index_in(pc.list_flatten(lists), value_set=places)
                    mine = where.is_valid().to_numpy(zero_copy_only=False)
                    cells = np.zeros((len(part), len(n)), np.int64)
                    cells[of[mine], where.drop_null().to_numpy()] = pc.list_flatten(counts).to_numpy()[mine]
                    sums[lang] = sums.get(lang, 0) + pair_sums(cells, left, right, n)
        for lang, total in sums.items():
            names = list(members[lang])
            left, right = sides[lang]
            rows = [(lang, names[i], names[j], int(total[x, y])) for x, i in enumerate(left.tolist()) for y, j in enumerate(right.tolist()) if i != j]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "source", "item", "value"])

    return run


def source_pairs(runs: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all pairs of sources of a language, by blocks of BLOCK_SOURCES of a language's sources.

    What a task holds and the driver passes on is bounded by the two blocks; the blocks' number grows with the pairs that
    the result has.
    """
    most = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 0
    blocks = -(-most // BLOCK_SOURCES)
    dealt = groups.withColumn("block", F.pmod(F.xxhash64("source"), F.lit(max(1, blocks))))
    base = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    parts = [base.withColumn("value", F.lit(0).cast("long"))]
    for i in range(blocks):
        for j in range(i, blocks):
            members: dict[str, dict[str, tuple[int, int]]] = {}
            side: dict[str, tuple[list[int], list[int]]] = {}
            for r in dealt.filter(F.col("block").isin(i, j)).select("lang", "source", "block", (F.col("n") + F.col("kept")).alias("n")).collect():
                own = members.setdefault(r.lang, {})
                for k, b in enumerate((i, j)):
                    if r.block == b:
                        side.setdefault(r.lang, ([], []))[k].append(len(own))
                own[r.source] = len(own), r.n
            sides = {k: (np.array(a, int), np.array(b, int)) for k, (a, b) in side.items()}
            turns = [sides] if i == j else [sides, {k: (b, a) for k, (a, b) in sides.items()}]
            parts += [runs.select("lang", "sources", "counts").mapInArrow(_pair_scan(members, s), "lang string, source string, item string, value long") for s in turns]
    total = parts[0]
    for p in parts[1:]:
        total = total.union(p)
    return total.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank of every group of ``docs``.

    Cases: null text, lang or source is the empty text; every row is a document, also one that repeats another; a text
    without terms counts for its group only; a language without kept terms has pairs of value 0; a source that is alone
    in its language has no pairs; equal values rank by the item's UTF-8 bytes; very long texts are counted whole; an
    empty table gives an empty result; only text, lang and source are read, so extra columns never clash.
    """
    filled = _filled(docs)
    runs = scratch_table(term_runs(term_rows(filled)), "term-runs")
    each = runs.select("lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", "total", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))
    by_source = each.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    by_lang = runs.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_n"))
    groups = filled.select("lang", "source").distinct().join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = scratch_table(groups.na.fill(0, ["n", "kept", "lang_n"]), "groups")
    size = groups.agg(F.sum(F.octet_length("lang") + F.octet_length("source") + 64)).first()[0] or 0
    joined = each.join(_checked(groups, size), ["lang", "source"])
    judged = with_probability(with_probability(joined, "p", "count", "n", "kept"), "q", "total", "lang_n", "kept").filter("p > q")
    terms = judged.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    pairs = source_pairs(runs, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.union(terms)
