"""Removal of repeated byte strings by distributed suffix sorting.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id. Suffixes are never
all moved: every string of LENGTH bytes has a minimizer (the smallest hash of its GRAM-byte substrings), and a unit is
a run of consecutive string starts with the same minimizer, about one for 16 bytes.

1. Units are found where the texts are read, and their minimizers dealt by hash as packed arrays: a few rows for each
   task and partition. Of equal units of a batch (found by hash, then compared byte for byte) one moves on, the others
   are repeats. A minimizer with several different units in a batch is frequent: its units don't move in this step,
   only a mark does.
2. A partition finds the minimizers that recur in other documents. All others can't hold a repeat, whatever their
   hash met: hashes deal and filter here, they decide nothing.
3. The bytes of the units of recurring minimizers are fetched and dealt by minimizer (those of frequent minimizers
   string by string, by the strings' hashes). A partition sorts its units (deep-shallow: multikey quicksort, then blind
   tries); of equal ones all but the smallest document's are repeats as a whole. Of the different units that are
   left it takes the suffixes that may recur and sorts these in the same way; in every group of equal strings all but
   the smallest document's are repeats.
4. The runs of all steps come together by document, and its text is cut.

A repeat is thus decided by bytes, in a sorted order or by direct comparison. Pre-filters can't lose one: equal bytes
have equal hashes. A text crosses a shuffle once: both joins read the same exchange.

Cases: null and empty texts have no bytes; a text shorter than LENGTH loses nothing; a very long text is handled whole,
its units are spread over all partitions; ties (equal strings of one document) are no repeats of each other; a null
doc_id is neither smaller nor larger than others, so nothing is removed there or because of it; rows that repeat a
doc_id are one document (no removal between them; a removal applies at its place in each); an empty table gives an
empty result; only doc_id and text are read, so extra columns never clash.
"""

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm import columnar as C
from chalkline.llm.frames import pick
from chalkline.llm.suffix_sort import deep_shallow_sort
from chalkline.sources.scratch import scratch_table

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1
#: Text that a task gathers before it packs its units, text that it handles at a time, and units of a partition.
BATCH_BYTES, PIECE_BYTES, PARTITION_UNITS = 8 << 20, 1 << 18, 500_000
#: Units of one minimizer above which their strings are dealt by their own hashes: of all batches, of one batch.
HOT_UNITS, HOT_BATCH = 20_000, 16
#: Strings that a task sorts at a time, about.
SORTED_STRINGS = 100_000
#: Bytes of a unit at most, and bytes around a minimizer that any string of it shares on one side.
UNIT_BYTES, SIDE = LENGTH + SPAN - 1, GRAM + (LENGTH - GRAM) // 2
_U = np.uint64


def units(chunk: C.Chunk) -> tuple[np.ndarray, ...]:
    """(text index, first string start within the text, strings, minimizer's place in the unit, its hash, hash of the unit's bytes)."""
    n = len(chunk.data)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    sums = C.prefix_sums(chunk.data)
    at = np.arange(n - GRAM + 1)
    hashes = C.span_hashes(sums, at, at + GRAM)
    # Hash above, place below: the smallest value is the leftmost smallest hash, and names its place.
    packed = (hashes & _U(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width = 1
    while 2 * width <= SPAN:
        packed = np.minimum(packed[:-width], packed[width:])
        width *= 2
    starts = n - LENGTH + 1
    least = np.minimum(packed[:starts], packed[SPAN - width : SPAN - width + starts]) & _U(0xFFFFFFFF)
    lengths = np.diff(chunk.offsets)
    room = np.repeat(chunk.offsets[1:], lengths)[:starts]
    valid = np.arange(starts) + LENGTH <= room
    changed = np.ones(starts, bool)
    changed[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    first = np.flatnonzero(valid & changed)
    ended = np.ones(starts, bool)
    ended[:-1] = changed[1:] | ~valid[1:]
    last = np.flatnonzero(valid & ended)
    of = np.searchsorted(chunk.offsets, first, side="right") - 1
    anchor = least[first].astype(np.int64)
    return of, first - chunk.offsets[of], last - first + 1, anchor - first, hashes[anchor], C.span_hashes(sums, first, last + LENGTH)


def _gathered(batches: Iterator[pa.RecordBatch], columns: list[str], least: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``least`` bytes at least, in order of doc_id."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            held.append(batch.slice(at, 256))
            size += held[-1].nbytes
            if size >= least:
                yield _ordered(held, columns)
                held, size = [], 0
    if held:
        yield _ordered(held, columns)


def _ordered(held: list[pa.RecordBatch], columns: list[str]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).select(columns)
    table = table.take(pa.array(np.argsort(table.column("doc_id").to_numpy(), kind="stable"))).combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)


def _pack(doc: np.ndarray, at: np.ndarray, count: np.ndarray, *raw: np.ndarray) -> bytes:
    """Arrays of equal length as bytes; ids and places as compressed differences."""
    body = np.diff(doc, prepend=0).astype("<i8").tobytes() + np.diff(at, prepend=0).astype("<i8").tobytes() + count.astype("<u2").tobytes()
    small = zstandard.ZstdCompressor(level=1).compress(_shuffled(body, len(doc)))
    return np.array([len(doc), len(small)], "<i8").tobytes() + small + b"".join(np.ascontiguousarray(r).tobytes() for r in raw)


def _shuffled(body: bytes, n: int) -> bytes:
    """The bytes of the two long columns by place, which compresses better."""
    longs = np.frombuffer(body[: 16 * n], np.uint8).reshape(2, n, 8)
    return np.ascontiguousarray(longs.transpose(0, 2, 1)).tobytes() + body[16 * n :]


def _unpack(blob: bytes, *widths: int) -> list[np.ndarray]:
    """The arrays of ``_pack``; raw ones as byte matrices of the given widths."""
    n, length = np.frombuffer(blob, "<i8", 2).tolist()
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[16 : 16 + length]), np.uint8)
    longs = np.ascontiguousarray(body[: 16 * n].reshape(2, 8, n).transpose(0, 2, 1)).view("<i8")[:, :, 0]
    out, at = [np.cumsum(longs[0]), np.cumsum(longs[1]), body[16 * n :].view("<u2").astype(np.int64)], 16 + length
    for width in widths:
        out.append(np.frombuffer(blob, np.uint8, n * width, at).reshape(n, width))
        at += n * width
    return out


def _verified(keys: np.ndarray, doc: np.ndarray, rows_at) -> np.ndarray:
    """For rows in order of ``doc``: is a row of a smaller document with an equal key equal in bytes, too?

    ``rows_at`` gives the byte rows of numbers; a row is compared with the first of its key.
    """
    order = np.argsort(keys, kind="stable")
    same = np.concatenate(([False], keys[order][1:] == keys[order][:-1]))
    first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(keys))))]
    out = np.zeros(len(keys), bool)
    for i in range(0, len(keys), 1 << 14):
        own, ahead = order[i : i + (1 << 14)], first[i : i + (1 << 14)]
        later = doc[own] > doc[ahead]
        own, ahead = own[later], ahead[later]
        out[own] = (rows_at(own) == rows_at(ahead)).all(axis=1)
    return out


_BLOBS = "part int, kind int, blob binary"


def _blob_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["part", "kind", "blob"])


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Partitions of hashes, which are hashed again: minimizers are small numbers."""
    return (((C.mix(hashes) >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int64)


def _unit_rows(data: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The units' bytes, with zeros after their end and their number of strings as the last byte."""
    reach = count + LENGTH - 1
    rows = _window(data, start, UNIT_BYTES + 1) * (np.arange(UNIT_BYTES + 1) < reach[:, None])
    rows[:, -1] = count
    return rows


def unit_blobs(texts: DataFrame, parts: int) -> DataFrame:
    """Packed units by partition (kind 0), runs that are repeats (kind 1) and runs of frequent minimizers (kind 3).

    A unit of 0 strings among those of kind 0 marks a frequent minimizer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, ["doc_id", "text"], BATCH_BYTES):
            ids = batch.column("doc_id").to_numpy()
            found, pieces, base = [], [], 0
            for chunk in C.text_chunks(batch.column("text"), PIECE_BYTES):
                of, at, count, _, anchor, whole = units(chunk)
                found.append((ids[of + chunk.first], at, count, anchor, whole, at + chunk.offsets[of] + base))
                pieces.append(chunk.data)
                base += len(chunk.data)
            if not found:
                continue
            doc, at, count, anchor, whole, start = (np.concatenate(x) for x in zip(*found, strict=True))
            data = np.concatenate((*pieces, np.zeros(UNIT_BYTES + 1, np.uint8)))
            repeat = _verified(C.mix(anchor + whole), doc, lambda i: _unit_rows(data, start[i], count[i]))
            rows = []
            if repeat.any():
                rows.append((int(ids[0]) % parts, 1, _pack(doc[repeat], at[repeat], count[repeat])))
            doc, at, count, anchor = (x[~repeat] for x in (doc, at, count, anchor))
            del found, pieces, data, start, whole
            several, of, times = np.unique(anchor, return_inverse=True, return_counts=True)
            hot = times[of] >= HOT_BATCH
            if hot.any():
                rows.append((int(ids[0]) % parts, 3, _pack(doc[hot], at[hot], count[hot])))
            marked = several[times >= HOT_BATCH]
            none = np.zeros(len(marked), np.int64)
            doc, at, count, anchor = (np.concatenate(x) for x in ((doc[~hot], none), (at[~hot], none), (count[~hot], none), (anchor[~hot], marked)))
            part = _part(anchor, parts)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            low = anchor.view(np.uint8).reshape(-1, 8)[:, :5]
            for p in np.flatnonzero(np.diff(ends)).tolist():
                own = order[ends[p] : ends[p + 1]]
                rows.append((p, 0, _pack(doc[own], at[own], count[own], low[own])))
            del doc, at, count, anchor, order, low, several, of, times
            for i in range(0, len(rows), 64):
                yield _blob_batch(rows[i : i + 64])
            C.release_memory()

    return texts.mapInArrow(run, _BLOBS)


def _merged(row: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """(rows, for each its runs): runs of a row that follow one another or overlap are one; those of frequent minimizers (negative) apart."""
    order = np.lexsort((at, count < 0, row))
    row, at, hot, end = row[order], at[order], count[order] < 0, (at + np.abs(count))[order]
    other = np.concatenate(([True], (row[1:] != row[:-1]) | (hot[1:] != hot[:-1]))) if len(row) else np.zeros(0, bool)
    # Ends may lie within earlier runs of the row: their running maximum, by a step that no end exceeds
    step = np.cumsum(other) * (int(end.max(initial=0)) + 1)
    reach = np.maximum.accumulate(end + step) - step
    new = other.copy()
    new[1:] |= at[1:] > reach[:-1]
    starts = np.flatnonzero(new)
    ends = np.maximum.reduceat(end, starts) if len(starts) else end
    row, at, count = row[starts], at[starts], (ends - at[starts]) * np.where(hot[starts], -1, 1)
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
    flat = np.stack((at, count), axis=1).reshape(-1).astype(np.int32)
    return row[first], pa.ListArray.from_arrays(pa.array(2 * np.append(first, len(row)), pa.int32()), pa.array(flat))


_RUNS = "kind int, doc_id long, runs array<int>"
_REPEATED, _CONTESTED = 1, 2


def _run_batch(kind: int, doc: np.ndarray, at: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """Runs (start, number of strings) by document."""
    ids, lists = _merged(doc, at.astype(np.int64), count.astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids), lists], names=["kind", "doc_id", "runs"])


def collected(runs: DataFrame) -> DataFrame:
    """The runs of each kind and document together, merged: what repeats is contiguous, so little is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("runs")
            pairs = lists.flatten().to_numpy().reshape(-1, 2).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()) // 2)
            rows, merged = _merged(row, pairs[:, 0], pairs[:, 1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in ("kind", "doc_id")), merged], names=["kind", "doc_id", "runs"])

    return runs.groupBy("kind", "doc_id").agg(F.flatten(F.collect_list("runs")).alias("runs")).mapInArrow(run, _RUNS)


def judge_units(blobs: DataFrame, parts: int) -> DataFrame:
    """Runs that are known to be repeats, and runs of minimizers that recur in other documents, negative if these are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
                if kind == 1:
                    yield _run_batch(_REPEATED, *_unpack(blob.as_buffer().to_pybytes()))
                elif kind == 3:
                    doc, at, count = _unpack(blob.as_buffer().to_pybytes())
                    yield _run_batch(_CONTESTED, doc, at, -count)
                else:
                    doc, at, count, low = _unpack(blob.as_buffer().to_pybytes(), 5)
                    keys = np.zeros((len(doc), 8), np.uint8)
                    keys[:, :5] = low
                    held.append([doc, at.astype(np.int32), count.astype(np.int8), keys.view("<u8")[:, 0]])
        if not held:
            return
        doc, at, count, anchor = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(anchor, kind="stable")
        doc, at, count, anchor = (x[order] for x in (doc, at, count, anchor))
        del order
        starts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        sizes = np.diff(np.append(starts, len(doc)))
        hot = (np.minimum.reduceat(count, starts) == 0) | (sizes > HOT_UNITS)
        recurs = hot | (np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts))
        use = np.repeat(recurs, sizes) & (count > 0)
        sign = np.repeat(np.where(hot, -1, 1), sizes)
        yield _run_batch(_CONTESTED, doc[use], at[use], count[use] * sign[use])
        del doc, at, count, anchor, use, sign
        C.release_memory()

    return blobs.repartitionById(parts, F.col("part")).mapInArrow(run, _RUNS)


def _window(data: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(data, length)[place] if len(place) else np.zeros((0, length), np.uint8)


def contested_blobs(rows: DataFrame, parts: int) -> DataFrame:
    """The bytes of contested runs, packed by the partition of their minimizer (kind 0).

    Runs of frequent minimizers are packed as single strings by their hashes (kind 2). Units and strings that an equal
    one of the batch, compared byte for byte, shows to be repeats are told so (kind 1).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, ["doc_id", "text", "runs"], BATCH_BYTES // 2):
            ids = batch.column("doc_id").to_numpy()
            runs, ends = batch.column("runs").values.to_numpy().reshape(-1, 2).astype(np.int64), batch.column("runs").offsets.to_numpy() // 2
            held_units, held_strings = [], []
            for chunk in C.text_chunks(batch.column("text"), PIECE_BYTES):
                own = ends[chunk.first : chunk.first + len(chunk) + 1]
                run_at, size = runs[own[0] : own[-1]].T
                run_of = np.repeat(np.arange(len(chunk)), np.diff(own))
                fits = run_at + np.abs(size) + LENGTH - 1 <= np.diff(chunk.offsets)[run_of]  # another text of a repeated id may be shorter
                run_at, size, run_of = run_at[fits], size[fits], run_of[fits]
                if not len(run_at):
                    continue
                # The runs' bytes, one after the other, have the units that they are made of
                lengths = np.abs(size) + LENGTH - 1
                offsets = np.concatenate(([0], np.cumsum(lengths)))
                data = chunk.data[np.repeat(run_at + chunk.offsets[run_of] - offsets[:-1], lengths) + np.arange(offsets[-1])]
                of, at, count, anchor, minimizer, _ = units(C.Chunk(0, data, offsets))
                start, doc, at, usual = at + offsets[of], ids[run_of[of] + chunk.first], at + run_at[of], size[of] > 0
                padded = np.concatenate((data, np.zeros(UNIT_BYTES + 1, np.uint8)))
                held_units.append((doc[usual], at[usual], count[usual], _part(minimizer[usual], parts), anchor[usual], _unit_rows(padded, start[usual], count[usual])))
                doc, at, count, start = doc[~usual], at[~usual], count[~usual], start[~usual]
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                doc, at, start = np.repeat(doc, count), np.repeat(at, count) + step, np.repeat(start, count) + step
                held_strings.append((doc, at, C.span_hashes(C.prefix_sums(data), start, start + LENGTH), _window(data, start, LENGTH)))
            rows = []
            if held_units:
                doc, at, count, part, anchor, unit = (np.concatenate(x) for x in zip(*held_units, strict=True))
                repeat = _verified(row_hashes(lambda i, unit=unit: unit[i], np.arange(len(unit))), doc, lambda i, unit=unit: unit[i])
                if repeat.any():
                    rows.append((int(ids[0]) % parts, 1, _pack(doc[repeat], at[repeat], count[repeat])))
                doc, at, count, part, anchor, unit = (x[~repeat] for x in (doc, at, count, part, anchor, unit))
                rows += [(p, 0, _pack_bytes(doc[i], at[i], count[i], anchor[i], unit[i])) for p, i in _dealt(part)]
                doc, at, hashes, strings = (np.concatenate(x) for x in zip(*held_strings, strict=True))
                repeat = _verified(hashes, doc, lambda i, strings=strings: strings[i])
                if repeat.any():
                    rows.append((int(ids[0]) % parts, 1, _pack(doc[repeat], at[repeat], np.ones(int(repeat.sum())))))
                doc, at, hashes, strings = doc[~repeat], at[~repeat], hashes[~repeat], strings[~repeat]
                part = _part(hashes, parts)
                rows += [(p, 2, _pack_bytes(doc[i], at[i], np.ones(len(i)), np.zeros(len(i)), strings[i])) for p, i in _dealt(part)]
            for i in range(0, len(rows), 64):
                yield _blob_batch(rows[i : i + 64])
            C.release_memory()

    return rows.mapInArrow(run, _BLOBS)


def _dealt(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(partition, its rows) of all partitions that have any."""
    order = np.argsort(part, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], part[order][1:] != part[order][:-1]))) if len(part) else []
    for i, start in enumerate(starts):
        own = order[start : starts[i + 1] if i + 1 < len(starts) else None]
        yield int(part[own[0]]), own


def _pack_bytes(doc: np.ndarray, at: np.ndarray, count: np.ndarray, anchor: np.ndarray, rows: np.ndarray) -> bytes:
    """As ``_pack``, with the rows (and the place of the minimizer in each) compressed: neighbours share most bytes."""
    packed = zstandard.ZstdCompressor(level=1).compress(anchor.astype(np.uint8).tobytes() + np.ascontiguousarray(rows).tobytes())
    head = _pack(doc, at, count)
    return np.array([len(head)], "<i8").tobytes() + head + packed


def _unpack_bytes(blob: bytes, width: int) -> list[np.ndarray]:
    (length,) = np.frombuffer(blob, "<i8", 1).tolist()
    columns = _unpack(blob[8 : 8 + length])
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8 + length :]), np.uint8)
    n = len(columns[0])
    return [*columns, body[:n].astype(np.int64), body[n:].reshape(n, width)]


def _flat(rows: np.ndarray, begin: np.ndarray, length: int, row: np.ndarray) -> np.ndarray:
    """``length`` bytes of each ``row`` of ``rows`` from ``begin``."""
    return _window(rows.reshape(-1), row * rows.shape[1] + begin, length)


def shared_strings(doc: np.ndarray, at: np.ndarray, count: np.ndarray, anchor: np.ndarray, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc, start, string) of the strings of units that another document may have too, equal ones in the same part.

    A string holds its minimizer and at least half of the other bytes on one side of it. It can recur only where the
    minimizer with that side recurs, so all strings of sides that occur in one document only are left out, and sides
    can be told apart one after the other: parts hold whole sides, about SORTED_STRINGS strings.
    """
    reach = count + LENGTH - 1
    for right in (True, False):
        begin = anchor if right else anchor - (SIDE - GRAM)
        rows = np.flatnonzero((begin >= 0) & (begin + SIDE <= reach))
        hashes = row_hashes(lambda i, begin=begin: _flat(unit, begin[i], SIDE, i), rows)
        order = np.lexsort((doc[rows], hashes))
        rows, hashes = rows[order], hashes[order]
        starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(rows) else np.zeros(0, np.int64)
        if not len(starts):
            continue
        several = np.minimum.reduceat(doc[rows], starts) < np.maximum.reduceat(doc[rows], starts)
        chosen = np.repeat(several, np.diff(np.append(starts, len(rows))))
        rows, hashes = rows[chosen], hashes[chosen]
        # Strings start at 0 .. count - 1 of the unit; on the right side those with SIDE bytes from the minimizer on
        last, edge = np.minimum(count[rows] - 1, anchor[rows]), anchor[rows] - (LENGTH - SIDE)
        lo, hi = (np.maximum(edge, 0), last) if right else (np.zeros(len(rows), np.int64), np.minimum(edge - 1, last))
        sizes = np.maximum(hi - lo + 1, 0)
        before, first = np.cumsum(sizes) - sizes, 0
        while first < len(rows):
            end = int(np.searchsorted(before, before[first] + SORTED_STRINGS, side="left"))
            end = int(np.searchsorted(hashes[first:], hashes[max(first, end - 1)], side="right")) + first  # to the end of its side
            size = sizes[first:end]
            place = np.repeat(lo[first:end] - np.cumsum(size) + size, size) + np.arange(size.sum())
            row = np.repeat(rows[first:end], size)
            yield doc[row], at[row] + place, _flat(unit, place, LENGTH, row)
            first = end


def row_hashes(rows_at, index: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Hashes of the byte rows that ``rows_at`` gives for the numbers in ``index``, some at a time."""
    out = np.zeros(len(index), np.uint64)
    for i in range(0, len(index), step):
        rows = rows_at(index[i : i + step])
        n, width = rows.shape
        out[i : i + n] = C.span_hashes(C.prefix_sums(rows.reshape(-1)), np.arange(n) * width, np.arange(1, n + 1) * width)
    return out


def hashed_strings(doc: np.ndarray, at: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Strings in parts of about SORTED_STRINGS, equal ones in the same part."""
    parts = -(-len(doc) // SORTED_STRINGS)
    part = row_hashes(lambda i: rows[i], np.arange(len(doc))) % _U(max(1, parts))
    for p in range(parts):
        own = part == p
        yield doc[own], at[own], rows[own]


def _repeated_rows(doc: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Numbers of the rows that are equal to a row of a smaller document, by sorting all of them."""
    if not len(doc):
        return np.zeros(0, np.int64)
    order, first = deep_shallow_sort(rows)
    starts = np.flatnonzero(first)
    least = np.repeat(np.minimum.reduceat(doc[order], starts), np.diff(np.append(starts, len(doc))))
    return order[doc[order] > least]


def sort_strings(blobs: DataFrame, parts: int) -> DataFrame:
    """Starts of strings that also start in a smaller document, from each partition's sorted suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, strings = [], []
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
                data = blob.as_buffer().to_pybytes()
                if kind == 1:
                    yield _run_batch(_REPEATED, *_unpack(data))
                elif kind == 0:
                    units.append(_unpack_bytes(data, UNIT_BYTES + 1))
                else:
                    doc, at, _, _, rows = _unpack_bytes(data, LENGTH)
                    strings.append((doc, at, rows))
        several = []
        if units:
            doc, at, count, anchor, unit = (np.concatenate(x) for x in zip(*units, strict=True))
            units.clear()
            repeat = _repeated_rows(doc, unit)
            yield _run_batch(_REPEATED, doc[repeat], at[repeat], count[repeat])
            rest = np.ones(len(doc), bool)
            rest[repeat] = False
            several.append(shared_strings(*(x[rest] for x in (doc, at, count, anchor, unit))))
            del doc, at, count, anchor, unit, rest
        if strings:
            several.append(hashed_strings(*(np.concatenate(x) for x in zip(*strings, strict=True))))
        units.clear()
        strings.clear()
        for doc, at, rows in chain.from_iterable(several):
            if not len(doc):
                continue
            repeat = _repeated_rows(doc, rows)
            yield _run_batch(_REPEATED, doc[repeat], at[repeat], np.ones(len(repeat), np.int64))
            del doc, at, rows
        C.release_memory()

    return blobs.repartitionById(parts, F.col("part")).mapInArrow(run, _RUNS)


def cut(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) from (doc_id, text, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, out = batch.column("runs"), []
            for chunk in C.text_chunks(batch.column("text"), PIECE_BYTES):
                for i in range(len(chunk)):
                    data, pairs = chunk.data[chunk.offsets[i] : chunk.offsets[i + 1]], lists[chunk.first + i].values
                    n, removed, spans = len(data), 0, 0
                    if pairs is not None and len(pairs):
                        at, count = pairs.to_numpy(zero_copy_only=False).reshape(-1, 2).T.astype(np.int64)
                        change = np.zeros(n + 1, np.int64)
                        np.add.at(change, np.minimum(at, n), 1)
                        np.add.at(change, np.minimum(at + count + LENGTH - 1, n), -1)
                        gone = np.cumsum(change[:-1]) > 0
                        removed, spans = int(gone.sum()), int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if n else 0
                        data = data[~gone]
                    out.append((n, removed, spans, data.tobytes()))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (remaining bytes) of every document."""
    texts = pick(docs, "doc_id", "text")
    if dict(texts.dtypes)["doc_id"] != "bigint":  # a cast of its own type would keep the joins' exchanges of texts from being one
        texts = texts.withColumn("doc_id", F.col("doc_id").cast("long"))
    named = texts.filter("doc_id IS NOT NULL")
    size = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // (16 * PARTITION_UNITS)))
    found = scratch_table(collected(judge_units(unit_blobs(named, parts), parts)), "runs")
    contested = found.filter(F.col("kind") == _CONTESTED).select("doc_id", "runs")
    told = sort_strings(contested_blobs(named.join(contested, "doc_id"), parts), parts)
    runs = collected(found.filter(F.col("kind") == _REPEATED).union(told)).select("doc_id", "runs")
    every = named.join(runs, "doc_id", "left")
    return cut(every.union(texts.filter("doc_id IS NULL").withColumn("runs", F.lit(None).cast("array<int>"))))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
