"""Near-duplicate groups by bottom-k sketches from one hash function.

A document's set holds its distinct five-word shingles; its sketch the K smallest hashes of them.

1. One pass over the texts gives sizes, 128-bit fingerprints of the whole sets, and sketches. Documents with equal
   sets are one class from here on, so copies cost no pairs.
2. Inverted lists of retained values. Two sets with similarity of 0.75 or more share at least ``_needed`` values of
   their sketches: all values are in a sketch that is the whole set, and otherwise each of the union's K smallest
   is shared with that probability, so fewer than SHARED of K occur less than once in 10**15 pairs at 0.75 exactly
   (and ever more rarely above it), as rarely as two of the 64-bit hashes meet. Hence
   such a pair also shares one of the ``kept - needed + 1`` rarest values of either sketch (prefix filter, order by
   frequency over all classes), and only these enter the lists. Passages that many documents share are thus left
   out unless they make up most of a document.
3. The classes of all lists with the same centre (the class with the fewest unshared values) are a group. They come
   together in blocks of bounded size, each with the centre. A class is compared with the centre first: the sketch
   of their union estimates the similarity and filters, and whole sets verify. Blocks that are left with several
   components are counted out exactly on whole sets.
4. Links are contracted to components. Groups of several blocks that still hold several components are dealt anew:
   classes of the largest component meet those of the others, and these each other, first by their sketches, and only
   the texts of classes that have a candidate in another component move and are counted out exactly. No pair is moved
   and nothing is capped, so no link between components is lost.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm import columnar as C
from chalkline.operators.components import connected_components
from chalkline.llm.frames import pick
from chalkline.sources.scratch import scratch_table

SHINGLE = 5
K = 64
#: Values of K that a pair's sketches share at least, for sets larger than a sketch can hold.
SHARED = 18
#: Similarity in hundredths.
LEAST = 75
#: Bits of the map of wanted ids (4 MB).
BITMAP_BITS = 25
#: Classes and hashes of a block, about.
BLOCK_CLASSES, BLOCK_VALUES = 512, 1 << 20


def _needed(n: int) -> int:
    """Values that the sketch of a set of ``n`` shares with that of any similar set, at least."""
    exact = -(-LEAST * n // 100)
    return exact if n <= K * LEAST // 100 else min(exact, SHARED)


def shingle_sets(chunk: C.Chunk) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    lowered = C.Chunk(chunk.first, C.LOWER[chunk.data], chunk.offsets)
    starts, ends, of = C.runs(lowered, C.NOT_WHITE)
    words = C.span_hashes(C.prefix_sums(lowered.data), starts, ends)
    grams = C.gram_hashes(words, SHINGLE)
    stops = np.cumsum(np.bincount(of, minlength=len(chunk)))
    at = 0
    for stop in stops.tolist():
        n = stop - at
        if n >= SHINGLE:
            yield np.unique(grams[at : stop - SHINGLE + 1])
        else:
            yield C.gram_hashes(words[at:stop], n) if n else np.zeros(0, np.uint64)
        at = stop


def fingerprint(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), fp and sketch of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, values, lengths = [], [], [], [0]
            for chunk in C.text_chunks(batch.column("text")):
                for s in shingle_sets(chunk):
                    sizes.append(len(s))
                    prints.append(fingerprint(s) if len(s) else None)
                    values.append(s[:K])
                    lengths.append(min(K, len(s)))
            flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(prints, pa.binary()), lists], names=["doc_id", "n", "fp", "sketch"])

    return pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, n int, fp binary, sketch array<long>")


def class_table(made: DataFrame) -> DataFrame:
    """(fp, rep, key): the classes of equal sets, the smallest id of each, and a number for each.

    The number is the id, or a negative hash of the fingerprint where an id repeats with other texts and so stands for
    several classes.
    """
    classes = made.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    several = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("k")).filter("k > 1 AND rep IS NOT NULL").select("rep", F.lit(True).alias("several"))
    other = F.shiftrightunsigned(F.xxhash64("fp"), 2) * -1 - 1
    return classes.join(several, "rep", "left").select("fp", "rep", F.when(F.col("several"), other).otherwise(F.col("rep")).alias("key"))


def inverted_lists(made: DataFrame, classes: DataFrame) -> DataFrame:
    """(v, key, n, alone): the values by which classes are looked up; ``alone`` counts a class's unshared ones."""
    named = made.join(classes.withColumnRenamed("rep", "doc_id"), ["fp", "doc_id"]).dropDuplicates(["fp", "doc_id"])
    values = named.select("key", "n", F.explode("sketch").alias("v"))
    counts = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = values.join(counts, "v")
    kept = F.least("n", F.lit(K))
    needed = F.when(F.col("n") <= K * LEAST // 100, F.ceil(F.col("n") * LEAST / 100)).otherwise(F.least(F.ceil(F.col("n") * LEAST / 100), F.lit(SHARED)))
    each = shared.groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    each = each.withColumn("alone", kept - F.size("vs")).withColumn("take", (kept - needed + 1 - F.col("alone")).cast("int"))
    return each.filter("take > 0").select("key", "n", "alone", F.explode(F.slice("vs", 1, F.col("take"))).alias("x")).select(F.col("x.v").alias("v"), "key", "n", "alone")


def memberships(lists: DataFrame) -> DataFrame:
    """(centre, key, n, block, blocks): the classes of all lists that have the centre, once each, in blocks.

    The centre of a list is the class with the fewest unshared values. Blocks hold about BLOCK_CLASSES classes and
    BLOCK_VALUES hashes at most; the centre stands in every block of its group.
    """
    centres = lists.groupBy("v").agg(F.min(F.struct("alone", F.negative("n").alias("m"), "key")).alias("c"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    members = lists.join(centres.select("v", F.col("c.key").alias("centre")), "v").select("centre", "key", "n").distinct()
    sizes = members.groupBy("centre").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("k") / BLOCK_CLASSES), F.ceil(F.col("total") / BLOCK_VALUES)).cast("int")
    dealt = members.join(sizes.select("centre", blocks.alias("blocks")), "centre")
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    every = F.when(F.col("key") == F.col("centre"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    return dealt.withColumn("block", F.explode(every))


def named_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (rep, ...) with the texts of the documents that have these ids.

    A bitmap of the wanted ids' hashes (bounded: 2**BITMAP_BITS bits) drops most other texts where they are read, so
    that they don't cross the join's shuffle. It lets some pass; the join is exact.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << BITMAP_BITS))
    spots = wanted.select(place("rep").alias("h"))
    bitmap = spots.groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    texts = pick(docs, "doc_id", "text").withColumn("rep", F.col("doc_id").cast("long")).withColumn("h", place("rep"))
    texts = texts.withColumn("bucket", F.bitmap_bucket_number("h")).withColumn("bit", F.bitmap_bit_position("h"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = texts.join(F.broadcast(bitmap), "bucket").filter(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1)
    return wanted.join(near.select("rep", "text"), "rep")


def maybe_similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Does the sketch of the union allow a similarity of LEAST? Exact for sets that their sketches hold whole."""
    union = np.union1d(a[:K], b[:K])
    if len(a) <= K and len(b) <= K:
        return 100 * (len(a) + len(b) - len(union)) >= LEAST * len(union)
    low = union[:K]
    shared = np.count_nonzero(np.isin(low, a[:K], assume_unique=True) & np.isin(low, b[:K], assume_unique=True))
    return shared * K >= SHARED * len(low)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate((a, b))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= LEAST * (len(a) + len(b) - common)


class Components:
    """Disjoint sets of numbers; ``join`` notes the pairs that joined two."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.joined: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def join(self, a: int, b: int) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            self.parent[ra] = rb
            self.joined.append((a, b))


def star_links(sets: list[np.ndarray], component: np.ndarray, centre: int, known: Components) -> None:
    """Compare all sets with the centre: by size, by the union's sketch, then exactly."""
    middle = sets[centre]
    for i, s in enumerate(sets):
        if i != centre and 100 * min(len(s), len(middle)) >= LEAST * max(len(s), len(middle)) and known.find(int(component[i])) != known.find(int(component[centre])):
            if maybe_similar(s, middle) and similar(s, middle):
                known.join(int(component[i]), int(component[centre]))


def common_values(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each set of ``left`` shares with each of ``right``: matrix products over shared hashes."""
    n = len(sets)
    _, which, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(df > 1, np.cumsum(df > 1) - 1, -1)[which]
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common, width = np.zeros((len(left), len(right)), np.float32), 2048
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        part = np.zeros((n, width), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        common += part[left] @ part[right].T
    return common


def sketch_candidates(sketches: list[np.ndarray], sizes: np.ndarray, component: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairs (of ``left`` and ``right``) of different components whose sketches share what those of similar sets do."""
    needed = np.array([_needed(int(n)) for n in sizes])
    enough = common_values(sketches, left, right) >= np.maximum(needed[left][:, None], needed[right][None, :])
    return enough & (component[left][:, None] != component[right][None, :])


def block_links(sets: list[np.ndarray], component: np.ndarray, left: np.ndarray, right: np.ndarray, known: Components) -> None:
    """Link the sets of ``left`` with those of ``right``: sketches filter, and whole sets of the candidates are counted out."""
    sizes = np.array([len(s) for s in sets])
    maybe = sketch_candidates([s[:K] for s in sets], sizes, component, left, right)
    left, right = left[maybe.any(axis=1)], right[maybe.any(axis=0)]
    if not len(left):
        return
    used = np.union1d(left, right)
    common = common_values([sets[i] for i in used], np.searchsorted(used, left), np.searchsorted(used, right))
    linked = 100 * common >= LEAST * (sizes[left][:, None] + sizes[right][None, :] - common)
    for i, j in np.argwhere(linked & (component[left][:, None] != component[right][None, :])).tolist():
        known.join(int(component[left[i]]), int(component[right[j]]))


def _sets_of(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """The sets of the rows' texts, and which rows hold the class that they name (a repeated id may have other texts)."""
    column = table.column("text").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    sets = [s for chunk in C.text_chunks(column) for s in shingle_sets(chunk)]
    right = [len(s) > 0 and fingerprint(s) == fp for s, fp in zip(sets, table.column("fp").to_pylist(), strict=True)]
    return sets, np.flatnonzero(right)


def _link_table(known: Components) -> pa.Table:
    return pa.table([pa.array(x, pa.int64()) for x in (zip(*known.joined, strict=True) if known.joined else ([], []))], names=["a", "b"])


def links_within_blocks(rows: DataFrame) -> DataFrame:
    """(a, b): links of ids within each block of each group; as few as tell its components.

    Every class is compared with the centre first (estimate by the union's sketch, then exactly on whole sets); only
    blocks that this leaves in several components are counted out.
    """

    def run(table: pa.Table) -> pa.Table:
        sets, use = _sets_of(table)
        sets, ids, keys = [sets[i] for i in use], table.column("rep").to_numpy()[use], table.column("key").to_numpy()[use]
        known = Components()
        centre = np.flatnonzero(keys == table.column("centre")[0].as_py())
        if len(centre):
            star_links(sets, ids, int(centre[0]), known)
        if len({known.find(int(i)) for i in ids}) > 1:
            every = np.arange(len(sets))
            block_links(sets, np.array([known.find(int(i)) for i in ids]), every, every, known)
        return _link_table(known)

    return rows.groupBy("centre", "block").applyInArrow(run, "a long, b long")


def meeting_blocks(wide: DataFrame, most_classes: int, most_values: int) -> DataFrame:
    """The classes of groups in several components, for each pair (i, j) of blocks that meets.

    wide: (centre, key, n, rep, fp, component). Blocks hold about ``most_classes`` classes and ``most_values`` hashes. Those
    below ``own`` hold the group's largest component and don't meet each other, so a class of it is a row for each block
    of the others, and of a group with few others the rows are in proportion to the group.
    """
    by = wide.groupBy("centre", "component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"))
    best = by.groupBy("centre").agg(F.max_by("component", F.struct("k", F.negative("component"))).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    split = by.join(best.select("centre", "main"), "centre").groupBy("centre", "main").agg(
        *(F.greatest(F.lit(1), F.ceil(F.sum(F.when(side, F.col("k"))) / most_classes), F.ceil(F.sum(F.when(side, F.col("total"))) / most_values)).cast("int").alias(c) for c, side in (("own", F.col("component") == F.col("main")), ("others", F.col("component") != F.col("main"))))
    )
    rows = wide.join(split, "centre")
    is_main, of = F.col("component") == F.col("main"), F.xxhash64("key")
    block = F.when(is_main, F.pmod(of, F.col("own"))).otherwise(F.col("own") + F.pmod(of, F.col("others"))).cast("int")
    rows = rows.withColumn("block", block)
    met = F.when(is_main, F.sequence(F.col("own"), F.col("own") + F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("own") + F.col("others") - 1))
    each = rows.withColumn("other", F.explode(met))
    return each.select("centre", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "block", "n", "rep", "fp", "component")


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    block = table.column("block").to_numpy()
    return np.flatnonzero(block == table.column("i")[0].as_py()), np.flatnonzero(block == table.column("j")[0].as_py())


def links_across_blocks(rows: DataFrame) -> DataFrame:
    """(a, b): links of components between the blocks that meet."""

    def run(table: pa.Table) -> pa.Table:
        sets, use = _sets_of(table)
        sets, component = [sets[i] for i in use], table.column("component").to_numpy()[use]
        known = Components()
        if len(sets):
            block_links(sets, component, *_sides(table.take(pa.array(use))), known)
        return _link_table(known)

    return rows.groupBy("centre", "i", "j").applyInArrow(run, "a long, b long")


def candidates_across_blocks(rows: DataFrame) -> DataFrame:
    """The rows of ``meeting_blocks`` (with their sketch) that have a candidate in another component."""

    def run(table: pa.Table) -> pa.Table:
        lists = table.column("sketch").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        left, right = _sides(table)
        maybe = sketch_candidates([flat[ends[i] : ends[i + 1]] for i in range(table.num_rows)], table.column("n").to_numpy(), table.column("component").to_numpy(), left, right)
        found = np.unique(np.concatenate((left[maybe.any(axis=1)], right[maybe.any(axis=0)])))
        return table.select(["centre", "i", "j", "key", "block", "component", "rep", "fp"]).take(pa.array(found, pa.int64()))

    return rows.groupBy("centre", "i", "j").applyInArrow(run, "centre long, i int, j int, key long, block int, component long, rep long, fp binary")


def repeated_id_links(made: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): every id with several sets is linked with the smallest id of each of their classes."""
    several = made.filter("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("doc_id")
    each = made.filter("n > 0").select("doc_id", "fp").join(several, "doc_id").join(classes.select("fp", "rep"), "fp")
    return each.filter("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept of every document.

    Cases: null, empty and blank texts have no set and link with nothing; a text of fewer than five words has one
    shingle, so it links with equal texts only; rows that repeat a doc_id are one document, which has the links of
    each of its texts; a null doc_id never stands for a group: such a row takes the group's smallest id, or null
    where the group has none, and is kept then; a very long text has a set of all its shingles, and a sketch like
    others; of equal counts of values (ties) the smaller class is a group's centre; an empty table gives an empty
    result; only doc_id and text are read, so extra columns never clash.
    """
    made = scratch_table(sketches(docs), "sketches")
    classes = scratch_table(class_table(made), "classes")
    lists = scratch_table(inverted_lists(made, classes.filter("rep IS NOT NULL")), "lists")
    members = scratch_table(memberships(lists).join(classes, "key"), "members")
    links = scratch_table(links_within_blocks(named_texts(docs, members)).union(repeated_id_links(made, classes)), "links")
    labels = connected_components(links)
    # Groups of several blocks that are in several components yet
    wide = members.filter("blocks > 1").drop("block", "blocks").distinct().join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    meet = scratch_table(meeting_blocks(wide.withColumn("component", F.coalesce("component", "rep")), BLOCK_CLASSES, BLOCK_VALUES), "meeting")
    if not meet.isEmpty():
        own = made.select(F.col("doc_id").alias("rep"), "fp", "sketch").dropDuplicates(["rep", "fp"])
        near = scratch_table(candidates_across_blocks(meet.join(own, ["rep", "fp"])), "candidates")
        more = scratch_table(links_across_blocks(named_texts(docs, near)), "links")
        labels = connected_components(links.union(more))
    groups = classes.select("fp", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    by_row = made.select("doc_id", "n", "fp").join(groups, "fp", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    result = by_row.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
