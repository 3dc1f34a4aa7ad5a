"""Similarity join of documents on three-word shingles, with prefix filters under several global orders of the shingles.

Two sets with a similarity of LEAST hundredths share all but ``p - 1`` members of either, ``p = n - ceil(LEAST n / 100) + 1``.
So under any order of all shingles, of the first ``2 p`` members of a set ``p + 1`` are in the other, and ``p + 1`` of the
smaller set's are among the other's first (see ``least_shared``).

1. One pass over the texts gives sizes, 128-bit fingerprints of whole sets, and each set's first members by hash (the
   first order). Equal sets are one class from here on, so copies cost no pairs.
2. The same argument on these members, ordered from the rarest (the second order): similar sets share one of the first
   of these, and only they are looked up. Passages of many documents drop out unless they make up most of a document.
3. The classes of all lists with the same centre are a group, dealt in blocks of bounded size, each with the centre. In
   a block, pairs must share enough first members under the first order, and only the texts of classes that have such a
   partner move. There pairs must share enough under each of ORDERS, and what passes all orders is verified on whole
   sets. The centre is compared first, and only blocks that this leaves in several components are counted out.
4. Links are contracted. Groups of several blocks that still hold several components are dealt anew: classes of the
   group's largest component meet those of the others, and these meet each other, but never the largest itself; first
   by their first members, then the candidates by their texts. Nothing is capped and no pair is moved.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm import columnar as C
from chalkline.llm.frames import pick
from chalkline.llm.minhash import Components, class_table, common_values, fingerprint, meeting_blocks, named_texts, repeated_id_links
from chalkline.operators.components import connected_components
from chalkline.sources.scratch import scratch_table

SHINGLE = 3
#: Similarity in hundredths.
LEAST = 90
#: Salts of the orders by hash; the first is the order of the lists that are looked up.
ORDERS = (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Classes and shingles of a block, about.
BLOCK_CLASSES, BLOCK_VALUES = 512, 1 << 20


def prefix_size(n: int) -> int:
    return n - -(-LEAST * n // 100) + 1


def shingle_sets(chunk: C.Chunk) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    lowered = C.Chunk(chunk.first, C.LOWER[chunk.data], chunk.offsets)
    starts, ends, of = C.runs(lowered, C.NOT_WHITE)
    words = C.span_hashes(C.prefix_sums(lowered.data), starts, ends)
    grams = C.gram_hashes(words, SHINGLE)
    at = 0
    for stop in np.cumsum(np.bincount(of, minlength=len(chunk))).tolist():
        n = stop - at
        yield np.unique(grams[at : stop - SHINGLE + 1]) if n >= SHINGLE else C.gram_hashes(words[at:stop], n) if n else np.zeros(0, np.uint64)
        at = stop


def first_members(s: np.ndarray, order: int) -> np.ndarray:
    """The first ``2 p`` members of a sorted set under the order of this salt, or all."""
    k = 2 * prefix_size(len(s))
    if k >= len(s):
        return s
    if not order:
        return s[:k]
    return s[np.argpartition(C.mix(s ^ np.uint64(order)), k - 1)[:k]]


def least_shared(n: np.ndarray) -> np.ndarray:
    """Members that the lists of sets of ``n`` share with those of any similar set, at least.

    The list that ends first under the order has all of the other set's members up to there, so ``p + 1`` of it are in
    both lists, or all that the sets share if it is whole. Its ``p`` is that of a set of LEAST hundredths of ``n`` at least.
    """
    exact = -(-LEAST * n // 100)
    return np.minimum(exact, exact - -(-LEAST * exact // 100) + 2)


def as_lists(values: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat.view(np.int64)))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), fp and first members (first order) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, values = [], [], []
            for chunk in C.text_chunks(batch.column("text")):
                for s in shingle_sets(chunk):
                    sizes.append(len(s))
                    prints.append(fingerprint(s) if len(s) else None)
                    values.append(first_members(s, ORDERS[0]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(prints, pa.binary()), as_lists(values)], names=["doc_id", "n", "fp", "members"])

    return pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, n int, fp binary, members array<long>")


def lookups(made: DataFrame, classes: DataFrame) -> DataFrame:
    """(v, key, n, alone): the rarest first members of each class that others share; ``alone`` counts unshared ones."""
    named = made.join(classes.withColumnRenamed("rep", "doc_id"), ["fp", "doc_id"]).dropDuplicates(["fp", "doc_id"]).select("key", "n", "members")
    values = named.select("key", F.explode("members").alias("v"))
    shared = values.join(values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "v")
    each = shared.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs")).join(named.select("key", "n", F.size("members").alias("k")), "key")
    part = lambda n: -F.floor(n * -LEAST / 100)
    exact = part(F.col("n"))
    needed = F.least(exact, exact - part(exact) + 2)
    each = each.withColumn("alone", F.col("k") - F.size("vs")).withColumn("take", (F.col("k") - needed + 1 - F.col("alone")).cast("int")).filter("take > 0")
    return each.select("key", "n", "alone", F.explode(F.slice("vs", 1, F.col("take"))).alias("x")).select(F.col("x.v").alias("v"), "key", "n", "alone")


def groups_of(lists: DataFrame) -> DataFrame:
    """(centre, key, n, block, blocks): the classes of all lists with the same centre, in blocks that each hold the centre.

    The centre of a list is the class with the fewest unshared members, then the largest, then by its number.
    """
    centres = lists.groupBy("v").agg(F.min(F.struct("alone", F.negative("n").alias("m"), "key")).alias("c"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    members = lists.join(centres.select("v", F.col("c.key").alias("centre")), "v").select("centre", "key", "n").distinct()
    sizes = members.groupBy("centre").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("k") / BLOCK_CLASSES), F.ceil(F.col("total") / BLOCK_VALUES)).cast("int")
    dealt = members.join(sizes.select("centre", blocks.alias("blocks")), "centre")
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    every = F.when(F.col("key") == F.col("centre"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    return dealt.withColumn("block", F.explode(every))


def maybe_similar(lists: list[list[np.ndarray]], n: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairs of ``left`` and ``right`` whose sizes and first members under every order allow a link; lists[order][row]."""
    low, high = np.minimum(n[left][:, None], n[right][None, :]), np.maximum(n[left][:, None], n[right][None, :])
    out = 100 * low >= LEAST * high
    least = least_shared(n)
    for own in lists:
        if not out.any():
            break
        a, b = np.flatnonzero(out.any(axis=1)), np.flatnonzero(out.any(axis=0))
        used, at = np.unique(np.concatenate((left[a], right[b])), return_inverse=True)
        common = common_values([own[i] for i in used], at[: len(a)], at[len(a) :])
        out[np.ix_(a, b)] &= common >= np.maximum(least[left[a]][:, None], least[right[b]][None, :])
    return out


def link(sets: list[np.ndarray], names: np.ndarray, left: np.ndarray, right: np.ndarray, known: Components) -> None:
    """Join the components that a link of ``left`` and ``right`` connects: filters of all orders, then whole sets."""
    n = np.array([len(s) for s in sets], np.int64)
    root = np.array([known.find(int(x)) for x in names])
    maybe = maybe_similar([[first_members(s, o) for s in sets] for o in ORDERS], n, left, right)
    maybe &= root[left][:, None] != root[right][None, :]
    a, b = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
    if not len(a):
        return
    used, at = np.unique(np.concatenate((left[a], right[b])), return_inverse=True)
    common = common_values([sets[i] for i in used], at[: len(a)], at[len(a) :]).astype(np.int64)
    linked = maybe[np.ix_(a, b)] & (100 * common >= LEAST * (n[left[a]][:, None] + n[right[b]][None, :] - common))
    for i, j in np.argwhere(linked).tolist():
        known.join(int(names[left[a[i]]]), int(names[right[b[j]]]))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    joined = column.combine_chunks()
    return joined.chunk(0) if isinstance(joined, pa.ChunkedArray) else joined


def _sets_of(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """The sets of the rows' texts, and which rows hold the class that they name (a repeated id may have other texts)."""
    sets = [s for chunk in C.text_chunks(_whole(table.column("text"))) for s in shingle_sets(chunk)]
    right = [len(s) > 0 and fingerprint(s) == fp for s, fp in zip(sets, table.column("fp").to_pylist(), strict=True)]
    return sets, np.flatnonzero(right)


def _link_table(known: Components) -> pa.Table:
    return pa.table([pa.array(x, pa.int64()) for x in (zip(*known.joined, strict=True) if known.joined else ([], []))], names=["a", "b"])


def links_within_blocks(rows: DataFrame) -> DataFrame:
    """(a, b): links of ids within each block of each group; as few as tell its components."""

    def run(table: pa.Table) -> pa.Table:
        sets, use = _sets_of(table)
        sets, ids, keys = [sets[i] for i in use], table.column("rep").to_numpy()[use], table.column("key").to_numpy()[use]
        known, every = Components(), np.arange(len(sets))
        centre = np.flatnonzero(keys == table.column("centre")[0].as_py())
        if len(centre):
            link(sets, ids, centre[:1], every, known)
        if len({known.find(int(i)) for i in ids}) > 1:
            link(sets, ids, every, every, known)
        return _link_table(known)

    return rows.groupBy("centre", "block").applyInArrow(run, "a long, b long")


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    block = table.column("block").to_numpy()
    return np.flatnonzero(block == table.column("i")[0].as_py()), np.flatnonzero(block == table.column("j")[0].as_py())


def with_candidates(rows: DataFrame) -> DataFrame:
    """The rows (centre, i, j, key, block, n, component, rep, fp, members) that have a partner of another component.

    A partner is in the other one of the blocks i and j (or in the same, if they are one) and shares enough first members.
    """
    names = ["centre", "i", "j", "key", "block", "component", "rep", "fp"]

    def run(table: pa.Table) -> pa.Table:
        lists = _whole(table.column("members"))
        flat, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        first = [flat[ends[i] : ends[i + 1]] for i in range(table.num_rows)]
        left, right = _sides(table)
        component = table.column("component").to_numpy()
        maybe = maybe_similar([first], table.column("n").to_numpy().astype(np.int64), left, right)
        maybe &= component[left][:, None] != component[right][None, :]
        found = np.unique(np.concatenate((left[maybe.any(axis=1)], right[maybe.any(axis=0)])))
        return table.select(names).take(pa.array(found, pa.int64()))

    return rows.groupBy("centre", "i", "j").applyInArrow(run, "centre long, i int, j int, key long, block int, component long, rep long, fp binary")


def links_across_blocks(rows: DataFrame) -> DataFrame:
    """(a, b): links of components between the blocks that meet."""

    def run(table: pa.Table) -> pa.Table:
        sets, use = _sets_of(table)
        sets, component = [sets[i] for i in use], table.column("component").to_numpy()[use]
        known = Components()
        if len(sets):
            link(sets, component, *_sides(table.take(pa.array(use))), known)
        return _link_table(known)

    return rows.groupBy("centre", "i", "j").applyInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every document.

    Cases: null, empty and blank texts have no set and link with nothing; a text of fewer than three words has one
    shingle, so it links with equal texts only; rows that repeat a doc_id are one document, which has the links of
    each of its texts; a null doc_id never stands for a group: such a row takes the group's smallest id, or null
    where the group has none; a very long text has a set of all its shingles; a similarity of exactly LEAST hundredths
    links; ties of a list's centre go to the smaller class; an empty table gives an empty result; only doc_id and text
    are read, so extra columns never clash.
    """
    made = scratch_table(signatures(docs), "signatures")
    classes = scratch_table(class_table(made), "classes")
    lists = scratch_table(lookups(made, classes.filter("rep IS NOT NULL")), "lists")
    members = scratch_table(groups_of(lists).join(classes, "key"), "members")
    first = made.select(F.col("doc_id").alias("rep"), "fp", "members").dropDuplicates(["rep", "fp"])
    own = members.join(first, ["rep", "fp"]).withColumns({"i": F.col("block"), "j": F.col("block"), "component": F.col("key")})
    near = scratch_table(with_candidates(own), "candidates")
    links = scratch_table(links_within_blocks(named_texts(docs, near)).union(repeated_id_links(made, classes)), "links")
    labels = connected_components(links)
    wide = members.filter("blocks > 1").drop("block", "blocks").distinct().join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    meet = scratch_table(meeting_blocks(wide.withColumn("component", F.coalesce("component", "rep")), BLOCK_CLASSES, BLOCK_VALUES), "meeting")
    if not meet.isEmpty():
        near = scratch_table(with_candidates(meet.join(first, ["rep", "fp"])), "candidates")
        more = scratch_table(links_across_blocks(named_texts(docs, near)), "links")
        labels = connected_components(links.union(more))
    groups = classes.select("fp", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return made.select("doc_id", "n", "fp").join(groups, "fp", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))
