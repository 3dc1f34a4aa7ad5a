"""The prefix trie of conversations that are rebuilt on the opening turns of a shared conversation.

1. Distinct turns (role and text) get numbers from a dictionary, by their SHA-256, so no text moves. Conversations are
   rebuilt on these numbers.
2. A turn that no other conversation has at its place ends what a conversation shares: behind it every node has one
   member, and these tails are rows that need no sorting. Conversations with equal numbers are one class.
3. The classes are dealt by most significant digit: a bucket holds the classes that share their first turns. What all
   classes of a large bucket share further is found from its smallest and largest sequence, and is one chain of nodes;
   the turn behind it is the digit by which the bucket is split in a round. Buckets of LOCAL classes or fewer are
   finished in tasks: multikey quicksort splits their classes turn by turn and emits a chain of nodes for each group.
4. Leaves and saved tokens of the nodes above are added up from the last round to the first.

A chain is a row: the nodes of depths ``lo`` to ``hi`` that have the same members. A node is known by its smallest
member and its depth.
"""

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm.frames import pick
from chalkline.sources.scratch import scratch_table

#: Conversation ``c`` opens with turns of conversation ``c - c % FAMILY``, of which it takes crc32(c) % OPENINGS.
FAMILY, OPENINGS = 100, 6
#: Classes of a bucket that a task finishes.
LOCAL = 4096
#: Ids of a piece of a member list are of a range of 2**PIECE_BITS.
PIECE_BITS = 16


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, i, digest, n): the turns of each conversation from 1 on, with their code points."""
    turns = pick(conversations, "conv_id", "turn", "role", "text").filter("conv_id IS NOT NULL")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = turns.select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), digest.alias("digest"), F.char_length(text).cast("long").alias("n"))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    return turns.select("conv", F.row_number().over(order).cast("long").alias("i"), "digest", "n")


def encoded_turns(conversations: DataFrame) -> DataFrame:
    """(conv, i, id, n): digests replaced by the numbers of a written dictionary."""
    turns = scratch_table(numbered_turns(conversations), "turns")
    dictionary = turns.select("digest").distinct().select("digest", F.monotonically_increasing_id().alias("id"))
    return scratch_table(turns.join(scratch_table(dictionary, "dictionary"), "digest").select("conv", "i", "id", "n"), "encoded")


def rebuilt_turns(encoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, id, n) of the rebuilt conversations, and (conv, total) of all, also those without turns."""
    own = encoded.groupBy("conv").agg(F.max("i").alias("own"))
    base, h = F.col("conv") - F.col("conv") % FAMILY, F.crc32(F.col("conv").cast("string").cast("binary")) % OPENINGS
    first = own.filter(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("base"), F.col("own").alias("of_base"))
    convs = own.select("conv", "own", base.alias("base"), h.alias("h")).join(first, "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("of_base", F.lit(0).cast("long"))))
    convs = scratch_table(convs.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total")), "conversations")
    rest = encoded.join(convs, "conv").filter("i > h").select("conv", (F.col("i") - F.col("h") + F.col("taken")).alias("pos"), "id", "n")
    opening = encoded.filter((F.col("conv") % FAMILY == 0) & (F.col("i") < OPENINGS)).withColumnRenamed("conv", "base")
    opening = opening.join(convs.filter("taken > 0"), "base").filter("i <= taken").select("conv", F.col("i").alias("pos"), "id", "n")
    return rest.union(opening), convs.select("conv", "total")


def shared_heads(rebuilt: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, ids, sizes, total): the turns up to the first that no other conversation has at its place; the turns behind."""
    rebuilt = scratch_table(rebuilt, "rebuilt")
    alone = rebuilt.groupBy("pos", "id").agg(F.count(F.lit(1)).alias("k"), F.min("conv").alias("conv")).filter("k = 1")
    cuts = convs.join(alone.groupBy("conv").agg(F.min("pos").alias("cut")), "conv", "left").withColumn("cut", F.coalesce("cut", "total"))
    marked = scratch_table(rebuilt.join(cuts, "conv"), "marked")
    turn = F.array_sort(F.collect_list(F.struct("pos", "id", "n")))
    heads = marked.filter("pos <= cut").groupBy("conv").agg(turn.alias("t")).select("conv", F.col("t.id").alias("ids"), F.col("t.n").alias("sizes"))
    none = F.array().cast("array<long>")
    heads = convs.join(heads, "conv", "left").select("conv", F.coalesce("ids", none).alias("ids"), F.coalesce("sizes", none).alias("sizes"), "total")
    return scratch_table(heads, "heads"), marked.filter("pos > cut").select("conv", "pos", "total")


# --- finishing buckets in tasks ------------------------------------------------------------------------------------


class Sequence(NamedTuple):
    ids: list[int]
    sizes: list[int]
    conv: int
    m: int
    total: int


def by_turn(rows: list[Sequence], d: int) -> Iterator[list[Sequence]]:
    """The groups of rows with the same turn at place ``d``, in order: three-way partitioning around a pivot."""
    stack = [(rows, False)]
    while stack:
        part, equal = stack.pop()
        if equal or len(part) == 1:
            yield part
            continue
        pivot = part[len(part) // 2].ids[d]
        low, same, high = [], [], []
        for r in part:
            x = r.ids[d]
            (same if x == pivot else low if x < pivot else high).append(r)
        stack += [(p, e) for p, e in ((high, False), (same, True), (low, False)) if p]


def chains(rows: list[Sequence], top: int, parent: int | None) -> list[list]:
    """[conv, lo, hi, parent, n_convs, n_children, n_leaves, saved, below, ends, m, is_top] of each chain of a bucket.

    ``saved`` has the tokens that the nodes of the chain save from each depth on, ``below`` those of their descendants;
    ``ends`` is the class that ends at ``hi`` and ``m`` its members.
    """
    out, above = [], []
    todo = [(rows, top, parent, -1)]
    while todo:
        rows, lo, parent, at = todo.pop()
        ids, hi = rows[0].ids, lo
        if len(rows) == 1:
            hi = len(ids)
        while len(rows) > 1 and hi < len(ids) and all(len(r.ids) > hi and r.ids[hi] == ids[hi] for r in rows):
            hi += 1
        ended = [r for r in rows if len(r.ids) == hi]
        groups = list(by_turn([r for r in rows if len(r.ids) > hi], hi)) if len(rows) > len(ended) else []
        n, conv = sum(r.m for r in rows), min(r.conv for r in rows)
        saved, total = [], 0
        for d in range(hi, lo - 1, -1):
            total += (n - 1) * (rows[0].sizes[d - 1] if d else 0)
            saved.append(total)
        tail = bool(ended) and ended[0].total > hi
        end = ended[0] if ended and not tail else None
        out.append([conv, lo, hi, parent, n, len(groups) + tail, 0 if groups else 1, saved[::-1], 0, end and end.conv, end.m if end else 0, at < 0])
        above.append(at)
        todo += [(g, hi + 1, conv, len(out) - 1) for g in groups]
    for i in range(len(out) - 1, -1, -1):
        if above[i] >= 0:
            up = out[above[i]]
            up[6] += out[i][6]
            up[8] += out[i][8] + out[i][7][0]
    return out


_CHAIN = "conv long, lo long, hi long, parent long, n_convs long, n_children long, n_leaves long, saved array<long>, below long, ends long, m long, is_top boolean"
_CHAIN_TYPES = {"saved": pa.list_(pa.int64()), "is_top": pa.bool_()}


def local_chains(rows: DataFrame, packs: int) -> DataFrame:
    """The chains of all buckets of ``rows``; a task takes a pack of buckets."""
    names = [x.split()[0] for x in _CHAIN.split(", ")]

    def run(pack: pa.Table) -> pa.Table:
        pack = pack.sort_by([("bucket", "ascending"), ("top", "ascending")])
        columns = [pack.column(c).to_pylist() for c in ("bucket", "top", "parent", "ids", "sizes", "conv", "m", "total")]
        made, at, keys = [], 0, list(zip(*columns[:3], strict=True))
        sequences = [Sequence(*r) for r in zip(*columns[3:], strict=True)]
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[at]:
                made += chains(sequences[at:i], keys[at][1], keys[at][2])
                at = i
        return pa.table([pa.array([r[k] for r in made], _CHAIN_TYPES.get(name, pa.int64())) for k, name in enumerate(names)], names=names)

    return rows.withColumn("pack", F.pmod(F.xxhash64("bucket", "top"), F.lit(packs))).groupBy("pack").applyInArrow(run, _CHAIN)


# --- dealing large buckets -----------------------------------------------------------------------------------------


def split_round(rows: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chains of the large buckets, and their classes in buckets by the turn behind the chain."""
    rows = rows.join(large, ["bucket", "top"])
    ends = rows.groupBy("bucket", "top", "parent").agg(F.min(F.struct("ids", "sizes")).alias("lo"), F.max("ids").alias("hi"), F.sum("m").alias("n_convs"))
    differ = F.expr("array_position(transform(sequence(1, least(size(lo.ids), size(hi))), i -> lo.ids[i - 1] <> hi[i - 1]), true)")
    short = F.least(F.size("lo.ids"), F.size("hi"))
    common = F.when(short == 0, 0).otherwise(F.when(differ > 0, differ - 1).otherwise(short)).cast("long")
    stats = scratch_table(ends.withColumn("common", common).withColumn("size", F.expr("slice(lo.sizes, cast(greatest(top, 1) as int), cast(common - greatest(top, 1) + 1 as int))")).drop("lo", "hi"), "buckets")
    rows = rows.join(stats.select("bucket", "top", "common"), ["bucket", "top"]).withColumn("digit", F.expr("try_element_at(ids, cast(common + 1 as int))"))
    made = scratch_table(rows.filter("digit IS NOT NULL").groupBy("bucket", "top", "digit").agg(F.min("conv").alias("child")), "digits")
    ended = rows.filter("digit IS NULL").select("bucket", "top", F.col("conv").alias("ends"), F.col("m").alias("m"))
    kids = made.groupBy("bucket", "top").agg(F.count(F.lit(1)).alias("n_children"))
    upper = stats.join(kids, ["bucket", "top"]).join(ended, ["bucket", "top"], "left").withColumn("m", F.coalesce("m", F.lit(0).cast("long")))
    sizes = F.when(F.col("top") == 0, F.concat(F.array(F.lit(0).cast("long")), "size")).otherwise(F.col("size"))
    saved = F.expr("transform(sequence(1, size(sizes)), i -> (n_convs - 1) * aggregate(slice(sizes, i, size(sizes)), 0L, (a, x) -> a + x))")
    upper = upper.withColumn("sizes", sizes).withColumn("saved", saved)
    upper = upper.select(F.col("bucket").alias("conv"), F.col("top").alias("lo"), F.col("common").alias("hi"), "parent", "n_convs", "n_children", "saved", "ends", "m")
    below = rows.filter("digit IS NOT NULL").join(made, ["bucket", "top", "digit"])
    below = below.select(F.col("child").alias("bucket"), (F.col("common") + 1).alias("top"), F.col("bucket").alias("parent"), "conv", "m", "ids", "sizes", "total")
    return scratch_table(upper, "upper"), scratch_table(below, "rows")


def all_chains(classes: DataFrame) -> DataFrame:
    """The chains of the trie over ``classes`` (ids, sizes, total, conv, m)."""
    n, least = classes.agg(F.count(F.lit(1)), F.min("conv")).first()
    rows = classes.select(F.lit(least).cast("long").alias("bucket"), F.lit(0).cast("long").alias("top"), F.lit(None).cast("long").alias("parent"), "conv", "m", "ids", "sizes", "total")
    small, uppers = [], []
    large_classes = n
    while large_classes:
        sizes = scratch_table(rows.groupBy("bucket", "top").agg(F.count(F.lit(1)).alias("k")), "bucket-sizes")
        large = sizes.filter(F.col("k") > LOCAL).select("bucket", "top")
        large_classes = sizes.filter(F.col("k") > LOCAL).agg(F.sum("k")).first()[0] or 0
        small.append(rows.join(sizes.filter(F.col("k") <= LOCAL).select("bucket", "top"), ["bucket", "top"]) if large_classes else rows)
        if large_classes:
            upper, rows = split_round(rows, large)
            uppers.append(upper)
    left = small[0] if small else rows
    for s in small[1:]:
        left = left.union(s)
    done = local = scratch_table(local_chains(left, max(1, -(-n // LOCAL))), "chains")
    tops = local.filter("is_top")
    for upper in reversed(uppers):
        sums = tops.groupBy(F.col("parent").alias("conv"), (F.col("lo") - 1).alias("hi")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum(F.col("below") + F.col("saved")[0]).alias("below"))
        upper = scratch_table(upper.join(sums, ["conv", "hi"]).select(*(c for c in local.columns if c != "is_top"), F.lit(True).alias("is_top")), "upper")
        done, tops = done.union(upper), upper
        tops = tops.union(local.filter("is_top"))
    return done


def member_hashes(heads: DataFrame, classes: DataFrame) -> DataFrame:
    """(ends, sha): the hash of the members' list of each class of several.

    Lists are made in pieces of an id range and hashed one after the other, so no list is held whole.
    """
    several = classes.filter("m > 1").select("ids", "total", F.col("conv").alias("ends"))
    members = heads.select("ids", "total", "conv").join(several, ["ids", "total"]).select("ends", "conv", F.shiftright("conv", PIECE_BITS).alias("piece"))
    pieces = members.groupBy("ends", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("listed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        made = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([state.hexdigest()])], names=["ends", "sha"])
        for batch in batches:
            for ends, listed in zip(batch.column("ends").to_pylist(), batch.column("listed").to_pylist(), strict=True):
                if ends != key:
                    if key is not None:
                        yield made()
                    key, state = ends, hashlib.sha256(listed.encode())
                else:
                    state.update(b"," + listed.encode())
        if key is not None:
            yield made()

    return pieces.repartition("ends").sortWithinPartitions("ends", "piece").select("ends", "listed").mapInArrow(run, "ends long, sha string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    Cases: a null conv_id is no conversation; of turns with the same number (or none) the smaller role and then the
    smaller SHA-256 of role and text comes first, and repeated rows are turns of their own; null and empty role or text
    are the same; a conversation that loses all its turns is a member of the root only; very long conversations move
    as rows, of which only what others share at the same places becomes a list; copies are one class; an empty table
    has no root; only conv_id, turn, role and text are read, so extra columns never clash.
    """
    rebuilt, convs = rebuilt_turns(encoded_turns(conversations))
    heads, tails = shared_heads(rebuilt, convs)
    classes = scratch_table(heads.groupBy("ids", "sizes", "total").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("m")), "classes")
    hashed = all_chains(classes).join(member_hashes(heads, classes), "ends", "left")
    sha = lambda x: F.sha2(x.cast("string").cast("binary"), 256)
    none = F.sha2(F.lit("").cast("binary"), 256)
    each = hashed.select("*", F.posexplode("saved").alias("k", "here")).withColumn("depth", F.col("lo") + F.col("k"))
    last = F.col("depth") == F.col("hi")
    nodes = each.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("k") == 0, F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"),
        "n_leaves",
        (F.col("below") + F.col("here")).alias("saved_tokens"),
        F.when(last & (F.col("m") > 1), F.col("sha")).when(last & (F.col("m") == 1), sha(F.col("ends"))).otherwise(none).alias("ends_sha256"),
    )
    ended, one = F.col("pos") == F.col("total"), F.lit(1).cast("long")
    tail = tails.select(F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), F.col("conv").alias("parent_conv_id"), one.alias("n_convs"), F.when(ended, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(ended, sha(F.col("conv"))).otherwise(none).alias("ends_sha256"))
    return nodes.union(tail)
