"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

1. Targets: sources share ``share`` times all words by weight; none gets more than ``max_epochs`` times its own
   words, and the excess is shared again by weight until none is above (water filling; a round is one aggregate
   over a row for each source).
2. Streams: the documents of a source stand in a shuffled order (by a digest of seed and id); their words form
   one stream, repeated for further epochs, up to the target. The stream is cut into blocks of ``block_words`` words.
3. Schedule: with N blocks to place, slot n lies at the golden-ratio point n * F' / F, where F is the least Fibonacci
   number of N or more and F' the one before it (the best fractions of the golden ratio, so points are exact whole
   numbers and no two meet). The sources' cumulative block counts map a point to a source; points beyond N are
   empty slots. Slots are ranked within their source, and the k-th one takes the source's block k.
4. The mix is the inner join of slots and blocks: a document is taken by the slots that its words fall into, in
   their order, and nothing else takes it. Any stretch of the mix holds every source in close to its share, so a mix
   that stops after ``n_slots`` slots does so, too.

Running sums are taken in two levels (within buckets, then over the buckets' sums), so a source with a third of all
rows is spread over thousands of window groups, and so are many sources. Sources, and the cells that point to them,
are broadcast up to BROADCAST_BYTES, which is checked, and joined by shuffle beyond.

Cases: null and empty text has size 0 and is never taken (its first_slot is null); a very long text is spread over
many blocks, and so over tasks; null source is a source, ordered last; null ids are shuffled together by size;
ties of digests are ordered by id, size and row; repeated rows count once each; a source without words has target
0; an empty table gives an empty mix; only doc_id, source and text are read, so extra columns never clash.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm.frames import pick
from chalkline.sources.scratch import scratch_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 1024
#: Bytes of a table of sources that is broadcast, at most.
BROADCAST_BYTES = 8 << 20


def sizes(docs: DataFrame, text: str = "text") -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def running_sum(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of ``keys`` before this one, by bucket and then ``order``."""
    own = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    joined = df.withColumn(out, F.sum(value).over(own) - value).join(sums, [*keys, bucket])
    return joined.withColumn(out, F.col(out) + F.col("__before")).drop("__before")


def _checked(df: DataFrame, size: int) -> DataFrame:
    """Broadcast if its ``size`` in bytes allows."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df.hint("merge")


def source_targets(sized: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 2) -> DataFrame:
    """A row for each source: ``sid`` (its rank by code point, null last), source_size, weight and target; a written table."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = scratch_table(by.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    ranked = running_sum(ordered, [], "part", [F.col("source").asc_nulls_last()], F.lit(1).cast("long"), "before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("before") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.select("source", "source_size", "part", (F.col("before") + 1).alias("sid"), weight.alias("weight"), (F.col("source_size") * max_epochs).alias("cap"))
    ranked = scratch_table(ranked, "ranked-sources")
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("weight")
        n, spent, open_, words = ranked.agg(F.count_if(over), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))), F.sum("source_size")).first()
        if n == capped or not open_:
            break
        level, capped = (share * (words or 0) - (spent or 0)) / open_, n
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    return scratch_table(ranked.withColumn("target", target).drop("cap"), "targets")


def golden_fractions(n: int) -> tuple[int, int]:
    """The least Fibonacci number of ``n`` or more, and the one before it."""
    before, number = 1, 2
    while number < n:
        before, number = number, before + number
    return number, before


def slots(targets: DataFrame, block_words: int, n_slots: int | None = None) -> DataFrame:
    """(slot, sid, block): the schedule, up to slot ``n_slots``.

    A slot finds its source by an equal join on cells of points, about four for each source, then the bounds within the
    cell, so the rows that meet are at most about 1.25 for each slot, however sources are spread.
    """
    blocks = F.ceil(F.round("target") / block_words).cast("long")
    counted = targets.withColumn("blocks", blocks).filter("blocks > 0")
    n, sources = counted.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.count(F.lit(1))).first()
    number, before = golden_fractions(n)
    cells = max(4096, 4 * sources)
    width = max(1, -(-n // cells))
    bounds = running_sum(counted.select("sid", "part", "blocks"), [], "part", [F.col("sid")], F.col("blocks"), "lo").withColumn("hi", F.col("lo") + F.col("blocks"))
    placed = bounds.select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    each = targets.sparkSession.range(0, min(number, n_slots if n_slots is not None else number)).withColumnRenamed("id", "slot")
    wide = "long" if number < 1 << 31 else "decimal(19,0)"
    point = F.pmod(F.col("slot").cast(wide) * F.lit(before).cast(wide), F.lit(number).cast(wide)).cast("long")
    each = each.withColumn("x", point).filter(F.col("x") < n).withColumn("cell", F.floor(F.col("x") / width))
    found = each.join(_checked(placed, 32 * (sources + cells)), "cell").filter("x >= lo AND x < hi").select("slot", "sid", F.shiftright("slot", max(4, number.bit_length() // 2)).alias("lot"))  # as many lots as slots of a lot
    return running_sum(found, ["sid"], "lot", [F.col("slot")], F.lit(1).cast("long"), "block").select("slot", "sid", "block")


def streams(sized: DataFrame, targets: DataFrame, seed: str = "mix") -> DataFrame:
    """Every document with its source's row and ``start``, its place in the source's shuffled word stream."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    size = targets.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64), F.lit(0))).first()[0]
    named = _checked(targets.withColumnRenamed("source", "__source").drop("part"), size)
    docs = sized.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    docs = docs.withColumn("digest", digest).withColumn("bucket", F.substring("digest", 1, 3))
    return running_sum(docs, ["sid"], "bucket", [F.col("digest"), F.col("doc_id"), F.col("size"), F.col("row")], F.col("size"), "start").drop("digest", "bucket")


def pieces(stream: DataFrame, block_words: int, max_epochs: int = 2) -> DataFrame:
    """The parts of documents that fall into blocks: epoch, block, and the words ``lo .. hi`` of the document."""
    taken = F.round("target").cast("long")
    epochs = stream.filter("size > 0").withColumn("epoch", F.explode(F.array(*map(F.lit, range(max_epochs)))))
    epochs = epochs.withColumn("__from", F.col("epoch") * F.col("source_size") + F.col("start")).withColumn("__to", F.least(F.col("__from") + F.col("size"), taken)).filter("__to > __from")
    each = epochs.withColumn("block", F.explode(F.sequence(F.floor(F.col("__from") / block_words), F.floor((F.col("__to") - 1) / block_words))))
    lo, hi = F.greatest(F.col("block") * block_words, F.col("__from")), F.least((F.col("block") + 1) * block_words, F.col("__to"))
    return each.withColumn("lo", lo - F.col("__from")).withColumn("hi", hi - F.col("__from")).drop("__from", "__to")


def schedule(stream: DataFrame, targets: DataFrame, block_words: int = BLOCK_WORDS, max_epochs: int = 2, n_slots: int | None = None) -> DataFrame:
    """The mix: a row for each part of a document, with the slot that takes it."""
    return pieces(stream, block_words, max_epochs).join(slots(targets, block_words, n_slots), ["sid", "block"])


def mix_sources(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 2, block_words: int = BLOCK_WORDS, seed: str = "mix", n_slots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, mix). Documents: row, doc_id, source, size, source_size, target, taken, first_slot. Mix: the rows of ``schedule``.

    The texts are read once, to count words; all later steps use the written (row, doc_id, source, size).
    """
    read = pick(docs, "doc_id", "source", "text")
    sized = scratch_table(read.select("doc_id", "source", sizes(read).alias("size"), F.monotonically_increasing_id().alias("row")), "sizes")
    targets = source_targets(sized, share, weights, max_epochs)
    stream = scratch_table(streams(sized, targets, seed), "streams")
    mix = scratch_table(schedule(stream, targets, block_words, max_epochs, n_slots).select("slot", "sid", "block", "row", "doc_id", "epoch", "lo", "hi"), "mix")
    taken = mix.groupBy("row").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"), F.min("slot").alias("first_slot"))
    result = stream.join(taken, "row", "left").select("row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
    return result, mix
