"""Practice: attempts, progress, grading, objectives and the checks of drafted questions."""

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chalkline.functions import text as X
from chalkline.sources.scratch import scratch_table

MAX_SUBMITS = 3
# Hints by kind of question, for the first and the second wrong answer, in English and Chinese.
HINTS_EN = {
    "multiple_choice": ("Review the cited textbook section before choosing an option.", "Compare each option with the wording and examples in the cited section."),
    "true_false": ("Find the relevant statement in the cited textbook section.", "Check whether every part of the statement agrees with the cited section."),
    "fill_blank": ("Look at the context around the blank and the cited section.", "Check the grammar and exact term used in the cited textbook section."),
    "short_answer": ("Review the visible rubric and the cited textbook section.", "Address each visible rubric criterion with evidence from the cited section."),
}
HINTS_ZH = {
    "multiple_choice": ("先阅读引用的教材段落后再选择选项。", "逐一对照选项与教材中的表述和例子。"),
    "true_false": ("在引用的教材段落中找到相关表述。", "检查题目中的每一部分是否都与教材一致。"),
    "fill_blank": ("结合空格前后的语境及引用的教材段落思考。", "检查语法并寻找教材使用的准确词语。"),
    "short_answer": ("对照可见的评分标准和引用的教材段落。", "尝试用教材证据逐项回应评分标准。"),
}
#: Buckets (as a power of 2) in which values are counted, and of bitmaps of classes.
COUNT_BITS, BITMAP_BITS = 23, 25
#: Lists of a value that more classes have are dealt in blocks of so many, about.
LIST, BLOCK_CLASSES = 1 << 16, 1 << 15
#: Entries of lists that meet in a task, about; pairs whose whole sets do; tasks at least; numbers that are handled in a step.
PART_VALUES, PAIRS, PARTS, STEP = 1 << 22, 1 << 15, 8, 1 << 20


def set_progress(exercises: DataFrame, attempts: DataFrame) -> DataFrame:
    """A row for each set: totals, first open exercise, latest activity, mastery ratio and status.

    ``exercises`` (set_id, exercise_id, ordinal); ``attempts`` (set_id, exercise_id, attempt_number, action, correct,
    created_at). Two aggregations on (set, exercise) and set; sets without attempts stay.
    """
    per = attempts.groupBy("set_id", "exercise_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.coalesce("correct", F.lit(False))).alias("is_correct"),
        F.bool_or((F.col("action") == "give_up") | F.coalesce(~F.col("correct") & (F.col("attempt_number") >= MAX_SUBMITS), F.lit(False))).alias("closed"),
        F.max("created_at").alias("latest"),
    )
    each = exercises.join(per, ["set_id", "exercise_id"], "left")
    is_correct = F.coalesce("is_correct", F.lit(False))
    done = is_correct | F.coalesce("closed", F.lit(False))
    sets = each.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("n").isNotNull()).alias("attempted"),
        F.count_if(done).alias("completed"),
        F.count_if(is_correct).alias("correct"),
        F.min(F.when(~done, F.struct("ordinal", "exercise_id")))["exercise_id"].alias("next_exercise"),
        F.max("latest").alias("latest"),
    )
    status = F.when(F.col("completed") == F.col("total"), "COMPLETED").when(F.col("latest").isNotNull(), "IN_PROGRESS").otherwise("NOT_STARTED")
    return sets.withColumn("mastery", F.when(F.col("completed") > 0, F.round(F.col("correct") / F.col("completed"), 3))).withColumn("status", status)


def plan_rollup(sets: DataFrame) -> DataFrame:
    """Sums and status of each plan's sets, with the share of its modules' correct answers."""
    status = F.when(F.sum("completed") == F.sum("total"), "COMPLETED").when(F.sum("attempted") > 0, "IN_PROGRESS").otherwise("NOT_STARTED")
    return sets.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("n_sets"), F.sum("total").alias("total"), F.sum("completed").alias("completed"), F.sum("correct").alias("correct"),
        F.round(F.sum("correct") / F.nullif(F.sum("completed"), F.lit(0)), 3).alias("mastery"), F.max("latest").alias("latest"), status.alias("status"),
    )


def mastery_band(correct: Column, completed: Column) -> Column:
    return F.when((completed > 0) & (correct / completed >= 0.8), "confident").when(completed > 0, "developing").otherwise("starting")


def resume_order(sets: DataFrame, cursors: DataFrame) -> DataFrame:
    """Open sets of a learner: the cursor's set first, then by latest activity and id, both descending."""
    marked = sets.filter("status <> 'COMPLETED'").join(cursors.select("user_id", F.col("set_id").alias("cursor")), "user_id", "left")
    order = Window.partitionBy("user_id").orderBy(F.coalesce(F.col("set_id") == F.col("cursor"), F.lit(False)).desc(), F.desc_nulls_last("latest"), F.desc("set_id"))
    return marked.withColumn("place", F.row_number().over(order).cast("long")).drop("cursor")


def replay_attempts(requests: DataFrame) -> DataFrame:
    """``outcome`` of requests (user, exercise, at, key, digest, action, correct) in order: accepted, replay, conflict or closed.

    A repeated key is a replay if its digest is that of its first request, else a conflict. Of the others an exercise
    accepts those before it closes, by a give-up, a right answer or its third submission.
    """
    same = Window.partitionBy("user_id", "exercise_id", "key").orderBy("at", "request_id")
    marked = requests.withColumn("__first", F.first("digest").over(same)).withColumn("__n", F.row_number().over(same))
    fresh = F.col("__n") == 1
    before = Window.partitionBy("user_id", "exercise_id").orderBy("at", "request_id").rowsBetween(Window.unboundedPreceding, -1)
    ends = fresh & ((F.col("action") == "give_up") | F.coalesce("correct", F.lit(False)))
    ended = F.coalesce(F.max(ends).over(before), F.lit(False))
    submits = F.coalesce(F.sum(F.when(fresh & (F.col("action") == "submit"), 1).otherwise(0)).over(before), F.lit(0))
    outcome = F.when(~fresh & (F.col("digest") == F.col("__first")), "replay").when(~fresh, "conflict").when(ended | (submits >= MAX_SUBMITS), "closed").otherwise("accepted")
    return marked.withColumn("outcome", outcome).drop("__first", "__n")


def rubric_score(weights: Column, scores: Column, threshold: Column) -> tuple[Column, Column]:
    """(weighted score over weights scaled to 1, three digits; does it pass?)"""
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    score = F.round(F.aggregate(F.zip_with(weights, scores, lambda w, x: w * x), F.lit(0.0), lambda s, x: s + x) / total, 3)
    return score, score >= threshold


def grade(kind: Column, answer: Column, expected: Column, acceptable: Column) -> Column:
    """Objective grading: identity for choices and booleans, membership in compatibility form and folded for blanks, else null."""
    given = F.array_contains(X.nfkc_casefold_all(acceptable), X.nfkc_casefold(answer))
    return F.when(kind.isin("true_false", "multiple_choice"), answer == expected).when(kind == "fill_blank", given)


def release_policy(n_submits: Column, gave_up: Column, correct: Column) -> Column:
    """What a learner sees: solution when released (give-up or third wrong answer) or right, else the next hint."""
    released = gave_up | (~correct & (n_submits >= MAX_SUBMITS))
    return F.when(correct | released, "solution").when(n_submits >= 2, "hint_2").when(n_submits == 1, "hint_1").otherwise("none")


def hint(kind: Column, language: Column, submitted_wrong: Column) -> Column:
    """The hint after the first or second wrong answer, in the question's language (both where it is bilingual); else null."""

    def of(table: dict) -> Column:
        entries = F.create_map(*(x for k, hints in table.items() for x in (F.lit(k), F.array(*map(F.lit, hints)))))
        return F.when(submitted_wrong.between(1, 2), F.try_element_at(F.try_element_at(entries, kind), submitted_wrong.cast("int")))

    return F.when(language == "zh", of(HINTS_ZH)).when(language == "en", of(HINTS_EN)).otherwise(F.concat(of(HINTS_ZH), F.lit(" / "), of(HINTS_EN)))


def outcome(action: Column, provisional: Column, correct: Column) -> Column:
    """What a learner is told of an attempt."""
    return F.when(action == "give_up", "gave_up").when(provisional, "provisional").when(correct, "correct").otherwise("incorrect")


def recent_objectives(sets: DataFrame, last: int = 10) -> DataFrame:
    """Objectives of each key's last sets, flattened in order: (key, place, objective)."""
    order = Window.partitionBy("key").orderBy(F.desc("created_at"), F.desc("set_id"))
    kept = sets.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= last)
    each = kept.select("key", "__n", F.posexplode("objectives").alias("pos", "objective"))
    return each.select("key", F.row_number().over(Window.partitionBy("key").orderBy("__n", "pos")).cast("long").alias("place"), "objective")


def text_word_sets(texts: DataFrame) -> DataFrame:
    """(id, vs): hashes of the distinct runs of a-z in each lower-cased text (id, text); none for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            words, starts = _word_hashes(data, offsets - offsets[0])
            ends = np.searchsorted(starts, offsets - offsets[0])
            found = [np.unique(words[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(found)], names=["id", "vs"])

    return texts.select(F.col("id").cast("long").alias("id"), F.coalesce(F.lower("text"), F.lit("")).alias("text")).mapInArrow(run, "id long, vs array<long>")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each run of a-z in the bytes of texts; words of up to eight letters never share one."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    inside = (padded[: len(data) + 1] - np.uint8(97)) < 26
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[offsets] |= inside[offsets]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(~inside | begins)  # of a run: the first byte behind its start that is none of its own
    ends = stops[np.searchsorted(stops, starts, "right")]
    words, left, at = np.zeros(len(starts), np.uint64), ends - starts, np.arange(len(starts))
    some = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    place = starts.copy()
    while len(at):
        words[at] = _mixed(words[at] ^ (eights[place[at]] & some[np.minimum(left[at], 8)]))
        left[at] -= 8
        place[at] += 8
        at = at[left[at] > 0]
    return words, starts


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat.view(np.int64)))


def _values(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a column of lists."""
    if isinstance(column, pa.ChunkedArray):
        return [x for chunk in column.chunks for x in _values(chunk)]
    flat, at = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b].view(np.uint64) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def similar_objectives(objectives: DataFrame, least: float = 0.72, common: int = 3) -> DataFrame:
    """Links (a, b, jaccard) of objectives (id, words) with enough words in common and overlap of ``least``: see ``similar_sets``."""
    return similar_sets(objectives.select("id", F.sort_array(F.array_distinct(F.transform("words", lambda w: F.xxhash64(w)))).alias("vs")), least, common)


def similar_sets(sets: DataFrame, least: float = 0.72, common: int = 3, spanning: bool = False) -> DataFrame:
    """Links (a, b, jaccard) of sets (id, vs) with ``common`` values in common and overlap of ``least``.

    Equal sets are one class, named by its smallest id: a row links each other id with that one. Of the classes every
    pair that meets both limits has its row, counted on whole sets; with ``spanning`` as few as tell which are connected.

    Prefix filter: with values in one order, the rarest first, such a pair shares one of the first (1 - least) * n + 1 of
    each. Positional filter: behind the first value in common there must be room for the others. What passes must also
    have room by parity sketches, which go with the prefixes, so pairs that don't meet the limits hardly leave their
    task, and whole sets move only for those that do. The order is by counts in a table of bounded size. Values, and sets
    as classes, are told apart by 64-bit hashes.
    """
    made = scratch_table(sets.filter(F.size("vs") >= common).select("id", F.xxhash64("vs").alias("key"), "vs"), "word-sets")
    names = scratch_table(made.groupBy("key").agg(F.min("id").alias("id")), "word-classes")
    classes = _among(made, names, "key", "id")
    pairs = scratch_table(_candidates(classes, least).distinct(), "word-pairs")
    between = _counted(pairs, classes, least, common, spanning)
    copies = made.select("key", "id").join(names.withColumnRenamed("id", "rep"), "key").filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    return between.union(copies)


def _among(rows: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """The rows whose columns are in ``wanted``, and a few others: a bitmap of bounded size tells where they are read, so that no row moves for it."""
    place = F.pmod(F.xxhash64(*columns), F.lit(1 << BITMAP_BITS))
    spots = wanted.select(place.alias("__h"))
    bitmap = spots.groupBy(F.bitmap_bucket_number("__h").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__h")).alias("__bits"))
    placed = rows.withColumn("__bucket", F.bitmap_bucket_number(place)).withColumn("__bit", F.bitmap_bit_position(place))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return placed.join(F.broadcast(bitmap), "__bucket").filter(F.getbit(byte, (F.col("__bit") % 8).cast("int")) == 1).select(*rows.columns)


def _levels(classes: DataFrame) -> np.ndarray:
    """A byte for each of 2 ** COUNT_BITS buckets of values: four times the logarithm (base 2) of their number of sets; 0 for one set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [x & np.uint64((1 << COUNT_BITS) - 1) for x in _values(batch.column("vs"))]
            bucket, n = np.unique(np.concatenate(flat), return_counts=True) if flat else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(n.astype(np.int64))], names=["bucket", "n"])

    counts = classes.select("vs").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).filter("n > 1")
    table = counts.select("bucket", F.floor(F.log2("n") * 4).cast("int").alias("level")).toArrow()
    levels = np.zeros(1 << COUNT_BITS, np.uint8)
    levels[table.column("bucket").to_numpy()] = np.minimum(table.column("level").to_numpy(), 255)
    return levels


def _sketch(values: np.ndarray) -> bytes:
    """Parities of the values that fall on each of at least as many bits: two sets differ in at least as many values as their sketches in bits."""
    bits = 1 << max(6, (len(values) - 1).bit_length())
    odd = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _room(sketches: list[bytes], n: np.ndarray, least: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that tells for rows x and y, of sizes that allow it, whether their sketches leave room for an overlap of ``least``.

    Of such sizes one sketch is at most twice as wide as the other, and is folded then.
    """
    wide = np.array([len(s) // 8 for s in sketches], np.int64)
    tables = {}
    for w in np.unique(wide).tolist():
        at, place = [np.flatnonzero(wide == k) for k in (w, 2 * w)], np.zeros(len(wide), np.int64)
        own, twice = (np.frombuffer(b"".join(sketches[i] for i in a.tolist()), "<u8").reshape(len(a), -1) if len(a) else np.zeros((0, k), np.uint64) for a, k in zip(at, (w, 2 * w), strict=True))
        place[np.concatenate(at)] = np.arange(len(at[0]) + len(at[1]))
        tables[w] = place, np.concatenate((own, twice[:, :w] ^ twice[:, w:]))

    def run(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        apart, low = np.zeros(len(x), np.int64), np.minimum(wide[x], wide[y])
        for w in np.unique(low).tolist():
            place, table = tables[w]
            of = np.flatnonzero(low == w)
            for at in range(0, len(of), step := max(1, STEP // w)):
                part = of[at : at + step]
                apart[part] = np.bitwise_count(table[place[x[part]]] ^ table[place[y[part]]]).sum(axis=1, dtype=np.int64)
        return apart <= (n[x] + n[y]) * (1 - least) / (1 + least) + 1e-6

    return run


def _candidates(classes: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of classes (key, vs) that pass the filters on prefixes and sketches; the same one from each task that has it.

    A part holds the lists of some values: a row for each class that is in any of them. Lists of a value that more than
    LIST classes have are dealt in blocks, each pair of which is a list.
    """
    spark = classes.sparkSession
    levels = spark.sparkContext.broadcast(_levels(classes))
    total = classes.agg(F.sum(F.size("vs"))).first()[0] or 0
    parts = max(PARTS, int(total * (1 - least)) // PART_VALUES)
    block, split = BLOCK_CLASSES, max(4, math.floor(4 * math.log2(LIST)) + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, of, where, sizes, sketches, values, places = batch.column("key").to_numpy(), [], [], [], [], [], []
            for i, v in enumerate(_values(batch.column("vs"))):
                level = levels.value[v & np.uint64((1 << COUNT_BITS) - 1)]
                first = np.lexsort((v, level))[: len(v) - math.ceil(len(v) * least - 1e-9) + 1]
                first, pos = first[level[first] > 0], np.flatnonzero(level[first] > 0)
                short, long = level[first] < split, np.flatnonzero(level[first] >= split)
                lists, pos_of = [v[first][short]], [pos[short]]
                for k in long.tolist():
                    blocks = int(2 ** ((int(level[first[k]]) + 1) / 4) / block) + 1
                    own, every = int(names[i]) % blocks, np.arange(blocks, dtype=np.uint64)
                    met = np.minimum(every, np.uint64(own)) * np.uint64(blocks) + np.maximum(every, np.uint64(own))
                    lists.append(_mixed(v[first[k]] ^ met) if blocks > 1 else v[first[k]][None])
                    pos_of.append(np.full(blocks, pos[k]))
                lists, pos_of = np.concatenate(lists), np.concatenate(pos_of)
                if not len(lists):
                    continue
                part = ((lists >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
                sketch = _sketch(v)
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
                    of.append(i)
                    where.append(part[order[a]])
                    sizes.append(len(v))
                    sketches.append(sketch)
                    # Five bytes: a list's name within its part (names that meet cost comparisons only), and a place (a smaller one leaves more room)
                    at = (lists[order[a:b]] & np.uint64(0xFFFFFF)) << np.uint64(16) | np.minimum(pos_of[order[a:b]], 0xFFFF).astype(np.uint64)
                    values.append(at.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
            columns = [pa.array(where, pa.int32()), pa.array(names[of] if of else [], pa.int64()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "key", "n", "bits", "at"])

    def meet(table: pa.Table) -> pa.Table:
        keys, sizes, lists = table.column("key").to_numpy(), table.column("n").to_numpy(), table.column("at").to_pylist()
        near = _room(table.column("bits").to_pylist(), sizes.astype(np.int64), least)
        row = np.repeat(np.arange(len(keys), dtype=np.int32), [len(x) // 5 for x in lists])
        at = np.frombuffer(b"".join(lists), np.uint8).reshape(-1, 5).astype(np.uint32)
        name, pos = at[:, 2] | at[:, 3] << 8 | at[:, 4] << 16, (at[:, 0] | at[:, 1] << 8).astype(np.int32)
        del at, lists
        order = np.argsort(name.astype(np.int64) << 32 | sizes[row])  # by list, then by size
        row, name, pos = row[order], name[order], pos[order]
        n = sizes[row]
        room = n - pos
        del order, pos
        cuts = np.flatnonzero(np.diff(name, append=~name[-1:]))
        ends = np.repeat(cuts + 1, np.diff(cuts, prepend=-1)).astype(np.int32)
        found, held = [], 0
        for begin in range(0, len(row), STEP):
            x, apart = np.arange(begin, min(begin + STEP, len(row))), 0
            while len(x):
                apart += 1
                x = x[x + apart < ends[x]]
                x = x[n[x] >= n[x + apart] * least - 1e-9]  # sizes rise within a list, so those that come later are no nearer
                y = x + apart
                some = np.minimum(room[x], room[y]) >= (n[x] + n[y]) * (least / (1 + least)) - 1e-9
                a, b = row[x[some]], row[y[some]]
                some = (keys[a] != keys[b]) & near(a, b)
                found.append(np.minimum(a, b)[some].astype(np.int64) * len(keys) + np.maximum(a, b)[some])
                held += len(found[-1])
                if held > STEP:
                    found = [np.unique(np.concatenate(found))]
                    held = 0
        a, b = np.divmod(np.unique(np.concatenate(found)), len(keys))
        return pa.table([pa.array(f(keys[a], keys[b])) for f in (np.minimum, np.maximum)], names=["a", "b"])

    dealt = classes.select("key", "vs").mapInArrow(deal, "part int, key long, n int, bits binary, at binary")
    return dealt.groupBy("part").applyInArrow(meet, "a long, b long")


def _counted(pairs: DataFrame, classes: DataFrame, least: float, common: int, spanning: bool) -> DataFrame:
    """(a, b, jaccard): the pairs (a, b) of classes (id, key, vs) that meet the limits on whole sets, by their ids.

    Pairs come together by the smallest class that either end is paired with, so that sets which are all alike move once;
    many of one class are dealt in a square.
    """
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lows = scratch_table(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.col("key")).alias("low")), "word-lows")
    low = lambda end: lows.select(F.col("key").alias(end), F.col("low").alias(f"low_{end}"))
    named = scratch_table(pairs.join(low("a"), "a").join(low("b"), "b").select("a", "b", F.least("low_a", "low_b").alias("low")), "named-pairs")
    many = named.groupBy("low").agg(F.ceil(F.sqrt(F.count(F.lit(1)) / PAIRS)).cast("int").alias("side")).filter("side > 1")
    bins = max(PARTS, -(-2 * named.count() // PAIRS))
    side = F.coalesce("side", F.lit(1))
    square = [F.pmod(F.xxhash64(end), side) for end in ("a", "b")]
    dealt = named.join(F.broadcast(many), "low", "left").select(F.pmod(F.xxhash64("low", *square), F.lit(bins)).cast("int").alias("bin"), "a", "b")
    needed = dealt.select(F.col("bin").alias("of"), F.explode(F.array("a", "b")).alias("key")).distinct()
    moved = needed.join(_among(classes, lows, "key"), "key").select("of", "id", "key", "vs")

    def count(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        ids, values = sets.column("id").to_numpy(), _values(sets.column("vs"))
        order = np.lexsort((ids, keys := sets.column("key").to_numpy()))  # of equal sets the smallest id, if more than one came
        keys = keys[order]
        a, b = (order[np.searchsorted(keys, pairs.column(end).to_numpy())] for end in ("a", "b"))
        n = np.array([len(v) for v in values], np.int64)
        by = np.argsort(a, kind="stable")
        a, b = a[by], b[by]
        shared = np.zeros(len(a), np.int64)
        cuts = np.flatnonzero(np.diff(a, prepend=-1)).tolist()
        for start, stop in zip(cuts, [*cuts[1:], len(a)], strict=True):
            mine = np.sort(values[a[start]])
            for at in range(start, stop, 256):
                of = b[at : min(at + 256, stop)]
                flat = np.concatenate([values[i] for i in of.tolist()])
                there = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                shared[at : at + len(of)] = np.add.reduceat(there, np.cumsum([0, *n[of[:-1]]]), dtype=np.int64)
        jaccard = shared / (n[a] + n[b] - shared)
        good = (shared >= common) & (jaccard >= least) & (ids[a] != ids[b])
        x, y, jaccard = np.minimum(ids[a], ids[b])[good], np.maximum(ids[a], ids[b])[good], jaccard[good]
        some = _spanning(x, y) if spanning else slice(None)
        return pa.table([pa.array(x[some]), pa.array(y[some]), pa.array(jaccard[some])], names=["a", "b", "jaccard"])

    found = dealt.groupBy("bin").cogroup(moved.groupBy("of")).applyInArrow(count, "a long, b long, jaccard double")
    return found.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def _spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The places of links that join parts which those before them leave apart."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    kept = []
    for at, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            up[x] = y
            kept.append(at)
    return np.array(kept, np.int64)


def _sketched(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of sets (key, vs) whose sizes and sketches leave room for their overlap."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _values(batch.column("vs"))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(v) for v in values], pa.int32()), pa.array([*map(_sketch, values)], pa.binary())], names=["key", "n", "bits"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.concatenate([batch.column(f"n_{end}").to_numpy().astype(np.int64) for end in "ab"])
            x = np.flatnonzero(np.minimum(*(m := n.reshape(2, -1))) >= np.maximum(*m) * least - 1e-9)
            near = _room([*batch.column("bits_a").to_pylist(), *batch.column("bits_b").to_pylist()], n, least)
            yield batch.select(["a", "b"]).take(pa.array(x[near(x, x + batch.num_rows)]))

    made = sets.select("key", "vs").mapInArrow(sketch, "key long, n int, bits binary")
    end = lambda name: made.select(*(F.col(c).alias(name if c == "key" else f"{c}_{name}") for c in made.columns))
    return pairs.join(end("a"), "a").join(end("b"), "b").mapInArrow(close, "a long, b long")


def split_answer(rows: DataFrame, visible: list[str], protected: list[str]) -> tuple[DataFrame, DataFrame]:
    """What a learner may see, and the protected rest, by exercise."""
    return rows.select("exercise_id", *visible), rows.select("exercise_id", *protected)
