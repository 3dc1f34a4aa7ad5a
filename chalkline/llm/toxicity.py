"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a character n-gram (lower case, white space as one kind of space) in a text, hashed to
2**BITS places. Its value is the log-count ratio of the toxic and other training texts; logistic regression on the
``n_features`` places with the most significant ratios gives the weights, so a score is a sum over a text's distinct
n-grams. Training takes at most about ``train_docs`` labelled rows (by hashed id), whose texts are written once;
counting is summed by Spark, and the regression fits the bounded sample's selected features. Every whole text of the
table is scored.

Cases: an empty or null text scores the intercept; a very long text is scored whole, by its distinct n-grams;
unlabelled and null-labelled rows train nothing; repeated labels of a document count as toxic if one is; of repeated
rows of an id the smallest text trains, and each is scored; places with ratios of the same strength are taken by
number; with one class only, its share is the score of all; an empty table gives an empty result; other columns than
doc_id and text are not read, and the result's column ``score`` must not be one of ``keep``.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.llm import columnar as C
from chalkline.sources.scratch import scratch_table

GRAMS = (3, 4, 5, 6)
BITS = 20
_SPACE = C.LOWER.copy()
_SPACE[list(C.WHITE)] = 32


def grams(chunk: C.Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, place) of all n-grams of a chunk, for each length; n-grams don't cross texts."""
    data = _SPACE[chunk.data]
    at = np.flatnonzero((data & 0xC0) != 0x80)
    of = np.searchsorted(chunk.offsets, at, side="right") - 1
    ends = np.append(at[1:], len(data))
    sums = C.prefix_sums(data)
    for n in GRAMS:
        if len(at) >= n:
            inside = np.flatnonzero(of[: len(at) - n + 1] == of[n - 1 :])
            yield of[inside], (C.span_hashes(sums, at[inside], ends[inside + n - 1]) >> np.uint64(64 - BITS)).astype(np.int64)


def features(chunk: C.Chunk, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text index, place) of a chunk, of the places that ``wanted`` marks (all if None)."""
    keys = []
    for of, place in grams(chunk):
        if wanted is not None:
            use = wanted[place]
            of, place = of[use], place[use]
        keys.append((of << BITS) | place)
    both = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def sampled(n: int, bound: int, doc_id: str = "doc_id") -> Column:
    """About ``bound`` of ``n`` rows, by hashed id; 2**62 places, so that a small share of many rows isn't none."""
    places = 1 << 62
    return F.pmod(F.xxhash64(doc_id), F.lit(places)) < F.lit(places if n <= bound else places * bound // n)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, train_docs: int) -> DataFrame:
    """(text, y) of about ``train_docs`` labelled rows at most, none held out."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.filter(sampled(known.count(), train_docs))
    # At most about train_docs rows of two numbers, so its size is bounded. An id that repeats counts with one text.
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    return scratch_table(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y"), "training-rows")


def _counts(rows: DataFrame) -> np.ndarray:
    """Documents by class (rows) and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for chunk in C.text_chunks(batch.column("text")):
                of, place = features(chunk)
                np.add.at(counts, (y[of + chunk.first], place), 1)
        label, place = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.where(label == 1, counts[label, place], 0)), pa.array(np.where(label == 0, counts[label, place], 0))], names=["place", "p", "q"])

    table = rows.mapInArrow(run, "place long, p long, q long").groupBy("place").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).filter("p + q >= 3").toArrow()
    out = np.zeros((2, 1 << BITS))
    place = table.column("place").to_numpy()
    out[1, place], out[0, place] = table.column("p").to_numpy(), table.column("q").to_numpy()
    return out


def _logistic(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, n: int, l2: float, tolerance: float = 1e-7) -> tuple[np.ndarray, float]:
    """Weights and intercept at the optimum, by truncated Newton steps; row i has the values ``scale`` at ``rows[i]``.

    A step solves the Newton equation by conjugate gradients (two passes over the sample's places for each) as closely as
    the gradient is small, and is halved until the loss falls. It ends when no slope exceeds ``tolerance``.
    """
    cols = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    x = np.append(np.zeros(n), np.log(mean / (1 - mean)))  # the intercept is last, and not penalised
    penalty = np.append(np.full(n, l2), 1e-12)
    times = lambda v: np.bincount(of, (scale * v[:-1])[cols], len(rows)) + v[-1]
    back = lambda r: np.append(scale * np.bincount(cols, r[of], n), r.sum())

    def loss(v: np.ndarray, z: np.ndarray) -> float:
        return float((np.logaddexp(0, z) - y * z).mean() + (penalty * v * v).sum() / 2)

    z = times(x)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        slope = back(p - y) / len(rows) + penalty * x
        size = float(np.linalg.norm(slope))
        if np.abs(slope).max() <= tolerance:
            break
        weight = p * (1 - p) / len(rows)
        curved = lambda v, weight=weight: back(weight * times(v)) + penalty * v
        step, rest = np.zeros(n + 1), -slope
        ahead, square = rest.copy(), float(rest @ rest)
        for _ in range(200):
            bent = curved(ahead)
            length = square / max(float(ahead @ bent), 1e-300)
            step += length * ahead
            rest -= length * bent
            before, square = square, float(rest @ rest)
            if square <= (min(0.1, np.sqrt(size)) * size) ** 2:
                break
            ahead = rest + square / before * ahead
        along, share, now = times(step), 1.0, loss(x, z)
        while loss(x + share * step, z + share * along) > now + 1e-4 * share * float(slope @ step) and share > 1e-6:
            share /= 2
        x, z = x + share * step, z + share * along
    return x[:-1], float(x[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_docs: int = 20_000, n_features: int = 4096, alpha: float = 1.0, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """(score of each place, intercept)."""
    rows = training_rows(docs, labels, label, train_docs)
    count = _counts(rows)
    n_pos, n_neg = (rows.agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q")).first()) or (0, 0)
    n_pos, n_neg = n_pos or 0, n_neg or 0
    if not n_pos or not n_neg:
        share = (n_pos + 1) / (n_pos + n_neg + 2)
        return np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share)))
    p, q = count[1] + alpha, count[0] + alpha
    ratio = np.log(p / (n_pos + 2 * alpha)) - np.log(q / (n_neg + 2 * alpha))
    strength = np.where(count.sum(axis=0) >= 3, np.abs(ratio) / np.sqrt(1 / p + 1 / q), 0)
    chosen = np.sort(np.argsort(-strength, kind="stable")[:n_features])
    chosen = chosen[strength[chosen] > 0]
    wanted = np.zeros(1 << BITS, bool)
    wanted[chosen] = True
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << BITS, bool)
        wanted[shared.value] = True
        for batch in batches:
            y = batch.column("y")
            for chunk in C.text_chunks(batch.column("text")):
                of, place = features(chunk, wanted)
                ends = np.searchsorted(of, np.arange(len(chunk) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.searchsorted(shared.value, place).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([y.slice(chunk.first, len(chunk)), lists], names=["y", "x"])

    sample = rows.mapInArrow(select, "y int, x array<int>").toArrow().combine_chunks()
    x = sample.column("x")
    lists = [a.values.to_numpy(zero_copy_only=False).astype(np.int64) for a in x]
    w, b = _logistic(lists, sample.column("y").to_numpy().astype(float), ratio[chosen], len(chosen), l2)
    weights = np.zeros(1 << BITS, np.float32)
    weights[chosen] = w * ratio[chosen]
    return weights, b


def score(docs: DataFrame, keep: list[str], model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """``keep`` of every document and its ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    read = docs.select(*(F.col(f"`{k}`") for k in keep), F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([*read.drop("__text").schema, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, b = shared.value
        wanted = weights != 0
        for batch in batches:
            sums = np.zeros(batch.num_rows)
            for chunk in C.text_chunks(batch.column("__text")):
                of, place = features(chunk, wanted)
                sums[chunk.first : chunk.first + len(chunk)] = np.bincount(of, weights[place].astype(float), len(chunk))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(sums + b, -40, 40))))], names=[*keep, "score"])

    return read.mapInArrow(run, schema)
