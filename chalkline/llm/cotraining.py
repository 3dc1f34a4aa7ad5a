"""Quality classifier by co-training of two views.

The text view sees the content alone: statistics of characters, words and lines, and the shares of hashed shapes (runs
of three character classes). The metadata view sees the page's data alone: source and language (hashed) and length.
Both are logistic regressions. In each round either view labels the unlabelled documents that it is most certain of,
and the other view learns from them. At last both are calibrated on labelled documents that neither has seen, and a
regression on the calibrated values of both gives the score of every document.

The features of all documents are written once. Labelled rows are a bounded sample (about ``train_docs``, by hashed id);
the unlabelled ones are all others: in every round either view scores all of them, the most certain are chosen over all
of them (by a histogram that Spark sums), and the regressions' sums over all labelled and pseudo-labelled rows are
taken in the tasks and added up in two steps, so the driver gets a few rows of fixed size. Which rows a view has taught
follows from the models and cuts of the earlier rounds, so no state is written.

Documents whose hashed id falls in the held-out fold teach nothing. Cases: null and empty texts have all content
features 0; a very long text is measured whole; null source or language is a value of its own; null labels teach
nothing; repeated labels count as bad if one is; repeated rows are scored each, one of them (the smallest features)
stands for its id among labelled rows; documents of one certainty (a bin of 1/128 of a logit) are taken or left together;
with one class only the score is its share for all; an empty table gives an empty result; only doc_id, text, source,
lang and n_chars are read, so extra columns never clash.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.llm import columnar as C
from chalkline.llm.toxicity import held_out, sampled
from chalkline.sources.scratch import scratch_table

SHAPES, STATS = 256, 8
TEXT_DIM, META_DIM = SHAPES + STATS, 64 + 16 + 2
_CLASS = np.array([4 if b in C.WHITE else 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 5 if b > 127 else 6 + b % 32 for b in range(256)], np.int64)
_CLASS[10] = 0


def text_view(chunk: C.Chunk) -> np.ndarray:
    """Content features, a row for each text."""
    n, size = len(chunk), np.diff(chunk.offsets).astype(float)
    out = np.zeros((n, TEXT_DIM), np.float32)
    if not len(chunk.data):
        return out
    classes = _CLASS[chunk.data]
    of = np.repeat(np.arange(n), np.diff(chunk.offsets))
    inside = np.flatnonzero(of[:-2] == of[2:]) if len(of) > 2 else np.zeros(0, np.int64)
    shape = (classes[inside] * 1600 + classes[inside + 1] * 40 + classes[inside + 2]) * 2654435761 % (1 << 32) >> 24
    shapes = np.bincount(of[inside] * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES)
    safe = np.maximum(size, 1)[:, None]
    out[:, :SHAPES] = np.sqrt(shapes / safe)
    starts, ends, word_of = C.runs(chunk, C.NOT_WHITE)
    words = np.maximum(np.bincount(word_of, minlength=n), 1)
    hashes = C.span_hashes(C.prefix_sums(chunk.data), starts, ends)
    pairs = np.unique(np.stack((word_of.astype(np.uint64), hashes)), axis=1)[0] if len(hashes) else np.zeros(0, np.uint64)
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (word_of[1:] == word_of[:-1])) if len(hashes) else np.zeros(0, np.int64)
    share = lambda member: np.bincount(of, member[classes], n) / safe[:, 0]
    of_class = lambda *k: np.isin(np.arange(40), k).astype(float)
    out[:, SHAPES:] = np.stack(
        [
            np.log1p(words),
            np.bincount(pairs.astype(np.int64), minlength=n) / words,
            np.bincount(word_of[same], minlength=n) / words,
            np.log1p(np.bincount(word_of, ends - starts, n) / words),
            share(of_class(2)),
            share(of_class(3)),
            share((np.arange(40) > 5).astype(float)),
            share(of_class(0)),
        ],
        axis=1,
    )
    return out


def meta_columns(source: str = "source", lang: str = "lang", n_chars: str = "n_chars") -> list[Column]:
    """What the metadata view reads: hashed source, hashed language, log length."""
    place = lambda c, n: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(n)).cast("int")
    return [place(source, 64).alias("m_source"), place(lang, 16).alias("m_lang"), F.coalesce(F.log1p(F.greatest(F.col(n_chars), F.lit(0))), F.lit(0.0)).alias("m_length")]


def meta_view(batch: pa.RecordBatch) -> np.ndarray:
    n = batch.num_rows
    out = np.zeros((n, META_DIM), np.float32)
    out[np.arange(n), batch.column("m_source").to_numpy()] = 1
    out[np.arange(n), 64 + batch.column("m_lang").to_numpy()] = 1
    out[:, 80] = batch.column("m_length").to_numpy()
    out[:, 81] = out[:, 80] ** 2
    return out


@dataclass
class Logistic:
    """Standardised logistic regression by Newton's method."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 12) -> "Logistic":
        x = x.astype(float)
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.hstack((np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))))
        w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], l2)
        ridge[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def standard(self, x: np.ndarray) -> np.ndarray:
        """Standardised features with a one for the intercept."""
        out = np.ones((len(x), x.shape[1] + 1))
        inner = out[:, :-1]
        np.subtract(x, self.mean, out=inner)
        inner /= self.scale
        np.clip(inner, -8, 8, out=inner)
        return out

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights

    def stepped(self, sums: np.ndarray, l2: float = 1.0) -> "Logistic":
        """A Newton step further, by the sums of ``newton_sums``."""
        ridge = np.full(len(self.weights), l2)
        ridge[-1] = 1e-6
        step = np.linalg.solve(sums[:, 1:] + np.diag(ridge), sums[:, 0] - ridge * self.weights)
        return Logistic(self.mean, self.scale, self.weights + step)


@dataclass
class Combined:
    text: Logistic
    meta: Logistic
    calibrate_text: Logistic
    calibrate_meta: Logistic
    join: Logistic
    share: float | None = None  # of good documents, where there is one class only

    def views(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """The calibrated logits of both views."""
        return np.stack((self.calibrate_text.logit(self.text.logit(text)[:, None]), self.calibrate_meta.logit(self.meta.logit(meta)[:, None])), axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


#: Certainties are compared as whole bins of logits, which are the same however a processor adds up.
BINS_PER_LOGIT, MAX_LOGIT = 128, 30
#: Rows of sums that reach the driver in a step.
SUMS = 8


def certainty(logit: np.ndarray) -> np.ndarray:
    """The bin of a logit."""
    return np.floor(np.minimum(logit, MAX_LOGIT) * BINS_PER_LOGIT)


def least_certain(share: float) -> int:
    """The first bin that lies above the logit of ``share`` as a whole."""
    return int(np.ceil(np.log(share / (1 - share)) * BINS_PER_LOGIT))


@dataclass
class Lesson:
    """A round's models, and the bin of certainty from which teacher 0 or 1 passes on the labels 0 and 1."""

    models: tuple[Logistic, Logistic]
    cuts: np.ndarray  # by teacher and label


def taught(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, lessons: list[Lesson]) -> list[np.ndarray]:
    """Labels of both views' training: the known one, or what the other view was the first to be certain of, or -1.

    ``views`` are standardised; all models of a view share the means and scales of its first one.
    """
    labels = [y.copy(), y.copy()]
    if lessons:
        logits = [z @ np.stack([lesson.models[v].weights for lesson in lessons], axis=1) for v, z in enumerate(views)]
        for k, lesson in enumerate(lessons):
            for teacher, pupil in ((0, 1), (1, 0)):
                logit, open_ = logits[teacher][:, k], labels[pupil] < 0
                labels[pupil][open_ & (certainty(logit) >= lesson.cuts[teacher][1])] = 1
                labels[pupil][open_ & (certainty(-logit) >= lesson.cuts[teacher][0])] = 0
    return labels


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float16).reshape(-1, TEXT_DIM + META_DIM).astype(float)
    return rows[:, :TEXT_DIM], rows[:, TEXT_DIM:]


def feature_table(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, y (-1 unknown), fold, teaches (may the row train?) and x (both views) of every row; a written table."""
    number = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)).cast("int").alias("fold")
    rows = docs.select("doc_id", "text", *meta_columns()).join(F.broadcast(known), "doc_id", "left")  # about train_docs rows of two numbers at most
    rows = rows.select("doc_id", "text", "m_source", "m_lang", "m_length", F.coalesce("y", F.lit(-1)).alias("y"), number, (F.col("doc_id").isNotNull() & ~held_out()).alias("teaches"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [text_view(c) for c in C.text_chunks(batch.column("text"))]
            x = np.hstack((np.concatenate(parts) if parts else np.zeros((0, TEXT_DIM), np.float32), meta_view(batch))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "y", "fold", "teaches")), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "fold", "teaches", "x"])

    kind = dict(docs.dtypes)["doc_id"]
    return scratch_table(rows.mapInArrow(run, f"doc_id {kind}, y int, fold int, teaches boolean, x binary"), "features")


def certain_counts(pool: DataFrame, models: tuple[Logistic, Logistic], lessons: list[Lesson], certain: float) -> np.ndarray:
    """Open documents by teacher, label and bin of certainty, over the whole pool."""
    least = least_certain(certain)
    bins = MAX_LOGIT * BINS_PER_LOGIT - least + 1
    shared = pool.sparkSession.sparkContext.broadcast((models, lessons))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, lessons = shared.value
        counts = np.zeros((2, 2, bins), np.int64)
        for batch in batches:
            views = tuple(m.standard(v) for m, v in zip(models, _features(batch), strict=True))
            labels = taught(views, np.full(batch.num_rows, -1), lessons)
            for teacher, pupil in ((0, 1), (1, 0)):
                logit = (views[teacher] @ models[teacher].weights)[labels[pupil] < 0]
                for label, sure in ((1, certainty(logit)), (0, certainty(-logit))):
                    np.add.at(counts[teacher, label], (sure[sure >= least] - least).astype(np.int64), 1)
        teacher, label, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (teacher, label, at, counts[teacher, label, at])], names=["teacher", "label", "bin", "n"])

    out = np.zeros((2, 2, bins), np.int64)
    for teacher, label, at, n in pool.mapInArrow(run, "teacher long, label long, bin long, n long").groupBy("teacher", "label", "bin").agg(F.sum("n")).collect():
        out[teacher, label, at] = n
    return out


def cuts_of(counts: np.ndarray, most: int, certain: float) -> np.ndarray:
    """By teacher and label: the lowest certainty above which ``most`` open documents lie at most (the highest bin at least)."""
    least = least_certain(certain)
    cuts = np.full(counts.shape[:2], np.inf)
    for place in np.ndindex(counts.shape[:2]):
        filled = np.flatnonzero(counts[place])
        if len(filled):
            above = np.cumsum(counts[place][::-1])[::-1]
            fits = np.flatnonzero(above <= most)
            cuts[place] = least + min(int(fits[0]) if len(fits) else len(above), int(filled[-1]))
    return cuts


def newton_sums(rows: DataFrame, models: tuple[Logistic, Logistic], lessons: list[Lesson]) -> list[np.ndarray]:
    """For both views the gradient and curvature sums over all rows that are labelled or taught, as one matrix."""
    sizes = [len(m.weights) for m in models]
    shared = rows.sparkSession.sparkContext.broadcast((models, lessons))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, lessons = shared.value
        sums = [np.zeros((k, k + 1)) for k in sizes]
        for batch in batches:
            views = tuple(m.standard(v) for m, v in zip(models, _features(batch), strict=True))
            for view, model, label, total in zip(views, models, taught(views, batch.column("y").to_numpy().copy(), lessons), sums, strict=True):
                use = np.flatnonzero(label >= 0)
                z = view[use]
                p = sigmoid(z @ model.weights)
                total[:, 0] += z.T @ (label[use] - p)
                total[:, 1:] += (z * (p * (1 - p) + 1e-6)[:, None]).T @ z
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(s.tobytes() for s in sums)], pa.binary())], names=["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(k * (k + 1) for k in sizes))
        for batch in batches:
            for part in batch.column("sums"):
                total += np.frombuffer(part.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = rows.mapInArrow(run, "sums binary").repartition(SUMS).mapInArrow(add, "sums binary").collect()
    total = np.sum([np.frombuffer(bytes(r[0])) for r in parts], axis=0)
    return [m.reshape(k, k + 1) for m, k in zip(np.split(total, [sizes[0] * (sizes[0] + 1)]), sizes, strict=True)]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", train_docs: int = 20_000, rounds: int = 4, share: float = 0.05, certain: float = 0.95, steps: int = 3) -> tuple[Combined, DataFrame]:
    """(the model, the features of all rows). A fifth of the labelled sample calibrates the views.

    In a round a view passes on up to ``share`` of the unlabelled documents to either class, those it is most certain of
    and at least ``certain``; both regressions then take ``steps`` Newton steps on.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    known = known.filter(sampled(known.count(), train_docs))
    features = feature_table(docs, known)
    sample = features.filter("y >= 0 AND teaches").groupBy("doc_id").agg(F.min(F.struct("y", "fold", "x")).alias("r")).select("r.*").toArrow().combine_chunks()
    y, fold = sample.column("y").to_numpy(), sample.column("fold").to_numpy()
    good, bad = int((y == 1).sum()), int((y == 0).sum())
    empty = Logistic(np.zeros(1), np.ones(1), np.zeros(2))
    checks = fold == 1
    if any(len(set(y[part].tolist())) < 2 for part in (checks, ~checks)):
        return Combined(empty, empty, empty, empty, empty, (good + 1) / (good + bad + 2)), features
    views = _features(sample)
    models = tuple(Logistic.fit(v[~checks], y[~checks]) for v in views)
    pool = features.filter("y < 0 AND teaches")
    rows = features.filter("teaches AND NOT (y >= 0 AND fold = 1)")
    most, lessons = max(1, int(share * pool.count())), []
    for _ in range(rounds):
        lessons.append(Lesson(models, cuts_of(certain_counts(pool, models, lessons, certain), most, certain)))
        for _ in range(steps):
            models = tuple(m.stepped(s) for m, s in zip(models, newton_sums(rows, models, lessons), strict=True))
    known_y = y[checks].astype(float)
    calibrate = [Logistic.fit(m.logit(v[checks])[:, None], known_y) for m, v in zip(models, views, strict=True)]
    model = Combined(*models, *calibrate, empty)
    model.join = Logistic.fit(model.views(views[0][checks], views[1][checks]), known_y)
    return model, features


def score(features: DataFrame, model: Combined) -> DataFrame:
    """doc_id, text_score, meta_score and score (of good quality, 0 to 1) of every row of ``feature_table``."""
    shared = features.sparkSession.sparkContext.broadcast(model)
    names = ["text_score", "meta_score", "score"]
    schema = T.StructType([features.schema["doc_id"], *(T.StructField(c, T.DoubleType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if model.share is not None or not batch.num_rows:
                values = [np.full(batch.num_rows, model.share or 0.0)] * 3
            else:
                views = model.views(*_features(batch))
                values = [sigmoid(views[:, 0]), sigmoid(views[:, 1]), sigmoid(model.join.logit(views))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, pa.float64()) for v in values)], names=["doc_id", *names])

    return features.select("doc_id", "x").mapInArrow(run, schema)
