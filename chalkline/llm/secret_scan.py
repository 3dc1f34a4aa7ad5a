"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Two first-order Markov chains over characters are trained from labelled samples. Random strings are the keys and
digests that the patterns find, and SEEDED drawn strings over the usual key alphabets, so that a corpus without keys has
a model too; ordinary identifiers are all other tokens of MIN_WORD to MIN_TOKEN - 1 characters, and drawn names of
syllables in the usual cases, for the same reason (drawn by a fixed generator, so a model depends on the corpus alone).
Transitions are counted over all
documents (a task yields a bounded table of counts, which Spark sums). A token of MIN_TOKEN characters or more
outside the patterns' spans is reported when its log-likelihood ratio is high in total and for each character: above
cuts that FALSE_SHARE of HELD_OUT names exceed, which are drawn anew and have taught nothing.

Cases: null and empty texts have no spans; a very long text takes time in proportion to its length, however dense in
spans it is (sorted sweeps, and one count of code points); ties (spans of one start) are ordered by kind; repeated
rows are scanned each and count each in training; an empty table gives an empty result; only ``keep`` and text are
read, and the result's column ``spans`` must not be one of ``keep``.
"""

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.llm import columnar as C

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
_TOKEN_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_TOKEN, _HEX, _UPPER = C.byte_table(_TOKEN_BYTES), C.byte_table(b"0123456789abcdef"), C.byte_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_SEPARATOR = C.byte_table(b":=")
#: Characters to states of the chains; the last state is the begin.
_STATE = np.zeros(256, np.int64)
_STATE[list(_TOKEN_BYTES)] = np.arange(len(_TOKEN_BYTES))
N_STATES = len(_TOKEN_BYTES) + 1
MIN_TOKEN, MIN_WORD = 20, 8
#: Drawn strings in training, and the alphabets of keys (fixed values: digits by base, letters and digits, URL-safe base 64).
SEEDED = 4000
ALPHABETS = (b"0123456789abcdef", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", _TOKEN_BYTES[:62], _TOKEN_BYTES[:64], _TOKEN_BYTES[26:62])
#: Cuts are set where so many of the held-out names lie above them, and not below these ratios.
HELD_OUT, FALSE_SHARE, LEAST_LLR, LEAST_MEAN_LLR = 4000, 0.001, 8.0, 0.3

#: Drawn names: consonants and vowels of their syllables, and what stands between their words.
_CONSONANTS, _VOWELS, _JOINTS = "b c d f g h k l m n p r s t v st tr ch sh pr".split(), "a e i o u ea io".split(), ("_", "-", ".", "/", "")

Span = tuple[int, int, int]


def base_spans(text: bytes, hex_runs: list[tuple[int, int]], upper_runs: list[tuple[int, int]], assign: bool) -> list[Span]:
    """(start, kind, end) in bytes of the pattern matches of one text."""
    found = [(a, 2, b) for a, b in hex_runs]
    for a, b in upper_runs:
        at = text.find(b"AKIA", a, b)
        if at >= 0 and b - at >= MIN_ACCESS:
            found.append((at, 1, b))
    if assign:
        # One byte for each byte, so places stay; bytes of other characters match no part of the pattern.
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text.decode("latin-1")) if len(m[2]) >= MIN_VALUE]
    return sorted(found)


def outside(tokens: list[tuple[int, int]], spans: list[Span]) -> list[tuple[int, int]]:
    """The tokens (sorted) that no span (sorted by start) touches."""
    starts, ends = [], []
    for a, _, b in spans:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    found = []
    for a, b in tokens:
        i = bisect_right(ends, a)  # the first union of spans that ends after the token's begin
        if i == len(ends) or starts[i] >= b:
            found.append((a, b))
    return found


def scan(chunk: C.Chunk) -> Iterator[tuple[int, bytes, list[Span], list[tuple[int, int]]]]:
    """(text index, text, pattern spans, long tokens outside them) of the texts of a chunk that have any."""
    by_text: dict[int, tuple[list, list, list]] = {}
    for slot, (member, least) in enumerate(((_HEX, MIN_HEX), (_UPPER, MIN_ACCESS), (_TOKEN, MIN_TOKEN))):
        starts, ends, of = C.runs(chunk, member)
        for i in np.flatnonzero(ends - starts >= least).tolist():
            base = int(chunk.offsets[of[i]])
            by_text.setdefault(int(of[i]), ([], [], []))[slot].append((int(starts[i]) - base, int(ends[i]) - base))
    marks = np.zeros(len(chunk.data) + 1, np.int64)
    np.cumsum(_SEPARATOR[chunk.data], out=marks[1:])
    separated = marks[chunk.offsets[1:]] > marks[chunk.offsets[:-1]]
    for i in sorted(by_text.keys() | set(np.flatnonzero(separated).tolist())):
        hexes, uppers, tokens = by_text.get(i, ([], [], []))
        text = chunk.text(i)
        spans = base_spans(text, hexes, uppers, bool(separated[i]))
        free = outside(tokens, spans)
        if spans or free:
            yield i, text, spans, free


def transitions(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    states = _STATE[np.frombuffer(text, np.uint8)]
    return np.concatenate(([N_STATES - 1], states[:-1])), states


def _word_transitions(chunk: C.Chunk, secret: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The transitions of the tokens of MIN_WORD to MIN_TOKEN - 1 characters that no secret touches.

    Longer ones are what is to be told apart: they have no label, so they teach nothing.
    """
    starts, ends, _ = C.runs(chunk, _TOKEN)
    sums = np.zeros(len(secret) + 1, np.int64)
    np.cumsum(secret, out=sums[1:])
    use = (ends - starts >= MIN_WORD) & (ends - starts < MIN_TOKEN) & (sums[ends] == sums[starts])
    starts, sizes = starts[use], (ends - starts)[use]
    place = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    states = _STATE[chunk.data[place]]
    before = np.concatenate(([0], states[:-1])) if len(states) else states
    before[np.cumsum(sizes) - sizes] = N_STATES - 1
    return before, states


def drawn_name(rng: np.random.Generator) -> str:
    """Two to four words of syllables: joined by one sign, or with capitals, sometimes with a number behind."""
    of = lambda values: values[int(rng.integers(len(values)))]
    words = ["".join(of(_CONSONANTS) + of(_VOWELS) + (of(_CONSONANTS)[:1] if rng.random() < 0.4 else "") for _ in range(int(rng.integers(1, 4)))) for _ in range(int(rng.integers(2, 5)))]
    joint = of(_JOINTS)
    name = joint.join(words) if joint else words[0] + "".join(w.capitalize() for w in words[1:])
    if rng.random() < 0.1:
        name = name.upper()
    return name + (joint or "") + str(int(rng.integers(1, 100))) if rng.random() < 0.2 else name


def seeded_counts(strings: int = SEEDED) -> np.ndarray:
    """Counts of both chains: those of drawn random strings (0), and of as many drawn names (1)."""
    rng = np.random.Generator(np.random.PCG64(7))
    counts = np.zeros((2, N_STATES, N_STATES))
    for alphabet in ALPHABETS:
        for _ in range(strings // len(ALPHABETS)):
            word = np.frombuffer(alphabet, np.uint8)[rng.integers(0, len(alphabet), int(rng.integers(20, 45)))].tobytes()
            np.add.at(counts[0], transitions(word), 1)
    for _ in range(strings):
        np.add.at(counts[1], transitions(drawn_name(rng).encode()), 1)
    return counts


def cuts(model: np.ndarray) -> tuple[float, float]:
    """From the curve of held-out names: the ratios in total and for each character that a reported token has at least."""
    rng = np.random.Generator(np.random.PCG64(11))
    names = [n.encode() for n in (drawn_name(rng) for _ in range(HELD_OUT)) if len(n) >= MIN_TOKEN]
    total = np.array([float(model[transitions(n)].sum()) for n in names])
    mean = total / np.array([len(n) for n in names])
    at = lambda x, least: max(least, float(np.quantile(x, 1 - FALSE_SHARE)))
    return at(total, LEAST_LLR), at(mean, LEAST_MEAN_LLR)


def train(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log-likelihood ratios of all transitions, random against ordinary, counted over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, N_STATES, N_STATES), np.int64)
        for batch in batches:
            for chunk in C.text_chunks(batch.column(0)):
                secret = np.zeros(len(chunk.data), bool)
                for i, text, spans, _ in scan(chunk):
                    for a, k, b in spans:
                        secret[chunk.offsets[i] + a : chunk.offsets[i] + b] = True
                        if k:
                            np.add.at(counts[0], transitions(text[a:b]), 1)
                np.add.at(counts[1], _word_transitions(chunk, secret), 1)
        label, a, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (label, a, b, counts[label, a, b])], names=["label", "a", "b", "n"])

    summed = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "label long, a long, b long, n long").groupBy("label", "a", "b").agg(F.sum("n").alias("n"))
    counts = seeded_counts()
    for label, a, b, n in summed.collect():
        counts[label, a, b] += n
    logs = np.log(counts + 0.5) - np.log((counts + 0.5).sum(axis=2, keepdims=True))
    return logs[0] - logs[1]


def find_secrets(docs: DataFrame, keep: list[str], model: np.ndarray | None = None, least: tuple[float, float] | None = None) -> DataFrame:
    """``keep`` of every document and its ``spans``, ordered by start and kind; places are code points, end exclusive.

    ``least`` are the ratios in total and for each character, of ``cuts`` by default.
    """
    if model is None:
        model = train(docs)
    min_llr, min_mean_llr = least or cuts(model)
    ratios = docs.sparkSession.sparkContext.broadcast(model)
    read = docs.select(*(F.col(f"`{k}`") for k in keep), F.col("text").alias("__text"))
    schema = T.StructType([*read.drop("__text").schema, *T._parse_datatype_string("spans array<struct<kind:string,start:bigint,end:bigint>>")])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        llr = ratios.value
        for batch in batches:
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for chunk in C.text_chunks(batch.column("__text")):
                points = np.zeros(len(chunk.data) + 1, np.int32)  # code points that begin before each byte
                np.cumsum((chunk.data & 0xC0) != 0x80, out=points[1:])
                for i, text, spans, free in scan(chunk):
                    for a, b in free:
                        total = float(llr[transitions(text[a:b])].sum())
                        if total >= min_llr and total >= min_mean_llr * (b - a):
                            spans.append((a, 3, b))
                    place = points[chunk.offsets[i] : chunk.offsets[i + 1] + 1] - points[chunk.offsets[i]]
                    spans.sort()
                    at, ends = (place[[s[n] for s in spans]].tolist() for n in (0, 2))
                    out[chunk.first + i] = [{"kind": KINDS[s[1]], "start": a, "end": b} for s, a, b in zip(spans, at, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kind)], names=[*keep, "spans"])

    return read.mapInArrow(run, schema)
