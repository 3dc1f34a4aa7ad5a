"""Word-piece counts by a linear longest-match automaton.

Greedy longest-match word pieces of a word, counted without building them: a trie of the vocabulary has for each node
a failure link (the node to go on from after the pieces that are certain by then are popped) and the number of those
pieces. A word is read once; every byte follows one edge or pops pieces, so the time is linear in the word.

The vocabulary has two parts: pieces that begin a word, under one root, and pieces within it, under another. For a
byte-level BPE file these are its tokens with a leading space and all others; words are then read with that space.
Words are runs of letters, digits and non-ASCII characters; every other visible ASCII character is a word.

Distinct words of a piece of text are counted once and kept in a bounded cache. Cases: null and empty texts have no
words; a very long text is counted whole, in time in proportion to it; a word that the vocabulary can't spell counts
as one unknown piece; ties don't occur (the longest match is one); repeated rows each count, those without an id too;
an empty table gives an empty result; only ``keep`` and text are read, and n_words, n_pieces and n_unknown must not be
among ``keep``.
"""

import json
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.llm import columnar as C
from chalkline.llm.sstable import tokenizer_file

_LETTER = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
_MARK = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)])
CACHE_WORDS = 500_000


class LongestMatch:
    """The automaton. ``begin`` and ``within`` are the vocabulary's pieces; ``lead`` is put before every word."""

    def __init__(self, begin: Iterable[bytes], within: Iterable[bytes], lead: bytes = b""):
        self.lead = lead
        self.edges: dict[int, int] = {}  # node * 256 + byte -> node
        self.nodes, self.tokens = 2, set()  # node 0: begin of a word, node 1: within
        for root, pieces in ((0, begin), (1, within)):
            for piece in pieces:
                node = root
                for b in piece:
                    node = self.edges.setdefault(node << 8 | b, self.nodes)
                    self.nodes += node == self.nodes
                if piece:
                    self.tokens.add(node)
        self.failure, self.pops = [-1] * self.nodes, [0] * self.nodes
        self._link()

    def _link(self) -> None:
        children: dict[int, list[tuple[int, int]]] = {}
        for key, child in self.edges.items():
            children.setdefault(key >> 8, []).append((key & 255, child))
        queue = deque((0, 1))
        while queue:
            node = queue.popleft()
            for b, child in children.get(node, ()):
                if child in self.tokens:
                    self.failure[child], self.pops[child] = 1, 1
                else:
                    to, popped = self.failure[node], self.pops[node]
                    while to >= 0 and to << 8 | b not in self.edges:
                        popped += self.pops[to]
                        to = self.failure[to]
                    if to >= 0:
                        self.failure[child], self.pops[child] = self.edges[to << 8 | b], popped
                queue.append(child)

    def count(self, word: bytes) -> int:
        """Pieces of a word, 0 if the vocabulary can't spell it."""
        edges, failure, pops = self.edges, self.failure, self.pops
        node = n = 0
        for b in self.lead + word:
            while (to := edges.get(node << 8 | b, -1)) < 0:
                n += pops[node]
                node = failure[node]
                if node < 0:
                    return 0
            node = to
        while node != 1:
            n += pops[node]
            node = failure[node]
            if node < 0:
                return 0
        return n


@lru_cache(maxsize=2)
def byte_bpe_automaton(path: str) -> LongestMatch:
    """The automaton of a byte-level BPE vocabulary file, built once in a Python worker."""
    from chalkline.llm.sstable import _byte_letters

    letters = {c: b for b, c in _byte_letters().items()}
    with open(tokenizer_file(path), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    pieces = [bytes(letters[c] for c in token) for token in vocabulary if all(c in letters for c in token)]
    return LongestMatch((p for p in pieces if p[:1] == b" "), (p for p in pieces if p[:1] != b" "), b" ")


def count_words(chunk: C.Chunk, automaton: LongestMatch, cache: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, pieces, unknown words) of each text."""
    starts, ends, of = C.runs(chunk, _LETTER)
    marks = np.flatnonzero(_MARK[chunk.data])
    of = np.concatenate((of, np.searchsorted(chunk.offsets, marks, side="right") - 1))
    starts, ends = np.concatenate((starts, marks)), np.concatenate((ends, marks + 1))
    n = len(chunk)
    if not len(starts):
        return (np.zeros(n, np.int64),) * 3
    _, first, which = np.unique(C.span_hashes(C.prefix_sums(chunk.data), starts, ends), return_index=True, return_inverse=True)
    data, counts = chunk.data.tobytes(), np.empty(len(first), np.int64)
    for i, (a, b) in enumerate(zip(starts[first].tolist(), ends[first].tolist(), strict=True)):
        word = data[a:b]
        k = cache.get(word)
        if k is None:
            if len(cache) >= CACHE_WORDS:
                cache.clear()
            k = cache[word] = automaton.count(word)
        counts[i] = k
    each = counts[which]
    return np.bincount(of, minlength=n), np.bincount(of, np.maximum(each, 1), n).astype(np.int64), np.bincount(of[each == 0], minlength=n)


def token_counts(docs: DataFrame, keep: list[str], vocabulary_path: str, text: str = "text") -> DataFrame:
    """``keep`` of every document with n_words, n_pieces (an unknown word is one) and n_unknown."""
    read = docs.select(*(F.col(f"`{k}`") for k in keep), F.col(f"`{text}`").alias("__text"))
    names = ["n_words", "n_pieces", "n_unknown"]
    schema = T.StructType([*read.drop("__text").schema, *(T.StructField(c, T.LongType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, cache = byte_bpe_automaton(vocabulary_path), {}
        for batch in batches:
            parts = [np.stack(count_words(c, automaton, cache)) for c in C.text_chunks(batch.column("__text"))]
            counts = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x.astype(np.int64)) for x in counts)], names=[*keep, *names])

    return read.mapInArrow(run, schema)
