"""Whole texts of an Arrow batch as flat byte arrays, for vectorised passes inside ``mapInArrow`` tasks."""

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: The white space of all word rules here: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = b" \t\n\v\f\r"
#: Texts are handled in pieces of so many bytes at least (whole texts each), so that memory does not follow the batch.
CHUNK_BYTES = 1 << 20
#: Text after which a worker gives freed memory back.
RELEASE_BYTES = 8 << 20


@dataclass
class Chunk:
    """Rows ``first .. first + len(self)`` of a batch; text ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def text_chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a string column in order; null is the empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, ends, values = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + size, side="left"))
        last = min(max(last, first + 1), len(column))
        start, end = int(offsets[first]), int(offsets[last])
        yield Chunk(first, data[start:end], offsets[first : last + 1] - start)
        first = last
        _used(end - start)


_USED = [0]


def _used(size: int) -> None:
    """Release memory after each RELEASE_BYTES of text."""
    _USED[0] += size
    if _USED[0] >= RELEASE_BYTES:
        _USED[0] = 0
        release_memory()


def release_memory() -> None:
    """Give freed memory back to the system, since a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def byte_table(chars: bytes, invert: bool = False) -> np.ndarray:
    """A boolean for each byte value: is it one of ``chars``?"""
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return ~table if invert else table


NOT_WHITE = byte_table(WHITE, invert=True)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(chunk: Chunk, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that ``member`` holds, none across texts: start, end and text index of each."""
    n = len(chunk.data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = member[chunk.data]
    breaks = np.zeros(n + 1, bool)
    breaks[chunk.offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | breaks[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | breaks[1:])) + 1
    return starts, ends, np.searchsorted(chunk.offsets, starts, side="right") - 1


# --- hashing -------------------------------------------------------------------------------------------------

_U = np.uint64
#: Odd multipliers and salts of the hashes below. Any odd constants do; all tasks must use the same.
_BASE, _STEP, _LEN = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1, 0xD6E8FEB86659FD93
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit of a hash depends on all bits of its sum."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _series(factor: int, size: int) -> np.ndarray:
        out = np.full(size, factor, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), CHUNK_BYTES + 4096)
            self.up, self.down = (self._series(x, size) for x in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_POWERS = _Powers(_BASE)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums that ``span_hashes`` takes differences of."""
    up, _ = _POWERS.get(max(1, len(data)))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal spans hash alike wherever they lie."""
    _, down = _POWERS.get(len(sums) + 1)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(_LEN))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive entries of ``words`` (their order counts)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * _U(_STEP) + words[i : len(words) - n + 1 + i]
    return mix(out + _U(n))
