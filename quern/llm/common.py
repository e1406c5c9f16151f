"""What the operators share: safe column choice and vectorised scanning of text bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The white space that separates words in these operators (fixed values).
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text that one vectorised step takes at most, unless one document is longer.
CHUNK_BYTES = 1 << 20

_M = (1 << 64) - 1
_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xC2B2AE3D27D4EB4F | 1


def pick(df: DataFrame, *names: str) -> DataFrame:
    """``names`` from ``df``, exact in case, whatever else ``df`` holds.

    Columns are first renamed by position, so further columns whose names clash
    (the same name twice, or differing in case only) do no harm; of two with
    the exact name the first counts.
    """
    at = df.columns
    if missing := [n for n in names if n not in at]:
        raise ValueError(f"missing columns {missing}; there are {at}")
    held = [f"_{i}" for i in range(len(at))]
    return df.toDF(*held).select(*[F.col(held[at.index(n)]).alias(n) for n in names])


def release() -> None:
    """Give what this process holds but does not use back to the system; a worker outlives its task, and other stages need the room."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            self.up, self.down = (self._table(b, self.n) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        out = np.full(n, base & _M, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


_BYTES, _WORDS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def lookup(chars: str) -> np.ndarray:
    """A table of 256 that is true at the given ASCII characters."""
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


def prefix(values: np.ndarray) -> np.ndarray:
    """Running sums with a leading zero, so that a range's sum is a difference."""
    out = np.zeros(len(values) + 1, np.uint64 if values.dtype == np.uint64 else np.int64)
    np.cumsum(values, out=out[1:])
    return out


class Chunk:
    """Words of several whole documents as arrays.

    ``data`` holds the UTF-8 bytes; document ``i`` is ``data[off[i]:off[i + 1]]``.
    ``starts`` and ``ends`` are byte positions of the words of all documents in
    order, ``words[i]:words[i + 1]`` the words of document ``i``.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        self.data, self.off, self.n = data, off, len(off) - 1
        self.solid = ~_IS_SPACE[data]
        begin = self.solid.copy()
        begin[1:] &= ~self.solid[:-1]
        end = self.solid.copy()
        end[:-1] &= ~self.solid[1:]
        inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
        begin[inner] = self.solid[inner]
        end[inner - 1] = self.solid[inner - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.words = prefix(begin)[off]
        self.n_words = np.diff(self.words)

    @property
    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def byte_sums(self) -> tuple[np.ndarray, np.ndarray]:
        up, down = _BYTES.upto(len(self.data) + 1)
        return prefix((self.data.astype(np.uint64) + np.uint64(1)) * up[:-1]), down

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A polynomial hash of each byte range."""
        sums, down = self.byte_sums()
        return mix((sums[ends] - sums[starts]) * down[starts])

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def window_hash(self, word_hash: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rolling (Rabin-Karp) hashes of all windows of ``k`` words within one document, and each one's first word."""
        n = len(word_hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        up, down = _WORDS.upto(n)
        sums = prefix(word_hash * up)
        doc_end = np.repeat(self.words[1:], self.n_words)
        at = np.arange(n - k + 1)
        at = at[at + k <= doc_end[: n - k + 1]]
        return mix((sums[at + k] - sums[at]) * down[at]), at

    def range_hash(self, word_hash: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each range of words; ranges of unlike length differ."""
        up, down = _WORDS.upto(len(word_hash) + 1)
        sums = prefix(word_hash * up[:-1])
        return mix(mix((sums[ends] - sums[starts]) * down[starts]) ^ (ends - starts).astype(np.uint64))

    def per_doc(self, per_byte: np.ndarray) -> np.ndarray:
        """Sums of a value of each byte by document."""
        return np.diff(prefix(per_byte)[self.off])

    def text(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, not copied unless it holds nulls; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    off = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, wide)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw, off.astype(np.int64)


def runs(raw: np.ndarray, off: np.ndarray, most: int = CHUNK_BYTES, table: np.ndarray | None = None) -> Iterator[tuple[slice, Chunk]]:
    """Texts in runs of about ``most`` bytes; a longer one comes alone and whole. ``table`` replaces bytes."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        b = min(b, n)
        data = raw[off[a] : off[b]]
        yield slice(a, b), Chunk(data if table is None else table[data], off[a : b + 1] - off[a])
        a = b


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[slice, Chunk]]:
    """A column's documents in runs."""
    return runs(*text_buffers(column), most)
