"""Words and hashes of Arrow text columns, computed on whole batches with numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. The text is
never decoded: white space is ASCII, so a byte scan of UTF-8 finds the same
words as the pattern ``[^\\x20\\x09-\\x0D]+`` over code points.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

ODD = np.uint64(0x9E3779B97F4A7C15)
MUL = np.uint64(0xBF58476D1CE4E5B9)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the row offsets into them; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@dataclass
class Words:
    """Words of a batch in order: row r has words first[r]:first[r + 1]."""

    first: np.ndarray
    codes: np.ndarray  # index of each word in vocabulary
    vocabulary: pa.Array
    start: np.ndarray  # byte span of each word in data
    end: np.ndarray
    data: np.ndarray

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        if not len(self.codes):
            return np.zeros(0, np.uint64)
        digest = xxhash.xxh3_64_intdigest
        own = np.fromiter((digest(w) for w in self.vocabulary.to_pylist()), np.uint64, len(self.vocabulary))
        return own[self.codes]

    def rows(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(texts: pa.Array, lower: bool = False) -> Words:
    data, offsets = raw(texts)
    if lower and len(data):
        data = _LOWER[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(len(offsets), np.int64), none, pa.array([], pa.string()), none, none, data)
    solid = ~_SPACE[data]
    head, tail = solid.copy(), solid.copy()
    head[1:] &= ~solid[:-1]
    tail[:-1] &= ~solid[1:]
    full = np.flatnonzero(np.diff(offsets))
    head[offsets[full]] = solid[offsets[full]]
    tail[offsets[full + 1] - 1] = solid[offsets[full + 1] - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=at[1:])
    body = data[solid]
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(body)])
    coded = column.dictionary_encode()
    return Words(np.searchsorted(start, offsets), coded.indices.to_numpy(), coded.dictionary, start, end, data)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * MUL
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive items, by the position of the first (n - k + 1 values)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = hashes[:n] * ODD
    for j in range(1, k):
        h ^= h >> np.uint64(32)
        h += hashes[j : j + n]
        h *= ODD
    h ^= h >> np.uint64(29)
    return h


def within(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the windows of k items that lie in one row, and the first window of each row among them."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    begin = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=begin[1:])
    return np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], counts), begin


_LIBC = ctypes.CDLL(None)


def trim() -> None:
    """Gives freed memory back to the system; workers live on between tasks and share an executor's room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def batches(frames: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.Table]:
    """The rows of a task again, as tables of at most most_bytes of text in column (a longer text stands alone)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for frame in frames:
        lengths = np.diff(raw(frame.column(column))[1])
        begin = 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > most_bytes:
                if i > begin:
                    held.append(frame.slice(begin, i - begin))
                yield pa.Table.from_batches(held).combine_chunks()
                held, size, begin = [], 0, i
                trim()
            size += n
        if len(lengths) > begin:
            held.append(frame.slice(begin))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    held = []
    trim()


def chunk(table: pa.Table, column: str) -> pa.Array:
    """A column of a combined table as one array."""
    c = table.column(column)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)
