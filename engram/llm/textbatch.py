"""Word spans and 64-bit word hashes over Arrow text columns, vectorised with numpy.

Texts are handled as UTF-8 bytes, so separators must be ASCII; every byte of a
multi-byte character is 0x80 or more. Work goes in slices of about
``SLICE_BYTES`` of text (one document at least), which bounds memory by the
slice or the largest document, whatever the size of the Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018 - absent from other C libraries
except (OSError, AttributeError):
    _LIBC = None

U64 = np.uint64


def release_memory() -> None:
    """Give freed memory back to the system: Python workers stay for later tasks, and so would what they hold."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_STEP = U64(0x9E3779B97F4A7C15)
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def lower_ascii() -> np.ndarray:
    """Byte map that lower-cases A-Z only."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


def white_space_separates() -> np.ndarray:
    """True for bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    word = np.ones(256, bool)
    word[[0x20, *range(0x09, 0x0E)]] = False
    return word


def alphanumeric_words() -> np.ndarray:
    """True for bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of lower-cased text."""
    word = np.zeros(256, bool)
    for low, high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        word[low : high + 1] = True
    return word


def letters_only() -> np.ndarray:
    """True for bytes of words ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``."""
    word = alphanumeric_words()
    word[0x30:0x3A] = False
    return word


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    first, rows = 0, len(column)
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, rows, first + 60_000)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """The texts of a column, one at a time; bytes that aren't UTF-8 become replacement characters."""
    for value in column.cast(pa.binary()):
        yield value.as_py().decode("utf-8", "replace") if value.is_valid else None


class Words:
    """Word spans of a slice: ``start`` and ``end`` bytes, and ``first``, the word index at which each row begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        n = len(data)
        self.data, self.offsets = data, offsets
        mask = is_word[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:] = mask[:-1]
        after[:-1] = mask[1:]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.start = np.flatnonzero(mask & ~before)
        self.end = np.flatnonzero(mask & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, fold: np.ndarray | None = None) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end, fold)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the spans' bytes after ``fold``; spans aren't empty.

    Eight bytes at a time are mixed with their place in the span, so that no rule
    of the bytes (as of Thue-Morse words under powers of a base) carries over to the sum.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data if fold is None else fold[data]
    blocks = (end - start + 7) >> 3
    first = np.cumsum(blocks) - blocks
    place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    at = np.repeat(start, blocks) + 8 * place
    eight = np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))[at] & _LOW_BYTES[np.minimum(np.repeat(end, blocks) - at, 8)]
    sums = np.zeros(len(at) + 1, U64)
    np.cumsum(mix(eight + (place + 1).astype(U64) * _STEP), out=sums[1:])
    return mix(sums[first + blocks] - sums[first] + (end - start).astype(U64))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, row borders aside; ``len(h) - k + 1`` values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.full(n, k, U64)
    for j in range(k):
        out = out * U64(0x2545F4914F6CDD1D) + h[j : j + n]
    return mix(out)


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Word positions at which a run of ``k`` words stays in its row."""
    total = int(first[-1])
    if total < k:
        return np.empty(0, np.int64)
    ok = np.ones(total, bool)
    for j in range(1, k):
        at = first[1:] - j
        ok[at[(at >= first[:-1])]] = False
    return np.flatnonzero(ok)
