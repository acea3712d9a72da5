"""Whole texts of an Arrow batch as flat byte arrays: words, hashes, shingles.

Everything is vectorised over a block of documents, so that no Python object
is made for each word.  A block holds whole texts: as many as fit in the
given number of bytes, or one longer text alone.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_LIBC = ctypes.CDLL(None)
# One allocator for arrays and Arrow buffers, so that give_back() reaches both.
pa.set_memory_pool(pa.system_memory_pool())


def give_back() -> None:
    """Returns what is free to the system; else a Python worker that Spark uses again keeps the memory of the largest batch that it ever had."""
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


_P = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, pow(_P, -1, 2**64))):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them); null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi
    give_back()


def word_spans(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes for which ``is_word`` (a table of 256) holds."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    w = np.zeros(n + 1, bool)
    w[:n] = is_word[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = w[:-1]
    starts = np.flatnonzero(w & (~before | first))
    ends = np.flatnonzero(before & (~w | first))
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, independent of where it stands."""
    p, ip = powers(len(data) + 1)
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * p[:-1], out=h[1:])
    return mix((h[ends] - h[starts]) * ip[starts])


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each k consecutive words of a row, and where they start among the words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[:n] == rows[k - 1 :])
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[at + j], j + 1)
    return h, at


#: Words are runs of bytes other than space and TAB to CR.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False


def by_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The order that sorts by row, then by value."""
    o = np.argsort(values)
    return o[np.argsort(rows[o].astype(np.uint16) if len(rows) == 0 or rows.max() < 65536 else rows[o], kind="stable")]
