"""Whole-batch tokenisation and hashing of UTF-8 bytes in numpy.

Nothing here runs Python code for a single word (but for very long ones): words are found by a table of separator
bytes, and their hashes chain their digits of 8 bytes, so a batch costs a few passes over its bytes and words.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at a time; a longer text is a batch of its own.
BATCH = 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def separators(ranges: str) -> np.ndarray:
    """A table of 256 booleans from hexadecimal ranges such as '20 09-0D'."""
    table = np.zeros(256, bool)
    for part in ranges.split():
        low, _, high = part.partition("-")
        table[int(low, 16) : int(high or low, 16) + 1] = True
    return table


#: White space that ends words, and what isn't a lower-case letter, digit or non-ASCII byte. Fixed values.
SPACES = separators("20 09-0D")
NOT_WORD = separators("00-2F 3A-60 7B-7F")


#: Bytes that are read at a time, and what they keep of a digit at a range's end.
DIGIT = 8
MASKS = np.array([(1 << 8 * n) - 1 for n in range(DIGIT + 1)], np.uint64)


def unaligned(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as an integer, the first byte lowest; past the end they are zero."""
    padded = np.zeros(len(data) + DIGIT, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return _LOWER[data]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(column: pa.Array, limit: int = BATCH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of at most ``limit`` bytes, or of one row."""
    data, offs = text_bytes(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of bytes that are not separators, within rows."""
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(sep[data], out=inside[:-1])
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    first = offs[:-1][offs[:-1] < len(data)]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = ~inside
    after[first] = True
    # a word ends at the first byte after its start that is a separator or starts a row
    ends = np.flatnonzero(after)
    ends = ends[np.searchsorted(ends, starts, "right")] if len(starts) else starts
    rows = np.searchsorted(offs, starts, "right") - 1
    return starts, ends, rows


def counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n)


class Hasher:
    """64-bit hashes of words (ranges of bytes) and of runs of items that are hashes themselves.

    A word's 8-byte digits are chained through a mix by multiplication, from a state that depends on the seed and on the
    word's length, so words of up to 8 bytes never collide and others as random values do; words of over ``LONG`` bytes take
    BLAKE2b. Runs of items are sums of the items times powers modulo 2^64: cheap to slide, and good for finding
    candidates. Whatever must be exact compares the bytes of what it has found.
    """

    BASE = 0x5851F42D4C957F2D
    LONG = 64
    _tables = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.seed = rng.integers(0, 1 << 63, dtype=np.uint64)
        #: Random odd values that stand for bytes as items.
        self.values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._tables[0]) < n:
            made = []
            for base in (cls.BASE, pow(cls.BASE, -1, 1 << 64)):
                p = np.full(max(n, BATCH + 2), base, np.uint64)
                p[0] = 1
                made.append(np.cumprod(p, dtype=np.uint64))
            Hasher._tables = tuple(made)
        return cls._tables

    @staticmethod
    def mixed(h: np.ndarray) -> np.ndarray:
        h = h ^ (h >> np.uint64(31))
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def sums(self, values: np.ndarray) -> np.ndarray:
        up, _ = self.powers(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], dtype=np.uint64, out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, down = self.powers(len(sums))
        return self.mixed((sums[ends] - sums[starts]) * down[starts])

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges."""
        size = ends - starts
        h = self.mixed(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + self.seed)
        if not len(h):
            return h
        digits = unaligned(data)
        short = size <= self.LONG
        live = np.flatnonzero(short & (size > 0))
        for depth in range(0, self.LONG, DIGIT):
            if depth:
                live = live[size[live] > depth]
            if not len(live):
                break
            digit = digits[starts[live] + depth] & MASKS[np.minimum(size[live] - depth, DIGIT)]
            h[live] = self.mixed(h[live] ^ digit)
        key = int(self.seed).to_bytes(8, "little")
        for i in np.flatnonzero(~short).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=key).digest(), "little")
        return h

    def grams(self, items: np.ndarray, k: int) -> np.ndarray:
        """Hashes of each ``k`` consecutive items (uint64)."""
        n = len(items) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        sums = self.sums(items)
        _, down = self.powers(len(sums))
        return self.mixed((sums[k:] - sums[:-k]) * down[:n])


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, long: int = 4096) -> np.ndarray:
    """Booleans: whether the ranges of ``size_a`` bytes at ``a`` and of ``size_b`` bytes at ``b`` hold the same bytes."""
    same = size_a == size_b
    digits = unaligned(data)
    live = np.flatnonzero(same & (size_a <= long))
    depth = 0
    while len(live):
        live = live[size_a[live] > depth]
        differ = (digits[a[live] + depth] ^ digits[b[live] + depth]) & MASKS[np.minimum(size_a[live] - depth, DIGIT)] != 0
        same[live[differ]] = False
        live = live[~differ]
        depth += DIGIT
    for i in np.flatnonzero(same & (size_a > long)).tolist():
        same[i] = np.array_equal(data[a[i] : a[i] + size_a[i]], data[b[i] : b[i] + size_a[i]])
    return same


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values, by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    span, m = 1, x
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[:n], m[width - span : width - span + n])


_AT = 22  # bits of a position within a piece


def super_kmers(grams: np.ndarray, k: int, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimiser's position) of each maximal run of windows with one minimiser.

    A window is ``width`` consecutive items of one row; its minimiser is its k-gram of least hash,
    the leftmost if there are several. So equal windows have equal minimisers at equal offsets.
    Long inputs are cut into pieces of windows, which cuts runs but moves no minimiser.
    """
    n = len(rows) - width + 1
    found = []
    piece = (1 << _AT) - width
    for lo in range(0, max(n, 0), piece):
        hi = min(n, lo + piece)
        g = grams[lo : hi + width - k]
        key = (g >> np.uint64(_AT) << np.uint64(_AT)) | np.arange(len(g), dtype=np.uint64)
        at = (sliding_min(key, width - k + 1) & np.uint64((1 << _AT) - 1)).astype(np.int64)
        valid = rows[lo:hi] == rows[lo + width - 1 : hi + width - 1]
        change = np.ones(hi - lo + 1, bool)
        change[1:-1] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
        s = np.flatnonzero(valid & change[:-1])
        e = np.flatnonzero(valid & change[1:])
        found.append((s + lo, e - s + 1, at[s] + lo))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Booleans of ``n`` items: which lie in any of the half-open ranges."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.subtract.at(depth, ends, 1)
    return np.cumsum(depth[:-1]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _malloc() -> ctypes.CDLL | None:
    """The C library, if it is one that can be told to keep large blocks apart and to give memory back."""
    library = ctypes.CDLL(None)
    return library if hasattr(library, "malloc_trim") and hasattr(library, "mallopt") else None


def trimmed(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """``run``, with large blocks going back to the system when freed, and all free memory after each partition.

    Idle workers would keep it, and an executor has several.
    """

    def wrapped(*args) -> Iterator:
        library = _malloc()
        if library:
            library.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD, which else grows
        yield from run(*args)
        pa.default_memory_pool().release_unused()
        if library:
            library.malloc_trim(0)

    return wrapped
