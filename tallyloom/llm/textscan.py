"""Vectorised scanning of Arrow text columns: words, word hashes and window hashes in numpy.

Every function works on whole texts.  A column is cut into chunks of whole documents, so memory is
bounded by ``CHUNK_BYTES`` plus the longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
#: Bytes (or words) that are hashed together: bounds the tables of powers.
BLOCK = 1 << 17

#: ASCII lower-casing of single bytes; bytes of multi-byte characters stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of ``[^\x20\x09-\x0D]``.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing: digits, a-z, non-ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def _odd(seed: int) -> np.uint64:
    return np.uint64(int(np.random.default_rng(seed).integers(1 << 62)) * 2 + 1)


def _inverse(p: np.uint64) -> np.uint64:
    return np.uint64(pow(int(p), -1, 1 << 64))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, seed: int):
        self.base = _odd(seed)
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", _inverse(self.base))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = Powers(11), Powers(12)
_BYTE_TABLE = np.random.default_rng(13).integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


@dataclass
class Chunk:
    """Some documents: lower-cased bytes and where each document begins and ends."""

    first: int  # row of the batch
    data: np.ndarray
    offsets: np.ndarray  # one more than documents

    def __len__(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Spans:
    """Words (or lines) of a chunk: byte ranges, and for each document the range of its words."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # one more than documents

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(column: pa.Array, lower: bool = True, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The column in runs of whole documents of about ``size`` bytes."""
    data, offsets = raw(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        part = data[offsets[at] : offsets[to]]
        yield Chunk(at, LOWER[part] if lower else part, offsets[at : to + 1] - offsets[at])
        at = to


def words(chunk: Chunk, kind: np.ndarray = NOT_SPACE) -> Spans:
    """Maximal runs of bytes of ``kind``; documents are never joined."""
    n = len(chunk.data)
    if not n:
        return Spans(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(chunk.offsets), np.int64))
    inside = kind[chunk.data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = chunk.offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begins[edge] |= inside[edge]
    ends[edge - 1] |= inside[edge - 1]
    starts = np.flatnonzero(begins)
    return Spans(starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, chunk.offsets))


def _direct_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _BYTE_POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_TABLE[data] * up[:-1], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def _long_hash(data: np.ndarray) -> np.uint64:
    """Of one long span, a block at a time."""
    total, factor = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    step = np.array([pow(int(_BYTE_POWERS.base), BLOCK, 1 << 64)], np.uint64)
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        total += factor * _direct_hashes(part, np.zeros(1, np.int64), np.array([len(part)]))
        factor = factor * step
    return total[0]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, a block of bytes at a time."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    if len(data) <= BLOCK:
        h = _direct_hashes(data, starts, ends)
    else:
        h = np.empty(len(starts), np.uint64)
        sorted_ = bool((starts[1:] >= starts[:-1]).all())
        order = None if sorted_ else np.argsort(starts, kind="stable")
        s, n = (starts, sizes) if sorted_ else (starts[order], sizes[order])
        at = 0
        while at < len(s):
            begin = int(s[at])
            to = int(np.searchsorted(s, begin + BLOCK, "left"))
            short = n[at:to] <= BLOCK
            mine = np.arange(at, to)[short]
            place = mine if sorted_ else order[mine]
            if len(mine):
                here, size = s[mine] - begin, n[mine]
                h[place] = _direct_hashes(data[begin : begin + int((here + size).max())], here, here + size)
            for k in (np.arange(at, to)[~short] if not short.all() else ()):
                h[k if sorted_ else order[k]] = _long_hash(data[s[k] : s[k] + n[k]])
            at = to
    return mix(h + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive word hashes; windows may cross documents (mask them with ``inner``)."""
    total = len(h) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(total, np.uint64)
    step = max(BLOCK, n)
    for at in range(0, total, step):
        part = h[at : at + step + n - 1]
        up, down = _WORD_POWERS.upto(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[:-1], out=sums[1:])
        out[at : at + step] = (sums[n:] - sums[:-n]) * down[: len(part) - n + 1]
    return mix(out + np.uint64(n))


def inner(bounds: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the windows of ``n`` words lie within one document."""
    ok = np.zeros(max(0, total - n + 1), np.int8)
    long = np.diff(bounds) >= n
    if not len(ok) or not long.any():
        return ok.astype(bool)
    steps = np.zeros(len(ok) + 1, np.int32)
    np.add.at(steps, bounds[:-1][long], 1)
    np.add.at(steps, bounds[1:][long] - n + 1, -1)
    return np.cumsum(steps[:-1]) > 0


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` for ``counts[i]`` numbers each."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(at - starts, counts)


def same_bytes(a: np.ndarray, a_start: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """For each i: are the bytes of span i of ``a`` those of span i of ``b``?"""
    same = (a_end - a_start) == (b_end - b_start)
    i = np.flatnonzero(same)
    n = (a_end - a_start)[i]
    differ = a[expand(a_start[i], n)] != b[expand(b_start[i], n)]
    bad = np.repeat(i, n)[differ]
    same[bad] = False
    return same


class Windows:
    """Hashes of stretches of any length of some bytes, as ``span_hashes`` has them."""

    def __init__(self, data: np.ndarray):
        self.data = data
        if len(data) <= 4 * BLOCK:
            up, self.down = _BYTE_POWERS.upto(len(data) + 1)
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTE_TABLE[data] * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, n: int) -> np.ndarray:
        if len(self.data) > 4 * BLOCK:
            return span_hashes(self.data, starts, starts + n)
        return mix((self.sums[starts + n] - self.sums[starts]) * self.down[starts] + np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64)))


class Lookup:
    """Places of 64-bit numbers in a list; a bitmap answers most that aren't in it."""

    def __init__(self, numbers: np.ndarray):
        self.order = np.argsort(numbers)
        self.sorted = numbers[self.order]
        self.shift = np.uint64(64 - max(10, len(numbers).bit_length() + 4))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[mix(numbers) >> self.shift] = True

    def find(self, numbers: np.ndarray) -> np.ndarray:
        """-1 for numbers that aren't there."""
        out = np.full(len(numbers), -1, np.int32)
        some = np.flatnonzero(self.bits[mix(numbers) >> self.shift])
        if len(some):
            asked = numbers[some]
            k = np.minimum(np.searchsorted(self.sorted, asked), len(self.sorted) - 1)
            out[some] = np.where(self.sorted[k] == asked, self.order[k], -1)
        return out
