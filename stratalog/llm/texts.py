"""Vectorised work on UTF-8 text in Arrow batches: words, rolling hashes, sliding minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on together; a longer text forms a block of its own.
BLOCK = 1 << 20
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte.
TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
UNBASE = pow(BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters a-z, digits and all bytes of non-ASCII characters.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
#: All but blank, tab, line feed, vertical tab, form feed and carriage return.
SOLID = np.ones(256, bool)
SOLID[[0x20, 9, 10, 11, 12, 13]] = False


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse, modulo 2**64, for i < n."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK + 64)
        with np.errstate(over="ignore"):
            for key, x in (("up", BASE), ("down", UNBASE)):
                a = np.full(size, x, dtype=np.uint64)
                a[0] = 1
                _powers[key] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose every bit depends on all bits."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


class Rolling:
    """Hashes of any range of a sequence of 64-bit values, after one pass over it."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        up, self.down = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(values * up[: self.n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """The hashes of all ranges of k values, by start."""
        if self.n < k:
            return np.zeros(0, dtype=np.uint64)
        return mixed((self.sums[k:] - self.sums[: self.n + 1 - k]) * self.down[: self.n + 1 - k] + U(k))


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbours, by start (van Herk's doubling)."""
    if len(a) < w:
        return a[:0]
    span = 1
    while span * 2 <= w:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    if span < w:
        a = np.minimum(a[: len(a) - (w - span)], a[w - span :])
    return a


#: Low bits of a selection key that hold the place; the others hold the hash, the same at any place and block size.
PLACE = 26


def chosen(hashes: np.ndarray, w: int, most: int = (1 << PLACE) - 1) -> np.ndarray:
    """For each window of w hashes the place of its least one, the last of equal ones: equal windows choose alike."""
    if len(hashes) > most:  # overlapping stretches, whose windows choose as they do in the whole
        step = max(1, most - w + 1)
        return np.concatenate([chosen(hashes[s : s + step + w - 1], w, max(most, step + w - 1)) + s for s in range(0, len(hashes) - w + 1, step)])
    mask = U((1 << PLACE) - 1)
    keys = (hashes & ~mask) | (mask - np.arange(len(hashes), dtype=np.uint64))
    return (mask - (sliding_min(keys, w) & mask)).astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary column and each row's start and end; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    n = len(column)
    off = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1, offset=column.offset * 8) if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    if column.null_count:
        lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(off), 0)
        return data, np.stack([off[:-1], off[:-1] + lengths])
    return data, np.stack([off[:-1], off[1:]])


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with together at most so many bytes (or one row): first row, end row, bytes, n + 1 offsets."""
    data, (start, end) = text_bytes(column)
    n, i = len(start), 0
    sizes = end - start
    while i < n:
        j, total = i + 1, int(sizes[i])
        while j < n and total + sizes[j] <= most:
            total += int(sizes[j])
            j += 1
        if int(end[j - 1] - start[i]) == total:
            part = data[start[i] : end[j - 1]]
        else:
            part = np.concatenate([data[start[r] : end[r]] for r in range(i, j)])
        off = np.zeros(j - i + 1, np.int64)
        np.cumsum(sizes[i:j], out=off[1:])
        yield i, j, part, off
        i = j


class Words:
    """The words of a block of texts: byte ranges, text of each, 64-bit hashes."""

    def __init__(self, data: np.ndarray, off: np.ndarray, inside: np.ndarray):
        self.low = LOWER[data]
        n = len(data)
        mask = inside[self.low]
        starts, ends = mask.copy(), mask.copy()
        starts[1:] &= ~mask[:-1]
        ends[:-1] &= ~mask[1:]
        heads = off[:-1][off[:-1] < n]
        starts[heads] = mask[heads]
        tails = off[1:][off[1:] > 0] - 1
        ends[tails] = mask[tails]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        #: Place of the first word of each text, and after the last.
        self.first = np.searchsorted(self.start, off)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return Rolling(TABLE[self.low])(self.start, self.end)

    def joined(self, i: int, j: int) -> bytes:
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.start[i:j].tolist(), self.end[i:j].tolist()))
