"""Whole texts of an Arrow batch as one byte buffer: words, their hashes, and sliding minima.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return. All functions work on plain numpy arrays inside a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Bytes of text handled at a time; a longer document is handled alone.
BLOCK_BYTES = 1 << 20


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all elements of the ranges (start, size), one range after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random unsigned 64-bit integers."""
    step = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(step + np.uint64(seed * 0x632BE59BD9B4E019 % 2**64))


_FACTOR = np.uint64(0x9FB21C651E98DF25)
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Bytes of a word hashed by vector operations; what lies beyond in a longer word is hashed apart.
_VECTOR_BYTES = 128


def blobs(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; a missing text is empty."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    binary = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(binary).fill_null(b"").to_pylist()


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[slice]:
    """Consecutive ranges of texts of at most ``limit`` bytes, or of one text."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


class Words:
    """Words of several texts: byte spans, text number of each word, and text bounds in words."""

    def __init__(self, texts: list[bytes], space: np.ndarray = SPACE):
        self.raw = b" ".join(texts)
        self.data = np.frombuffer(self.raw, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
        self.text_end = self.text_start + sizes
        self.gap = space[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], self.gap, [True]])))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.text_start)
        self.last = np.append(self.first[1:], len(self.start))
        self.text = np.repeat(np.arange(len(texts)), self.last - self.first)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, raw: bytes | None = None) -> np.ndarray:
        """64-bit hash of every word, equal for equal bytes; ``raw`` replaces the bytes of the texts."""
        raw = self.raw if raw is None else raw
        eight = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), 0, (1,))  # eight bytes from every place
        size = self.end - self.start
        out = size.astype(np.uint64) * _FACTOR
        at = np.arange(len(self))
        for done in range(0, _VECTOR_BYTES, 8):
            if not len(at):
                break
            left = size[at] - done
            part = eight[self.start[at] + done] & _MASK[np.minimum(left, 8)]
            out[at] = mix(out[at] ^ part) * _FACTOR
            at = at[left > 8]
        for i in at.tolist():
            rest = hashlib.blake2b(raw[self.start[i] + _VECTOR_BYTES : self.end[i]], digest_size=8).digest()
            out[i] ^= np.frombuffer(rest, "<u8")[0]
        return mix(out)

    def count(self, mask: np.ndarray) -> np.ndarray:
        """Number of marked bytes in each text."""
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[self.text_end] - total[self.text_start]


def grams(hashes: np.ndarray, n: int, seed: int = 3) -> np.ndarray:
    """Hash of every ``n`` consecutive words, by the first of them; shorter input gives none."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j, factor in enumerate(stream(seed, n) | np.uint64(1)):
        out += hashes[j : j + len(out)] * factor
    return mix(out)


def window_min(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every ``n`` consecutive values."""
    width, out = 1, values
    while 2 * width <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    if width < n:
        out = np.minimum(out[: len(out) - (n - width)], out[n - width :])
    return out
