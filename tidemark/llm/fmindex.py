"""Substring dedup: an FM-index per shard, searched backwards over a wavelet matrix."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.repeats import Units, covered, repeated_stretches, with_removed
from tidemark.llm.words import Words

WINDOW_WORDS = 20
GRAM_WORDS = 6


class Bits:
    """Bits in 64-bit words with a running count, for ranks in constant time."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        padded[: len(packed)] = packed
        self.words = padded.view("<u8")
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words)))[:-1].astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Number of ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletMatrix:
    """Symbols by bits, highest first; each level has its zeros before its ones."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.depth = depth
        self.levels: list[tuple[Bits, int]] = []
        for level in range(depth - 1, -1, -1):
            ones = (symbols >> level & 1).astype(bool)
            self.levels.append((Bits(ones), int(len(ones) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

        # Where each symbol's places begin after the last level: the same for every rank of it.
        every = np.arange(1 << depth)
        self.begin = self._descend(every, np.zeros(len(every), np.int64)) if len(symbols) else np.zeros(1 << depth, np.int64)

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(self.levels):
            one = (symbol >> (self.depth - 1 - level) & 1).astype(bool)
            ones = bits.rank(at)
            at = np.where(one, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Number of places before ``at`` that hold ``symbol``."""
        return self._descend(symbol, at) - self.begin[symbol]


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def _order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by their first ``depth`` symbols, and whether each shares ``depth - 1`` with the one before.

    Ranks by a few packed symbols are doubled as long as needed; the last step overlaps.
    """
    n = len(symbols)
    bits = int(symbols.max() + 1).bit_length()
    at = lambda r, d: np.append(r[d:], np.full(min(d, n), -1)) + 1
    have = max(1, min(62 // bits, depth - 1))
    packed = symbols + 1
    for d in range(1, have):
        packed = (packed << bits) | at(symbols, d)
    rank = _dense(packed)
    while 2 * have < depth - 1:
        rank = _dense(rank * (n + 2) + at(rank, have))
        have *= 2
    order = np.argsort(rank * (n + 2) + at(rank, depth - have))
    first, rest = rank[order], at(rank, depth - 1 - have)[order]
    return order, np.append(False, (first[1:] == first[:-1]) & (rest[1:] == rest[:-1]))


class FMIndex:
    """Index of texts over integer symbols from 1; 0 separates texts.

    Suffixes are ordered by their first ``depth`` symbols, which is all that patterns of at most
    ``depth`` symbols need.
    """

    def __init__(self, symbols: np.ndarray, depth: int):
        self.depth = depth
        self.order, shares = _order(symbols, depth)
        last = symbols[self.order - 1]
        last[self.order == 0] = 0
        self.below = np.append(0, np.cumsum(np.bincount(symbols)))
        self.tree = WaveletMatrix(last, max(1, int(symbols.max()).bit_length()))
        heads = np.flatnonzero(~shares)
        which = np.cumsum(~shares) - 1
        self.parent_low = heads[which]
        self.parent_high = np.append(heads[1:], len(shares))[which]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the patterns with one more symbol in front."""
        both = self.tree.rank(np.append(symbol, symbol), np.append(low, high)) + np.append(self.below[symbol], self.below[symbol])
        return both[: len(symbol)], both[len(symbol):]

    def statistics(self, symbols: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of streamed texts ``symbols[begin:stop]``: length and range at each place.

        All texts are read backwards side by side. A match longer than ``depth`` is not followed: it
        drops its last symbol (the range widens to the suffixes that share one symbol less). A text that
        leaves the index starts again from an empty match.
        """
        n = len(symbols)
        length, lows, highs = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        low, high = np.zeros(len(begin), np.int64), np.full(len(begin), len(self.order), np.int64)
        matched = np.zeros(len(begin), np.int64)
        live, place = np.arange(len(begin)), stop - 1
        live = live[place >= begin]
        while len(live):
            at = place[live]
            full = live[matched[live] == self.depth]
            low[full], high[full] = self.parent_low[low[full]], self.parent_high[low[full]]
            matched[full] -= 1
            a, b = self.extend(symbols[at], low[live], high[live])
            lost = a >= b
            if lost.any():
                again = live[lost]
                a[lost], b[lost] = self.below[symbols[place[again]]], self.below[symbols[place[again]] + 1]
                matched[again] = 0
            low[live], high[live] = a, b
            matched[live] += a < b
            length[at], lows[at], highs[at] = matched[live], a, b
            place[live] -= 1
            live = live[place[live] >= begin[live]]
        return length, lows, highs


def earlier_windows(content: list[bytes], n: np.ndarray, doc: np.ndarray, start: np.ndarray, places: np.ndarray,
                    size: int = WINDOW_WORDS) -> list[np.ndarray]:
    """Offsets of each phrase's windows that also start earlier in another phrase of the shard, or in itself."""
    words = Words(content)
    ids = _dense(words.hashes()) + 1
    count = words.last - words.first
    # One separator after each phrase.
    stop = np.cumsum(count + 1) - 1
    begin = stop - count
    symbols = np.zeros(int(stop[-1]) + 1, np.int64)
    symbols[np.arange(len(ids)) + words.text] = ids
    index = FMIndex(symbols, size)
    length, low, high = index.statistics(symbols, begin, stop)
    # The place of every symbol in the order of documents, and the first place of every range.
    owner = np.repeat(np.arange(len(content)), count + 1)
    offset = np.arange(len(symbols)) - begin[owner]
    turn = np.empty(len(symbols), np.int64)
    turn[np.lexsort((start[owner] + offset, doc[owner]))] = np.arange(len(symbols))
    at = np.flatnonzero((length >= size) & (offset < n[owner]))
    heads, which = np.unique(low[at], return_inverse=True)
    ends = high[at][np.unique(which, return_index=True)[1]] if len(at) else heads
    first = np.zeros(0, np.int64)
    if len(at):
        cuts = np.stack([heads, ends], 1).ravel()
        first = np.minimum.reduceat(np.append(turn[index.order], len(symbols)), cuts)[::2]
    late = at[first[which] < turn[at]] if len(at) else at
    of, away = owner[late], offset[late]
    bounds = np.searchsorted(of, np.arange(len(content) + 1))
    return [away[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _finish(body: bytes, start: np.ndarray, n: np.ndarray) -> tuple:
    words = Words([body])
    gone = covered(len(words), start, n, WINDOW_WORDS)
    kept = b" ".join([body[a:b] for a, b in zip(words.start[~gone].tolist(), words.end[~gone].tolist())])
    return len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept


def word_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Documents without words inside a window of 20 words that also starts earlier.

    One row per row of ``docs``: key, n_words, n_removed, kept_sha256 (and ``kept``, the words left,
    joined by spaces). Earlier means a smaller key, or the same document at an earlier place; windows
    are judged on the input. The key is an integer that identifies a document; rows that repeat one lose the
    windows found under it, rows without a key lose nothing. Missing and empty texts have no words, texts
    of fewer than 20 words no window. Other columns are ignored; an empty table gives an empty result.
    """
    units = Units("words", WINDOW_WORDS, GRAM_WORDS)
    removed = repeated_stretches(docs, units, earlier_windows, True, key, text)
    out = with_removed(docs, removed, _finish, "n_words long, n_removed long, kept_sha256 string, kept binary", key, text)
    return out.withColumn("kept", out.kept.cast("string")) if with_text else out.drop("kept")


def op3_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
