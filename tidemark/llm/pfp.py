"""Substring dedup over bytes: prefix-free parsing and suffix arrays of dictionary and parse."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.repeats import POWERS, Units, covered, repeated_stretches, with_removed
from tidemark.llm.words import blocks, mix, ragged

WINDOW_BYTES = 200
GRAM_BYTES = 24
#: Bytes of the rolling hash; consecutive phrases of a text overlap by as many.
TRIGGER_BYTES = 8
#: One place in so many triggers a phrase.
TRIGGER_EVERY = 32
#: Bytes of phrases parsed together: a task holds some hundred times as much while it sorts them. Phrases of one key beyond that are
#: parted by other grams of their windows, so many times at most. No result depends on it.
PARSE_BYTES, PARTINGS = 1 << 19, 8

_ROLL = np.uint64(0xA24BAED4963EE407)


def _suffix_ranks(value: np.ndarray, have: int, left: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of suffixes that end ``left`` symbols ahead, from values that order their first ``have`` symbols.

    Equal suffixes get equal ranks; a suffix that is a prefix of another one comes first. Symbols beyond
    ``depth`` need not count. A rank is the number of smaller suffixes, so refining a class leaves all
    others as they are; only classes with members that go on are sorted again.
    """
    n = len(value)
    active = np.argsort(value)
    value = value[active]
    begins = np.append(True, value[1:] != value[:-1])[:n]
    rank = np.empty(n, np.int64)
    rank[active] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    active = active[~(begins & np.append(begins[1:], True)[:n])]
    while len(active) and have < depth:
        goes_on = np.zeros(n, bool)
        goes_on[rank[active[left[active] > have]]] = True
        active = active[goes_on[rank[active]]]
        if not len(active):
            break
        further = np.where(left[active] > have, rank[np.minimum(active + have, n - 1)] + 1, 0)
        key = rank[active] * (n + 2) + further
        order = np.argsort(key)
        active, key = active[order], key[order]
        place = np.arange(len(active))
        old = rank[active]
        begins_old = np.append(True, old[1:] != old[:-1])
        begins_new = np.append(True, key[1:] != key[:-1])
        first_old = np.maximum.accumulate(np.where(begins_old, place, 0))
        first_new = np.maximum.accumulate(np.where(begins_new, place, 0))
        rank[active] = old + first_new - first_old
        alone = begins_new & np.append(begins_new[1:], True)
        active = active[~alone]
        have *= 2
    return rank


class Parse:
    """Prefix-free parse of texts: phrases, their dictionary, and the order of the corpus."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"".join(texts)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.stop = np.cumsum(size)
        self.begin = self.stop - size
        n = len(self.raw)
        self.eight = np.ndarray((n + 1,), "<u8", self.raw + bytes(8), 0, (1,))
        # Triggers: the rolling hash of the bytes from a place on is zero modulo TRIGGER_EVERY.
        rolled = self.eight[:n] * _ROLL
        hit = np.flatnonzero((rolled >> np.uint64(32)) % np.uint64(TRIGGER_EVERY) == 0)
        owner = np.searchsorted(self.stop, hit, "right")
        hit = hit[(hit + TRIGGER_BYTES < self.stop[owner]) & (hit > self.begin[owner])]
        self.head = np.unique(np.concatenate([self.begin[size > 0], hit]))
        text = np.searchsorted(self.stop, self.head, "right")
        ends_text = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
        following = np.append(self.head[1:], n)
        # A phrase runs through the next trigger; the last one of a text runs to its end.
        self.tail = np.where(ends_text, self.stop[text], following + TRIGGER_BYTES)
        self.ends_text = ends_text
        phrases = [self.raw[a:b] + b"$" * e for a, b, e in zip(self.head.tolist(), self.tail.tolist(), ends_text.tolist())]
        self.dictionary = sorted(set(phrases))
        number = {x: i for i, x in enumerate(self.dictionary)}
        self.parse = np.fromiter(map(number.__getitem__, phrases), np.int64, len(phrases))

    def _dictionary_ranks(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Rank of every suffix of every dictionary phrase, and where each phrase begins."""
        size = np.fromiter(map(len, self.dictionary), np.int64, len(self.dictionary))
        stop = np.cumsum(size)
        raw = b"".join(self.dictionary)
        left = np.repeat(stop, size) - np.arange(len(raw))
        eight = np.ndarray((len(raw) + 1,), ">u8", raw + bytes(8), 0, (1,))[: len(raw)].astype(np.uint64)
        # Seven bytes and how many of them the phrase has; bytes beyond its end are cleared.
        inside = np.minimum(left, 7)
        clear = (8 * (8 - inside)).astype(np.uint64)
        first = ((eight >> clear) << clear) | inside.astype(np.uint64)
        return _suffix_ranks(first, 7, left, depth), stop - size

    def _parse_ranks(self, depth: int) -> np.ndarray:
        """Rank of every suffix of the parse, within its text."""
        text = np.searchsorted(self.stop, self.head, "right")
        last = np.searchsorted(text, text, "right")
        return _suffix_ranks(self.parse, 1, last - np.arange(len(self.parse)), depth)

    def order(self, places: np.ndarray, depth: int) -> np.ndarray:
        """``places`` sorted by the texts from there on, as far as ``depth`` bytes.

        A place lies in one phrase, before its last TRIGGER_BYTES. The rest of that phrase comes first in
        the comparison: such rests are prefix-free, so either two differ or they are equal and the
        phrases after them decide.
        """
        ranks, starts = self._dictionary_ranks(depth)
        parse = self._parse_ranks(depth)
        at = np.searchsorted(self.head, places, "right") - 1
        rest = ranks[starts[self.parse[at]] + places - self.head[at]]
        after = np.where(self.ends_text[at], 0, np.append(parse[1:], 0)[at] + 1)
        return places[np.argsort(rest * (len(parse) + 2) + after)]

    def window_hashes(self, size: int) -> np.ndarray:
        """Hash of ``size`` bytes from every place, by a rolling sum over hashes of eight bytes."""
        value = mix(self.eight[: len(self.raw)].astype(np.uint64))
        up, down = POWERS.to(len(value) + 1)
        total = np.append(np.uint64(0), np.cumsum(value * up[: len(value)]))
        stop = np.minimum(np.arange(len(value)) + size - 7, len(value))
        return (total[stop] - total[:-1]) * down[: len(value)]


def shared_windows(content: list[bytes], n: np.ndarray, doc: np.ndarray, start: np.ndarray, places: np.ndarray,
                   size: int = WINDOW_BYTES) -> list[np.ndarray]:
    """Offsets of each phrase's windows that occur twice among the phrases, or in a phrase of several places."""
    begin = np.cumsum(n) - n
    twice = _twice_among(content, n, size)
    out = []
    for at, windows, several in zip(begin.tolist(), n.tolist(), (places > 1).tolist()):
        out.append(np.arange(windows) if several else np.flatnonzero(twice[at : at + windows]))
    return out


def _parsed(content: list[bytes], n: np.ndarray, size: int) -> np.ndarray:
    """Whether each window of the phrases, one phrase after another, occurs twice among them; by one parse."""
    parse = Parse(content)
    places = ragged(parse.begin, n)
    ordered = parse.order(places, size)
    twice = np.zeros(len(parse.raw), bool)
    value = parse.window_hashes(size)[ordered]
    equal = value[1:] == value[:-1]
    twice[ordered[1:][equal]] = True
    twice[ordered[:-1][equal]] = True
    return twice[places]


def _twice_among(content: list[bytes], n: np.ndarray, size: int, parting: int = 0) -> np.ndarray:
    """As ``_parsed``, a bounded number of bytes at a time.

    Windows of too many phrases are dealt by the smallest of their grams in an order of its own for every parting: equal windows
    have it in common and so meet, and what they meet in is parsed, or parted again. Parts of equal content are one phrase, all
    windows of which occur twice. What does not part after PARTINGS is parsed whole.
    """
    total = sum(map(len, content))
    if total <= 2 * PARSE_BYTES or parting == PARTINGS or size < GRAM_BYTES:
        return _parsed(content, n, size)
    units = Units("bytes", size, GRAM_BYTES)
    fields = ("text", "start", "n", "key")
    found = []
    for part in blocks(content, 1 << 17):
        cut = units.stretches(content[part], parting + 1)
        found.append([cut["text"] + part.start, *(cut[f] for f in fields[1:])])
    text, start, count, key = map(np.concatenate, zip(*found))
    # A text has no window beyond its phrase's.
    order = np.argsort(key, kind="stable")
    text, start, count, key = text[order], start[order], count[order], key[order]
    bounds = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    sizes = np.append(0, np.cumsum(count + size - 1))
    offset = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), bool)
    begin = 0
    for i in range(1, len(bounds)):
        stop = int(bounds[i])
        # Whole keys together, as long as the next one fits.
        if i < len(bounds) - 1 and sizes[bounds[i + 1]] - sizes[begin] <= PARSE_BYTES:
            continue
        number: dict[bytes, int] = {}
        which = np.empty(stop - begin, np.int64)
        for j, (t, s, c) in enumerate(zip(text[begin:stop].tolist(), start[begin:stop].tolist(), count[begin:stop].tolist())):
            which[j] = number.setdefault(content[t][s : s + c + size - 1], len(number))
        own = list(number)
        windows = np.fromiter(map(len, own), np.int64, len(own)) - size + 1
        # A single key is parted again, several together are small.
        twice = _twice_among(own, windows, size, parting + 1)
        head = np.cumsum(windows) - windows
        held = np.bincount(which, minlength=len(own))
        several = np.repeat(held > 1, windows)
        at = ragged(offset[text[begin:stop]] + start[begin:stop], count[begin:stop])
        out[at] = (twice | several)[ragged(head[which], count[begin:stop])]
        begin = stop
    return out


def _finish(body: bytes, start: np.ndarray, n: np.ndarray) -> tuple:
    gone = covered(len(body), start, n, WINDOW_BYTES)
    kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
    runs = int(np.count_nonzero(np.diff(np.append(0, gone.astype(np.int8))) == 1))
    return len(body), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept


def byte_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", with_bytes: bool = False) -> DataFrame:
    """Documents without bytes inside a string of 200 bytes that starts in two places or more.

    One row per row of ``docs``: key, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (and
    ``kept``, the bytes left). All places of a repeated string are removed, the first too; strings are judged
    on the input and never cross documents. The key is an integer that identifies a document; rows that
    repeat one lose the strings found under it, rows without a key lose nothing. Missing and empty texts
    have no bytes. Other columns are ignored; an empty table gives an empty result.
    """
    units = Units("bytes", WINDOW_BYTES, GRAM_BYTES, PARSE_BYTES)
    removed = repeated_stretches(docs, units, shared_windows, False, key, text)
    out = with_removed(docs, removed, _finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", key, text)
    return out if with_bytes else out.drop("kept")


def op9_pfp_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
