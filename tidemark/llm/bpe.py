"""Byte-level BPE by merge replay: every merge in rank order over an index from pairs to positions."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.pieces import PieceCache
from tidemark.llm.words import blobs, blocks, ragged
from tidemark.shipping import ship_package

#: Bytes of text whose new words are replayed together.
REPLAY_BYTES = 4 << 20
#: Pieces whose ids a worker keeps: some 50 MB, which stay with it when the next stage runs there.
CACHED_PIECES = 200_000
_NONE = np.int64(1) << 40


class Merges:
    """A vocabulary of byte strings with ranks; the rank of a token is its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        # White space by its Unicode property, whatever the regular-expression library means by \s.
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.base = np.int64(len(self.bytes_of))
        self.size_of = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.start_of = np.cumsum(self.size_of) - self.size_of
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        pairs = {}
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * int(self.base) + b] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()] + [_NONE], np.int64)
        self.pairs = pairs

    @classmethod
    def load(cls, path: str, pattern: str) -> Merges:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        found = self.keys[np.minimum(at, len(self.keys) - 1)] == key
        return np.where(found, self.merged[at], _NONE)

    def one_by_one(self, word: bytes) -> list[int]:
        """Ids of one word: the leftmost pair of the lowest rank merges until none is left."""
        ids = [self.ranks[word[i : i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            rank, i = min((self.pairs.get(a * int(self.base) + b, int(_NONE)), i) for i, (a, b) in enumerate(zip(ids, ids[1:])))
            if rank == _NONE:
                break
            ids[i : i + 2] = [rank]
        return ids

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of every word as little-endian unsigned 32-bit integers.

        All words form one array of symbols with links to the next and the previous symbol of the
        same word. An index maps a rank to the positions where a pair of that rank starts; ranks are
        taken from a heap, lowest first. A merge touches its position and the pairs on both sides.
        """
        n = sum(map(len, words))
        if not n:
            return [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(size)
        begin = stop - size
        symbol = np.append(self.byte[np.frombuffer(b"".join(words), np.uint8)], 0)
        after, before = np.arange(1, n + 2), np.arange(-1, n)  # n stands for no symbol
        after[stop[size > 0] - 1] = n
        before[begin[size > 0]] = n
        rank = np.full(n + 1, _NONE)
        inner = np.flatnonzero(after[:n] < n)
        rank[inner] = self._rank(symbol[inner], symbol[after[inner]])
        alive = np.ones(n + 1, bool)
        odd: set[int] = set()
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(positions: np.ndarray) -> None:
            ranks = rank[positions]
            known = ranks < _NONE
            positions, ranks = positions[known], ranks[known]
            if not len(positions):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            firsts = ranks[cuts[:-1]].tolist()
            for r, a, b in zip(firsts, cuts, cuts[1:]):
                if (had := index.get(r)) is None:
                    index[r] = [positions[a:b]]
                    heapq.heappush(heap, r)
                else:
                    had.append(positions[a:b])

        file(inner)
        while heap:
            now = heapq.heappop(heap)
            at = index.pop(now)
            at = np.unique(np.concatenate(at))
            at = at[rank[at] == now]
            if len(at) > 1:
                chained = after[at[:-1]] == at[1:]
                if chained.any():  # of overlapping pairs every second one merges, from the left
                    run = np.arange(len(at))
                    head = np.maximum.accumulate(np.where(np.append(True, ~chained), run, 0))
                    at = at[(run - head) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbol[at] = now
            alive[gone] = False
            rank[gone] = _NONE
            behind = after[gone]
            after[at] = behind
            before[behind] = at
            left = before[at]
            left = left[left < n]
            touched = np.concatenate([at, left]) if len(left) else at
            right = after[touched]
            new = np.where(right < n, self._rank(symbol[touched], symbol[right]), _NONE)
            rank[touched] = new
            if (new < now).any():  # a lower rank appears late: such words are merged one by one
                odd.update(np.searchsorted(stop, touched[new < now], "right").tolist())
            file(touched)
        ids = symbol[:n][alive[:n]].astype("<u4").tobytes()
        ends = np.append(0, np.cumsum(alive[:n]))[np.append(0, stop)] * 4
        out = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        for i in odd:
            out[i] = np.array(self.one_by_one(words[i]), "<u4").tobytes()
        return out

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of every piece of text; each match of the pattern is a word of its own."""
        found = [self.pattern.findall(x) for x in pieces]
        words = list({w for ws in found for w in ws})
        ids = dict(zip(words, self.replay([w.encode() for w in words])))
        return [ids[ws[0]] if len(ws) == 1 else b"".join(map(ids.__getitem__, ws)) for ws in found]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.all_bytes[ragged(self.start_of[ids], self.size_of[ids])].tobytes()


@lru_cache(maxsize=2)
def _cache(path: str, pattern: str) -> tuple[Merges, PieceCache]:
    merges = Merges.load(path, pattern)
    return merges, PieceCache(merges.encode, CACHED_PIECES)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text",
                   ids: bool = False) -> DataFrame:
    """Encode and decode every whole text: key, n_tokens, ids_sha256, decoded_sha256.

    With ``ids`` also the ids as array<long> (``token_ids``). ``path`` is a file of ranks that every
    worker can open. A missing or empty text has no ids. Rows are handled one by one where they are
    read, so repeated keys stay; an empty table gives an empty result and other columns are ignored.

    Merges never cross a word, so each task replays them over the distinct words of a stretch of
    its documents (4 MB of text, the vocabulary of which is what the inverted index covers) and
    keeps the ids of words it has met. The ids are those of a replay over the whole corpus.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, cache = _cache(path, pattern)
        for batch in batches:
            texts = blobs(batch.column(1))
            for part in blocks(texts, REPLAY_BYTES):
                found = cache.ids(texts[part])
                columns = [batch.column(0)[part.start : part.stop], pa.array([len(x) for x in found], pa.int64()),
                           pa.array([hashlib.sha256(x).hexdigest() for x in found]),
                           pa.array([hashlib.sha256(merges.decode(x)).hexdigest() for x in found])]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns.append(pa.array([x.astype(np.int64) for x in found], pa.list_(pa.int64())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = (f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
              + ", token_ids array<long>" * ids)
    return docs.select(docs[key], docs[text]).mapInArrow(run, schema)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                          tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
