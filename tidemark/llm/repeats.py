"""Windows of fixed length that occur more than once: routing of shared stretches to shards.

A document is a sequence of units (bytes, or words by their hashes). All windows of ``size``
units whose smallest gram hash is the same, one after another, make a stretch. Equal windows have
equal smallest grams, so they meet under one key; a stretch whose key occurs once, with its smallest
gram in one place, holds no repeated window and is not moved any further. Stretches of equal content are one phrase with its first
place and its number of places. An index per shard of phrases (``fmindex``, ``pfp``) then tells which
windows of a phrase occur elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.words import Words, blobs, blocks, grams, mix, ragged, stream, window_min
from tidemark.session import stage
from tidemark.shipping import ship_package

#: Bytes of text cut at a time: small enough that the arrays over it stay in a processor's cache.
BLOCK_BYTES = {"words": 1 << 17, "bytes": 1 << 15}
#: Windows of a stretch at most; a longer one (periodic text) is continued as another stretch.
LONGEST = 1024
#: Bytes of phrases indexed together, if the units do not say otherwise; a key with more phrases than that makes a larger shard of its own.
SHARD_BYTES = 2 << 20

_ODD = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_ODD), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.cumprod(out, out=out)
    return out


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = _powers(_ODD, 2 * n), _powers(_INVERSE, 2 * n)
        return self.up, self.down


POWERS = _Powers()


def _twice(values: np.ndarray, wanted: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether each wanted value stands at two or more places of ``begin`` .. ``stop - 1``."""
    low = np.uint64(0xFFFF)
    maybe = np.zeros(1 << 16, bool)
    maybe[wanted & low] = True
    at = np.flatnonzero(maybe[values & low])
    known, number = np.unique(wanted, return_inverse=True)
    found = np.minimum(np.searchsorted(known, values[at]), len(known) - 1)
    same = known[found] == values[at]
    step = len(values) + 1
    places = np.sort(found[same] * step + at[same])
    second = np.searchsorted(places, number * step + begin) + 1
    return np.append(places, np.iinfo(np.int64).max)[np.minimum(second, len(places))] < number * step + stop


@dataclass(frozen=True)
class Units:
    """What a window counts: ``size`` units, routed by the smallest hash of ``gram`` units."""

    kind: str  # "words" or "bytes"
    size: int
    gram: int
    shard: int = SHARD_BYTES

    @property
    def self_repeats(self) -> int:
        """Grams of a window. A stretch of more windows has its smallest gram in two places; a shorter one may."""
        return self.size - self.gram + 1

    def hashes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gram hashes over the texts one after another, and the first and last unit of each text."""
        if self.kind == "words":
            words = Words(texts)
            return grams(words.hashes(), self.gram), words.first, words.last
        raw = b"".join(texts)
        last = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        first = np.append(0, last[:-1]) if len(texts) else last
        n = max(0, len(raw) - self.gram + 1)
        eight = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), 0, (1,))
        out = np.zeros(n, np.uint64)
        spots = [*range(0, self.gram - 7, 8)]
        if spots[-1] + 8 < self.gram:
            spots.append(self.gram - 8)
        for spot, factor in zip(spots, stream(5, len(spots)) | np.uint64(1)):
            out ^= eight[spot : spot + n]
            out *= factor
            out ^= out >> np.uint64(32)
        out *= _ODD
        return out, first, last

    def stretches(self, texts: list[bytes], salt: int = 0) -> dict[str, np.ndarray]:
        """Text number, first window, number of windows, key and content hash of all stretches.

        Another ``salt`` makes another gram the smallest. ``twice`` marks those with their smallest gram in two places: only they may hold the same window twice.
        """
        values, first, last = self.hashes(texts)
        if salt:
            values = mix(values ^ stream(salt, 1))
        empty = np.zeros(0, np.int64)
        least = window_min(values, self.self_repeats) if len(values) >= self.self_repeats else empty
        # A new stretch begins where the key changes and at every text; windows across texts count for nothing.
        stop_of = last - self.size + 1
        texts_with = np.flatnonzero(stop_of > first)
        if not len(texts_with):
            return {"text": empty, "start": empty, "n": empty, "key": empty, "tag": empty,
                    "twice": np.zeros(0, bool)}
        new = np.empty(len(least), bool)
        new[0] = True
        np.not_equal(least[1:], least[:-1], out=new[1:])
        new[first[texts_with]] = True
        head = np.flatnonzero(new)
        owner = texts_with[np.maximum(np.searchsorted(first[texts_with], head, "right") - 1, 0)]
        inside = (head >= first[owner]) & (head < stop_of[owner])
        following = np.append(head[1:], len(least))
        head, owner, following = head[inside], owner[inside], following[inside]
        count = np.minimum(following, stop_of[owner]) - head
        if (count > LONGEST).any():
            parts = -(-count // LONGEST)
            step = ragged(np.zeros(len(parts), np.int64), parts) * LONGEST
            head, owner, count = np.repeat(head, parts) + step, np.repeat(owner, parts), np.repeat(count, parts) - step
            count = np.minimum(count, LONGEST)
        begin = head
        stop = begin + count + self.size - self.gram  # last gram of the stretch, plus one
        up, down = POWERS.to(len(values) + 1)
        total = np.append(np.uint64(0), np.cumsum(values * up[: len(values)]))
        tag = mix((total[stop] - total[begin]) * down[begin] + count.astype(np.uint64))
        return {"text": owner, "start": begin - first[owner], "n": count,
                "key": mix(least[head]).view(np.int64), "tag": tag.view(np.int64),
                "twice": _twice(values, least[head], begin, stop)}

    def cut(self, text: bytes, words: Words | None, start: int, n: int) -> bytes:
        """Bytes of a stretch."""
        if words is None:
            return text[start : start + n + self.size - 1]
        return text[words.start[start] : words.end[start + n + self.size - 2]]


def _pack(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key and compressed text: what a join of whole texts has to shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in blocks(texts := blobs(batch.column(1))):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part.start : part.stop], pa.array([pack.compress(x) for x in texts[part]], pa.binary())],
                    ["doc", "packed"])

    return docs.select(docs[key].cast("long"), docs[text]).mapInArrow(run, "doc long, packed binary")


Kernel = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]


def repeated_stretches(docs: DataFrame, units: Units, kernel: Kernel, keep_first: bool,
                       key: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows to remove as rows (doc, start, n): ``n`` windows from unit ``start`` of document ``doc``.

    ``kernel`` gets the contents, windows, first documents, first places and numbers of places of the
    phrases of a shard and gives the offsets of each phrase's windows that its first place loses. All
    other places of a phrase lose all their windows; without ``keep_first`` so does the first.
    """
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select(docs[key].cast("long").alias("doc"), docs[text].alias("text")).where("doc is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for part in blocks(texts := blobs(batch.column(1)), BLOCK_BYTES[units.kind]):
                found = units.stretches(texts[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found["key"]), pa.array(found["tag"]), pa.array(ids[part][found["text"]]),
                     pa.array(found["start"].astype(np.int32)), pa.array(found["n"].astype(np.int16)), pa.array(found["twice"])],
                    ["key", "tag", "doc", "start", "n", "twice"])

    stretches = source.mapInArrow(cut, "key long, tag long, doc long, start int, n short, twice boolean")
    shared = (stretches.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max("twice").alias("twice"))
              .where((F.col("c") > 1) | F.col("twice")).select("key"))
    places = stage(stretches.drop("twice").join(shared, "key", "left_semi"), "places")
    phrases = (places.groupBy("key", "tag").agg(F.min(F.struct("doc", "start")).alias("first"), F.max("n").alias("n"),
                                                F.count(F.lit(1)).alias("places")))
    wanted = (phrases.select(F.col("first.doc").alias("doc"), F.struct("key", "tag", F.col("first.start").alias("start"), "n", "places").alias("p"))
              .groupBy("doc").agg(F.collect_list("p").alias("phrases")))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        schema = pa.schema([("key", pa.int64()), ("tag", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()),
                            ("n", pa.int16()), ("places", pa.int64()), ("content", pa.binary())])
        for batch in batches:
            for i in range(len(batch)):
                body = unpack.decompress(batch.column(1)[i].as_py(), max_output_size=0)
                lists = batch.column(2)[i].values
                p = {f: pc.struct_field(lists, f).to_numpy() for f in ("key", "tag", "start", "n", "places")}
                words = Words([body]) if units.kind == "words" else None
                # A few thousand phrases at a time: those of a long text are several times its size.
                for a in range(0, len(lists), 4096):
                    of = {f: v[a : a + 4096] for f, v in p.items()}
                    content = [units.cut(body, words, s, n) for s, n in zip(of["start"].tolist(), of["n"].tolist())]
                    docs_ = pa.array(np.full(len(content), batch.column(0)[i].as_py(), np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(of["key"]), pa.array(of["tag"]), docs_, pa.array(of["start"]), pa.array(of["n"]),
                         pa.array(of["places"]), pa.array(content, pa.binary())], schema=schema)

    content = (_pack(docs, key, text).join(wanted, "doc").select("doc", "packed", "phrases")
               .mapInArrow(fetch, "key long, tag long, doc long, start int, n short, places long, content binary"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("key", pa.int64()), ("tag", pa.int64()), ("first", pa.int64()), ("first_start", pa.int32()),
                         ("places", pa.int64()), ("lost", pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())])))])
        held: list[pa.RecordBatch] = []

        def run(rows: pa.Table) -> pa.RecordBatch:
            get = lambda c: rows.column(c).to_numpy()
            lost = kernel(rows.column("content").to_pylist(), get("n").astype(np.int64), get("doc"), get("start"), get("places"))
            spans = []
            for at in lost:
                cuts = np.flatnonzero(np.diff(at) > 1) + 1
                heads = at[np.append(0, cuts)] if len(at) else at
                tails = at[np.append(cuts - 1, len(at) - 1)] if len(at) else at
                spans.append([{"start": int(a), "n": int(b - a + 1)} for a, b in zip(heads, tails)])
            return pa.RecordBatch.from_arrays(
                [*[rows.column(c).combine_chunks() for c in ("key", "tag", "doc", "start", "places")],
                 pa.array(spans, out.field("lost").type)], schema=out)

        def shards() -> Iterator[pa.Table]:
            """Whole keys, of about a shard's bytes together."""
            size, one = 0, None
            for batch in batches:
                if not len(batch):
                    continue
                one = batch.column("key")[0].as_py() if not held else one
                held.append(batch)
                size += batch.column("content").nbytes
                # While there is one key alone, nothing can be cut off.
                if size > units.shard and batch.column("key")[len(batch) - 1].as_py() != one:
                    table = pa.Table.from_batches(held)
                    held.clear()
                    keys = table.column("key").to_numpy()
                    sizes = np.cumsum(pc.binary_length(table.column("content")).to_numpy().astype(np.int64))
                    starts = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
                    begin = 0
                    for cut in starts[1:].tolist():
                        if sizes[cut - 1] - (sizes[begin - 1] if begin else 0) >= units.shard or cut == starts[-1]:
                            yield table.slice(begin, cut - begin)
                            begin = cut
                    held[:] = table.slice(begin).combine_chunks().to_batches()
                    one = keys[begin]
                    size = sum(x.column("content").nbytes for x in held)
                    del table
            if held:
                yield pa.Table.from_batches(held)

        for table in shards():
            if len(table):
                yield run(table)

    found = (content.repartition("key").sortWithinPartitions("key")
             .mapInArrow(search, "key long, tag long, first long, first_start int, places long, "
                                 "lost array<struct<start:int,n:int>>"))
    found = found.where((F.col("places") > 1) | (F.size("lost") > 0))
    is_first = (F.col("doc") == F.col("first")) & (F.col("start") == F.col("first_start"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("n")))
    loses: Column = F.when(is_first, F.col("lost")).otherwise(whole) if keep_first else (
        F.when(F.col("places") > 1, whole).otherwise(F.col("lost")))
    return (places.join(found, ["key", "tag"]).select("doc", "start", F.explode(loses).alias("w"))
            .select("doc", (F.col("start") + F.col("w.start")).alias("start"), F.col("w.n").alias("n")))


def with_removed(docs: DataFrame, removed: DataFrame, finish: Callable[[bytes, np.ndarray, np.ndarray], tuple],
                 schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``finish`` gets its text and the starts and sizes of its removed windows."""
    spans = removed.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    fields = [x.split() for x in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                rows = []
                for i in range(len(part)):
                    lists = part.column(2)[i].values
                    none = np.zeros(0, np.int64)
                    start, n = (none, none) if lists is None else (
                        pc.struct_field(lists, "start").to_numpy().astype(np.int64), pc.struct_field(lists, "n").to_numpy().astype(np.int64))
                    rows.append(finish(unpack.decompress(part.column(1)[i].as_py(), max_output_size=0), start, n))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(x, types[t]) for x, (_, t) in zip(zip(*rows), fields)]],
                    ["doc", *[n for n, _ in fields]])

    joined = _pack(docs, key, text).join(spans, "doc", "left").select("doc", "packed", "spans")
    return joined.mapInArrow(run, f"doc long, {schema}").withColumnRenamed("doc", key)


def covered(n_units: int, start: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Units inside any of the windows that begin at ``start`` .. ``start + n - 1``."""
    change = np.zeros(n_units + 1, np.int64)
    np.add.at(change, np.minimum(start, n_units), 1)
    np.add.at(change, np.minimum(start + n + size - 1, n_units), -1)
    return np.cumsum(change[:-1]) > 0
