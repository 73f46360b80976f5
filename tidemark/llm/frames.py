"""Token ids in shard files: one zstandard frame per document and a trailing seek table.

Layout of a shard, after the public seekable format of zstandard:

* one frame per document, its ids as little-endian unsigned integers of 16 bits, or of 32 bits where the
  vocabulary needs them, with the checksum of the frame's content;
* a skippable frame with the keys (64-bit) and the numbers of ids (64-bit) of all documents, compressed,
  and before them the width of an id in bytes;
* a skippable frame with the seek table: compressed size, size, and the low half of the XXH64 of the
  content (32 bits each) of every document's frame; number of frames, flags, magic number.

A reader takes the seek table from the end, and of the frames only those it is asked for.
"""

from __future__ import annotations

import array
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.pieces import PieceCache
from tidemark.llm.words import blobs, blocks
from tidemark.session import new_path, stage
from tidemark.shipping import ship_package

# Fixed values of the seekable format.
INDEX_MAGIC = 0x184D2A5D
SEEK_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80

LEVEL = 3
ENCODE_BYTES = 8 << 20
#: Pieces that are encoded as one text.
JOINED_PIECES = 4096


class ShardWriter:
    """Appends documents to a binary file object; ``close`` writes index and seek table."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.table, self.keys, self.sizes = bytearray(), array.array("q"), array.array("q")

    def append(self, key: int, frame: bytes, size: int, check: int) -> None:
        """Add a ready frame of ``size`` ids whose content has the given check."""
        self.out.write(frame)
        self.table += struct.pack("<III", len(frame), size * self.width, check)
        self.keys.append(key)
        self.sizes.append(size)

    def close(self) -> None:
        index = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress(
            struct.pack("<Q", self.width) + self.keys.tobytes() + self.sizes.tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        footer = struct.pack("<IBI", len(self.keys), CHECKSUMS, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(self.table) + len(footer)) + self.table + footer)


def frame_of(ids: np.ndarray, width: int, compressor: zstandard.ZstdCompressor) -> tuple[bytes, int]:
    """Frame of the ids of one document, and the check for the seek table."""
    content = ids.astype(f"<u{width}").tobytes()
    return compressor.compress(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class ShardReader:
    """Random access to the documents of a shard by their place in it or by key."""

    def __init__(self, file, size: int):
        self.file = file
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.checks = table[:, 1], table[:, 2]
        self.ends = np.cumsum(table[:, 0])
        self.starts = self.ends - table[:, 0]
        at = int(self.ends[-1]) if n else 0
        magic, length = struct.unpack("<II", self._at(at, 8))
        if magic != INDEX_MAGIC:
            raise ValueError("no document index before the seek table")
        index = zstandard.ZstdDecompressor().decompress(self._at(at + 8, length))
        self.width = struct.unpack_from("<Q", index)[0]
        values = np.frombuffer(index, "<i8", offset=8)
        self.keys, self.counts = values[:n], values[n:]

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def __len__(self) -> int:
        return len(self.keys)

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document; reads and decompresses its frame alone and verifies both checksums."""
        frame = self._at(int(self.starts[i]), int(self.ends[i] - self.starts[i]))
        content = zstandard.ZstdDecompressor().decompress(frame, max_output_size=int(self.sizes[i]))
        if len(content) != self.sizes[i] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.checks[i]:
            raise ValueError(f"frame {i} does not match its checksum")
        return np.frombuffer(content, f"<u{self.width}").astype("<u4")

    def find(self, key: int) -> Iterator[np.ndarray]:
        """Ids of the documents with a key."""
        a, b = np.searchsorted(self.keys, [key, key], "left")[0], np.searchsorted(self.keys, key, "right")
        return (self.ids(i) for i in range(a, b))


@lru_cache(maxsize=2)
def _cache(path: str) -> tuple[PieceCache, int]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True  # their strings in a text are ordinary text

    # A token of a byte-level vocabulary is written with one character per byte.
    n_bytes = np.zeros(own.get_vocab_size(), np.int64)
    for token, i in own.get_vocab().items():
        n_bytes[i] = len(token)

    def joined(pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces that begin with a space before and end with a visible character: encoded as one text, whose
        ids are theirs one after another; the lengths of the tokens tell where each piece ends."""
        found = own.encode_batch_fast([b"".join(pieces).decode()], add_special_tokens=False)[0]
        ids = np.array(found.ids, "<u4")
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        token_ends = np.cumsum(n_bytes[ids])
        stop = np.searchsorted(token_ends, ends) + 1
        if (token_ends[stop - 1] != ends).any():
            raise ValueError("the vocabulary is not byte-level: its tokens cross spaces")
        raw, stop = ids.tobytes(), (4 * stop).tolist()
        return [raw[a:b] for a, b in zip([0, *stop], stop)]

    def together(pieces: list[bytes]) -> list[bytes]:
        return [x for a in range(0, len(pieces), JOINED_PIECES) for x in joined(pieces[a : a + JOINED_PIECES])]

    def encode(pieces: list[str]) -> list[bytes]:
        out = []
        for a in range(0, len(pieces), 10_000):
            out += [array.array("I", e.ids).tobytes() for e in own.encode_batch_fast(pieces[a : a + 10_000], add_special_tokens=False)]
        return out

    return PieceCache(encode, together=together), own.get_vocab_size()


_MANIFEST = "shard int, file string, n_docs long, n_tokens long"


def write_shards(docs: DataFrame, tokenizer: str, folder: str, shards: int, end_id: int = 2,
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode all texts and write them in ascending key order to ``shards`` files in ``folder``.

    ``tokenizer`` is a file of a byte-level vocabulary for the tokenizers library that every worker can
    open, ``folder`` a place of any file system that workers reach. ``end_id`` ends every document. Missing
    and empty texts hold ``end_id`` alone; rows without a key come first, under the smallest 64-bit
    integer; rows that repeat a key stand next to each other. An empty table gives no shard.

    Returns the manifest (shard, file, n_docs, n_tokens), stored: a shard that is written again after a lost
    task or twice by speculation has another file name, and only the file in the manifest counts.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.coalesce(docs[key].cast("long"), F.lit(-(2**63))).alias("key"), docs[text].alias("text"))
    # Shards are ranges of keys between approximate quantiles; only the keys are read for that.
    if shards > 1:
        steps = [i / shards for i in range(1, shards)]
        bounds = rows.agg(F.percentile_approx("key", F.array(*[F.lit(x) for x in steps]), 100 * shards)).first()[0] or []
    else:
        bounds = []
    edges = np.unique(np.array(bounds, np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, vocabulary = _cache(tokenizer)
        width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
        compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for part in blocks(texts := blobs(batch.column(1)), ENCODE_BYTES):
                ids = [np.append(x, np.uint32(end_id)) for x in cache.ids(texts[part])]
                frames = [frame_of(x, width, compressor) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.searchsorted(edges, keys[part], "right").astype(np.int32)), pa.array(keys[part]),
                     pa.array([len(x) for x in ids], pa.int64()), pa.array([c for _, c in frames], pa.int64()),
                     pa.array([f for f, _ in frames], pa.binary()), pa.array(np.full(len(ids), width, np.int32))],
                    ["shard", "key", "n", "check", "frame", "width"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        now = None

        def done() -> pa.RecordBatch:
            shard, name, out, writer = now
            writer.close()
            out.close()
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "file": name, "n_docs": len(writer.keys), "n_tokens": sum(writer.sizes)}],
                pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            for shard, k, n, check, frame, width in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != shard:
                    if now is not None:
                        yield done()
                    name = f"{shard:08d}-{uuid.uuid4().hex}.ids"
                    out = system.open_output_stream(f"{root}/{name}")
                    now = shard, name, out, ShardWriter(out, width)
                now[3].append(k, frame, n, check)
        if now is not None:
            yield done()

    encoded = rows.mapInArrow(encode, "shard int, key long, n long, check long, frame binary, width int")
    # The shard number is the partition: no two shards share a task, none is split.
    placed = encoded.repartitionById(len(edges) + 1, F.col("shard")).sortWithinPartitions("shard", "key", "n", "check", "frame")
    return stage(placed.mapInArrow(write, _MANIFEST), "manifest")


def read_shards(spark: SparkSession, manifest: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """All documents of the shards: key, start (ids before it), n_tokens, ids_crc32, shard, frame."""
    ship_package(spark)
    # One row per shard, so the running total is over a few thousand rows at most.
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    plan = manifest.select("shard", "file", F.coalesce(before, F.lit(0)).alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard, name, start in zip(*(c.to_pylist() for c in batch.columns)):
                path = f"{root}/{name}"
                with system.open_input_file(path) as file:
                    shard_file = ShardReader(file, file.size())
                    starts = start + np.cumsum(shard_file.counts) - shard_file.counts
                    keys = shard_file.keys
                    for a in range(0, len(shard_file), 2048):
                        at = range(a, min(a + 2048, len(shard_file)))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys[a : at.stop], mask=keys[a : at.stop] == -(2**63)), pa.array(starts[a : at.stop]),
                             pa.array(shard_file.counts[a : at.stop]),
                             pa.array([zlib.crc32(shard_file.ids(i)) for i in at], pa.int64()),
                             pa.array(np.full(len(at), shard, np.int32)), pa.array(np.arange(a, at.stop))],
                            [key, "start", "n_tokens", "ids_crc32", "shard", "frame"])

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return plan.repartition(width, "shard").mapInArrow(
        read, f"`{key}` long, start long, n_tokens long, ids_crc32 long, shard int, frame long")


def read_documents(file: str, keys: Iterable[int]) -> dict[int, list[np.ndarray]]:
    """Ids of the asked documents of one shard file, by key."""
    system, path = pafs.FileSystem.from_uri(file)
    with system.open_input_file(path) as opened:
        reader = ShardReader(opened, opened.size())
        return {k: list(reader.find(k)) for k in keys}


def op1_seekable_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    folder = new_path(spark, "tokens")
    manifest = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizers.path("byte_bpe_50k.json"), folder,
                            int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_shards(spark, manifest, folder)
