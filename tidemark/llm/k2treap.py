"""Ranked lexical search: a K2-treap of impact maxima over the term-document grid of every shard of documents."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.words import Words, blobs, ragged
from tidemark.session import stage
from tidemark.shipping import ship_package

#: Bytes of text whose documents share a grid; a longer document has a grid of its own.
SHARD_BYTES = 8 << 20
#: Items whose searches go through a shard side by side; more items make more passes over the index.
BLOCK_ITEMS = 1024
#: Document ranges of one item that are divided in one step, best bounds first.
WIDTH = 32

#: Fixed values of the score: scale of term weights, of impacts, and length normalisation in hundredths.
WEIGHT_SCALE, IMPACT_SCALE, TF_SCALE, LENGTH_FACTOR, LENGTH_SHARE = 1000, 1_000_000_000, 1000, 8, 90

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes that end a term: ASCII other than digits and letters.
_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def terms_of(texts: list[bytes]) -> Words:
    return Words([t.translate(_LOWER) for t in texts], _GAP)


def weight(n_docs: int, df: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n_terms: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """Share of a term in its document's score, before the term's weight."""
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n_terms * n_docs) // max(length, 1)
    return (IMPACT_SCALE * tf) // (TF_SCALE * tf + LENGTH_FACTOR * m)


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of up to 32-bit numbers with a gap after each."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def _gather(x: np.ndarray) -> np.ndarray:
    """The other way round: every second bit."""
    x = x & np.uint64(0x5555555555555555)
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF),
                        (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | (x >> np.uint64(shift))) & np.uint64(mask)
    return x.astype(np.int64)


def _small(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


class K2Treap:
    """Maxima of a sparse grid: every cell is divided in four until one point is left in it.

    Cells are numbered level by level. ``bits`` tells which of the four quarters of a divided cell hold points,
    ``leaf`` which cells hold one point only (its row and column are in ``row`` and ``col``), ``top`` is the maximum
    of a cell. Stored, bits are packed and a maximum is its distance from that of the cell around it.
    """

    def __init__(self, height: int, bits: np.ndarray, leaf: np.ndarray, row: np.ndarray, col: np.ndarray, top: np.ndarray):
        self.height, self.bits, self.leaf, self.row, self.col, self.top = height, bits, leaf, row, col, top
        self.child = np.where(bits, np.cumsum(bits), -1)  # number of the cell in a quarter: its rank among the bits
        self.at = np.where(leaf, np.cumsum(leaf), np.cumsum(~leaf)) - 1

    @classmethod
    def build(cls, row: np.ndarray, col: np.ndarray, value: np.ndarray) -> K2Treap:
        """From distinct points, at least one."""
        height = max(1, int(max(row.max(), col.max())).bit_length())
        key = _spread(row) << np.uint64(1) | _spread(col)
        order = np.argsort(key)
        key, value = key[order], value[order]
        # Level at which a point is alone in its cell: one below the last that it shares with a neighbour in Morton order.
        shared = np.frexp((key[1:] ^ key[:-1]).astype(np.float64))[1]  # length in bits of the difference
        common = height - 1 - (shared.astype(np.int64) - 1) // 2
        alone = np.maximum(np.append(common, -1), np.append(-1, common)) + 1
        bits, leaf, top = [], [alone[:1] == 0], [value.max(keepdims=True)]
        lone = [np.flatnonzero(alone == 0)]
        parents = np.zeros(len(key), np.int64)  # divided cell of the level before, for the points that are left
        for level in range(1, height + 1):
            left = np.flatnonzero(alone >= level)
            if not len(left):
                break
            cell = key[left] >> np.uint64(2 * (height - level))
            head = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            # Points that are left stand in cells divided one level above, numbered in order.
            above = np.cumsum(np.append(True, (cell[1:] >> np.uint64(2)) != (cell[:-1] >> np.uint64(2)))) - 1
            marks = np.zeros(4 * (int(above[-1]) + 1), bool)
            marks[4 * above[head] + (cell[head] & np.uint64(3)).astype(np.int64)] = True
            bits.append(marks)
            leaf.append(alone[left[head]] == level)
            top.append(np.maximum.reduceat(value[left], head))
            lone.append(left[alone[left] == level])
        points = key[np.concatenate(lone)]
        return cls(height, np.concatenate(bits) if bits else np.zeros(0, bool), np.concatenate(leaf),
                   _gather(points >> np.uint64(1)), _gather(points), np.concatenate(top))

    def _parents(self) -> np.ndarray:
        """Cell around each cell but the first."""
        inner = np.flatnonzero(~self.leaf)
        return inner[np.flatnonzero(self.bits) >> 2]

    def pack(self) -> bytes:
        drop = self.top[self._parents()] - self.top[1:]
        parts = [np.array([self.height, len(self.bits), self.top[0]]), np.packbits(self.bits), np.packbits(self.leaf),
                 _small(self.row), _small(self.col), _small(drop)]
        squeeze = zstandard.ZstdCompressor(level=1)
        out = b""
        for part in parts:
            body = squeeze.compress(part.tobytes())
            out += len(body).to_bytes(4, "little") + bytes([part.dtype.itemsize]) + body
        return out

    @classmethod
    def unpack(cls, data: bytes) -> K2Treap:
        parts, at, un = [], 0, zstandard.ZstdDecompressor()
        while at < len(data):
            size = int.from_bytes(data[at : at + 4], "little")
            parts.append(np.frombuffer(un.decompress(data[at + 5 : at + 5 + size]), f"<u{data[at + 4]}").astype(np.int64))
            at += 5 + size
        (height, n_bits, first), bits, leaf, row, col, drop = parts
        bits = np.unpackbits(bits.astype(np.uint8), count=int(n_bits)).astype(bool)
        leaf = np.unpackbits(leaf.astype(np.uint8), count=len(drop) + 1).astype(bool)
        self = cls(int(height), bits, leaf, row, col, np.append(first, -drop))
        parents = self._parents()
        done = 1  # cells whose maximum is known; a level's cells all have theirs around them in the level before
        while done < len(self.top):
            stop = 1 + int(np.searchsorted(parents, done))
            self.top[done:stop] += self.top[parents[done - 1 : stop - 1]]
            done = stop
        return self

    def descend(self, cell: np.ndarray, row: np.ndarray, level: np.ndarray, right: int) -> np.ndarray:
        """Cells of the rows' paths one level down, in the left or right half of the columns; -1 where there is none."""
        shift = self.height - 1 - level
        leaf, at = self.leaf[cell], self.at[cell]
        out = np.full(len(cell), -1)
        lone = np.flatnonzero(leaf)
        stays = (self.col[at[lone]] >> shift[lone]) & 1 == right
        out[lone[stays]] = cell[lone[stays]]
        wide = np.flatnonzero(~leaf)
        out[wide] = self.child[4 * at[wide] + 2 * ((row[wide] >> shift[wide]) & 1) + right]
        return self.on_row(out, row)

    def on_row(self, cell: np.ndarray, row: np.ndarray) -> np.ndarray:
        """-1 for cells whose only point is in another row."""
        known = np.flatnonzero(cell >= 0)
        known = known[self.leaf[cell[known]]]
        cell[known[self.row[self.at[cell[known]]] != row[known]]] = -1
        return cell


class Best:
    """The ``k`` best (score, document) of each item so far; equal scores by ascending document."""

    def __init__(self, items: int, k: int):
        self.k, self.items = k, items
        self.item = self.score = self.doc = np.zeros(0, np.int64)
        self.least = np.zeros(items, np.int64)  # what a further document has to reach
        self.last = np.full(items, np.iinfo(np.int64).max)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        begin = np.searchsorted(item, np.arange(self.items))
        place = np.arange(len(item)) - begin[item]
        keep = place < self.k
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]
        full = place == self.k - 1
        self.least[item[full]], self.last[item[full]] = score[full], doc[full]

    def may(self, item: np.ndarray, bound: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a document from ``doc`` on with a score up to ``bound`` can still be among an item's best."""
        return (bound > self.least[item]) | (bound > 0) & (bound == self.least[item]) & (doc < self.last[item])


def search_shard(tree: K2Treap, docs: np.ndarray, item: np.ndarray, row: np.ndarray, factor: np.ndarray, best: Best) -> None:
    """Joint best-first descent of the paths of all items' rows, over halves of the document range.

    ``item``, ``row`` and ``factor`` list the term rows of the items. An open range holds the cells of its item's rows;
    its bound is the sum of their maxima times the weights. In each step every item divides its ``WIDTH`` best
    ranges; a range of one document has its exact score. Ranges that cannot enter an item's best are dropped.
    """
    cell = tree.on_row(np.zeros(len(row), np.int64), row)
    item, row, factor, cell = (x[cell >= 0] for x in (item, row, factor, cell))
    if not len(cell):
        return
    order = np.argsort(item, kind="stable")
    item, row, factor, cell = item[order], row[order], factor[order], cell[order]
    first = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
    # Open ranges, and the (row, cell) pairs of each, one range after another.
    r_item, r_level, r_col = item[first], np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    r_bound = np.add.reduceat(factor * tree.top[cell], first)
    r_size = np.diff(np.append(first, len(item)))
    p_row, p_factor, p_cell = row, factor, cell
    while len(r_item):
        start = docs[r_col << (tree.height - r_level)]
        open_ = np.flatnonzero(best.may(r_item, r_bound, start))
        if not len(open_):
            return
        order = open_[np.lexsort((start[open_], -r_bound[open_], r_item[open_]))]
        begin = np.searchsorted(r_item[order], np.arange(best.items))
        chosen = np.arange(len(order)) - begin[r_item[order]] < WIDTH
        now, later = order[chosen], order[~chosen]
        r_start = np.cumsum(r_size) - r_size
        at = ragged(r_start[now], r_size[now])
        owner = np.repeat(now, r_size[now])
        keep = ragged(r_start[later], r_size[later])
        parts = [(r_item[later], r_level[later], r_col[later], r_bound[later], r_size[later], p_row[keep], p_factor[keep], p_cell[keep])]
        for right in (0, 1):
            cell = tree.descend(p_cell[at], p_row[at], r_level[owner], right)
            live = np.flatnonzero(cell >= 0)
            if not len(live):
                continue
            cell, who, w = cell[live], owner[live], p_factor[at[live]]
            first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
            bound = np.add.reduceat(w * tree.top[cell], first)
            size = np.diff(np.append(first, len(who)))
            who = who[first]
            level, col = r_level[who] + 1, 2 * r_col[who] + right
            done = level == tree.height
            if done.any():
                best.add(r_item[who[done]], bound[done], docs[col[done]])
            inside = np.repeat(~done, size)
            on = ~done
            parts.append((r_item[who[on]], level[on], col[on], bound[on], size[on], p_row[at[live]][inside], w[inside], cell[inside]))
        r_item, r_level, r_col, r_bound, r_size, p_row, p_factor, p_cell = (np.concatenate(x) for x in zip(*parts))


@dataclass(frozen=True)
class LexicalIndex:
    """One row per shard: its documents, the hashes of its terms with their rows and document counts, and the packed grid."""

    shards: DataFrame
    n_docs: int
    n_terms: int


_INDEX = "docs binary, terms array<long>, df array<int>, grid binary"


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> LexicalIndex:
    """Index all rows of ``docs``.

    Terms are maximal runs of digits, letters and non-ASCII characters of the whole text, A-Z lower-cased, told apart
    by 64-bit hashes (of q query terms and v terms in all, q * v / 2**64 are expected to be mixed up). Texts that are missing
    or empty have none. A row without key counts in the statistics but is never listed; rows that repeat a key are
    documents of their own. Other columns are ignored; an empty table gives an empty index. A text of any length is
    indexed whole; one longer than ``SHARD_BYTES`` has a grid of its own.
    """
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select(docs[key].cast("long").alias("doc"), docs[text].alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        for batch in batches:
            texts = blobs(batch.column(0))
            for a in range(0, len(texts), 256):
                words = terms_of(texts[a : a + 256])
                n_docs += int((words.last > words.first).sum())
                n_terms += len(words)
        yield pa.RecordBatch.from_arrays([pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64())], ["n", "l"])

    total = source.select("text").mapInArrow(count, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    n_docs, length = total[0] or 0, total[1] or 0

    def grid(ids: np.ndarray, known: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
        words = terms_of(texts)
        terms, number = np.unique(words.hashes(), return_inverse=True)
        pairs, tf = np.unique(words.text * max(len(terms), 1) + number, return_counts=True)
        doc, term = pairs // max(len(terms), 1), pairs % max(len(terms), 1)
        df = np.bincount(term, minlength=len(terms))
        size = (words.last - words.first)[doc]
        # Documents stand in the order of their keys, so that a range's first document is its smallest.
        column = np.empty(len(ids), np.int64)
        by_id = np.lexsort((np.arange(len(ids)), ids, ~known))
        column[by_id] = np.arange(len(ids))
        listed = known[doc]
        value = impacts(tf, size, n_docs, length)
        tree = K2Treap.build(term[listed], column[doc[listed]], value[listed]).pack() if listed.any() else None
        packed = zstandard.ZstdCompressor(level=1).compress(ids[by_id][: int(known.sum())].tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array([packed], pa.binary()), pa.array([terms.view(np.int64)], pa.list_(pa.int64())),
             pa.array([df.astype(np.int32)], pa.list_(pa.int32())), pa.array([tree], pa.binary())], ["docs", "terms", "df", "grid"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, known, texts, size = [], [], [], 0
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), blobs(batch.column(1))):
                if texts and size + len(blob) > SHARD_BYTES:
                    yield grid(np.array(ids, np.int64), np.array(known), texts)
                    ids, known, texts, size = [], [], [], 0
                ids.append(0 if i is None else i)
                known.append(i is not None)
                texts.append(blob)
                size += len(blob)
        if texts:
            yield grid(np.array(ids, np.int64), np.array(known), texts)

    return LexicalIndex(stage(source.mapInArrow(build, _INDEX), "lexical-index"), n_docs, length)


def search(index: LexicalIndex, items: DataFrame, k: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """The ``k`` best documents of every item: item, rank, doc_id, score.

    The score sums weight times impact over the item's distinct terms; only scores above 0 count, equal scores go by
    ascending document. Rows that repeat an item (or have none) are one item with the terms of all of them. An
    item without terms, or without a document that holds one, has no rows.
    """
    spark = items.sparkSession
    ship_package(spark)
    n_docs = index.n_docs

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = terms_of(blobs(batch.column(1)))
            hashes = words.hashes().view(np.int64)
            found = [np.unique(hashes[a:b]) for a, b in zip(words.first, words.last)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["item", "terms"])

    kind = items.schema[item].dataType.simpleString()
    wanted = stage(items.select(items[item].alias("item"), items[text].alias("text"))
                   .mapInArrow(cut, f"item {kind}, terms array<long>").select("item", F.explode("terms").alias("term")).distinct(), "item-terms")
    counted = (index.shards.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select(F.col("t.terms").alias("term"), "t.df")
               .join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")))
    queries = stage(wanted.join(counted, "term").groupBy("item").agg(F.collect_list(F.struct("term", "df")).alias("terms")), "queries")
    blocks = max(1, -(-queries.count() // BLOCK_ITEMS))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))

    def searched(rows: list) -> DataFrame:
        owner = np.repeat(np.arange(len(rows)), [len(r["terms"]) for r in rows])
        term = np.array([t["term"] for r in rows for t in r["terms"]], np.int64).view(np.uint64)
        factor = np.array([weight(n_docs, t["df"]) for r in rows for t in r["terms"]], np.int64)
        names = [r["item"] for r in rows]
        shared = spark.sparkContext.broadcast((owner, term, factor, names))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            owner, term, factor, names = shared.value
            best = Best(len(names), k)  # kept from shard to shard, so that later shards are cut sooner
            un = zstandard.ZstdDecompressor()
            for batch in batches:
                for i in range(len(batch)):
                    packed = batch.column("grid")[i].as_py()
                    if packed is None:
                        continue
                    docs = np.frombuffer(un.decompress(batch.column("docs")[i].as_py()), np.int64)
                    terms = batch.column("terms")[i].values.to_numpy().view(np.uint64)
                    row = np.searchsorted(terms, term)
                    held = terms[np.minimum(row, len(terms) - 1)] == term
                    search_shard(K2Treap.unpack(packed), docs, owner[held], row[held], factor[held], best)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in best.item.tolist()], _arrow(kind)), pa.array(best.doc), pa.array(best.score)],
                ["item", "doc", "score"])

        return index.shards.select("docs", "terms", "grid").mapInArrow(run, f"item {kind}, doc long, score long")

    parts = [searched(queries.where(block == b).collect()) for b in range(blocks)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    # Tasks' lists are cut in 64 parts per item first, so that no task gets all lists of an item.
    best_first = [F.col("score").desc(), "doc"]
    found = found.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(64)))
    near = (found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*best_first)))
            .where(F.col("rank") <= k).drop("rank"))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best_first))).where(F.col("rank") <= k)
    return near.select(F.col("item").alias(item), "rank", F.col("doc").alias("doc_id"), "score")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind, pa.string())


def op11_k2_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
