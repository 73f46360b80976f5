"""MinHash near-dedup: chosen-path set similarity join over word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.components import components
from tidemark.llm.repeats import _pack
from tidemark.llm.words import Words, blobs, blocks, grams, mix, ragged, stream
from tidemark.session import stage
from tidemark.shipping import ship_package

SHINGLE_WORDS = 5
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Independent trees; the first branching of each takes another minwise token. A pair at the threshold that
#: no tree keeps together has a chance of 0.15 ** 10.
TREES = 10
#: Minwise tokens of a document that branchings choose from.
TOKENS = 32
#: Branches that a document follows out of a node that is too large; two times 0.85 is above one, so the
#: expected number of common branches of a linked pair does not shrink with depth.
BRANCHES = 2
#: Sets times shingles of a node that are compared exhaustively in one task, and shingles at most.
NODE_WORK, NODE_SHINGLES = 4_000_000_000, 2_000_000
LEVELS = 6
#: A shingle that this share of a node's sets holds is compared by matrix products; cells of a block of them.
DENSE_SHARE, BLOCK_CELLS = 8, 1 << 21

_BLOCK = 1 << 17
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_DIGEST = stream(11, 2)
_TOKEN = stream(12, TOKENS) | np.uint64(1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct hashes of the 5-word shingles of each text, A-Z lower-cased."""
    words = Words([t.translate(_LOWER) for t in texts])
    hashes = words.hashes()
    all_grams = grams(hashes, SHINGLE_WORDS)
    out = []
    for a, b in zip(words.first.tolist(), words.last.tolist()):
        if b - a >= SHINGLE_WORDS:
            out.append(np.unique(all_grams[a : b - SHINGLE_WORDS + 1]))
        else:  # a shorter text is one shingle; its length is part of the hash
            out.append(grams(hashes[a:b], b - a, 100 + b - a) if b > a else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digest of each set, and its minwise tokens (both zero for an empty set)."""
    digest = np.zeros((len(sets), 2), np.uint64)
    tokens = np.zeros((len(sets), TOKENS), np.uint64)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    some = np.flatnonzero(size)
    if len(some):
        flat = np.concatenate(sets)
        heads = (np.cumsum(size) - size)[some]
        for j, seed in enumerate(_DIGEST):
            digest[some, j] = np.add.reduceat(mix(flat ^ seed), heads)
        for j, factor in enumerate(_TOKEN):
            value = flat * factor
            value ^= value >> np.uint64(32)
            value *= factor
            tokens[some, j] = np.minimum.reduceat(value, heads)
    return digest, tokens


class Links:
    """Links among sets in one task: enough pairs to connect all that are connected."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.percent, self.n = percent, len(sets)
        self.size = np.fromiter(map(len, sets), np.int64, self.n)
        owner = np.repeat(np.arange(self.n), self.size)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        first = np.flatnonzero(np.append(len(flat) > 0, flat[1:] != flat[:-1]))
        held = np.diff(np.append(first, len(flat)))
        # A token of one set is in no intersection. Those of many sets are columns of a dense matrix, the others
        # lists of the sets that hold them, looked up from each set's own list of them.
        many = held >= max(2, self.n // DENSE_SHARE)
        few = (held > 1) & ~many
        self.columns = np.split(owner[ragged(first[many], held[many])], np.cumsum(held[many])[:-1]) if many.any() else []
        self.first, self.held, self.owner = first[few], held[few], owner
        pairs = ragged(self.first, self.held)
        token = np.repeat(np.arange(len(self.first)), self.held)
        by_set = np.argsort(owner[pairs], kind="stable")
        self.tokens = token[by_set]
        self.begin = np.searchsorted(owner[pairs][by_set], np.arange(self.n + 1))
        self.label = np.arange(self.n)
        self.pairs: list[tuple[int, int]] = []

    def common(self, start: int, stop: int) -> np.ndarray:
        """Sizes of the intersections of some of the sets with all sets."""
        out = np.zeros((stop - start, self.n), np.float32)
        step = max(1, BLOCK_CELLS // max(1, self.n))
        for a in range(0, len(self.columns), step):
            part = self.columns[a : a + step]
            dense = np.zeros((self.n, len(part)), np.float32)
            for j, sets in enumerate(part):
                dense[sets, j] = 1
            out += dense[start:stop] @ dense.T
        for i in range(start, stop):
            mine = self.tokens[self.begin[i] : self.begin[i + 1]]
            if len(mine):
                out[i - start] += np.bincount(self.owner[ragged(self.first[mine], self.held[mine])], minlength=self.n)
        return out

    def compare(self) -> list[tuple[int, int]]:
        """Exhaustive comparison; ends when all sets are connected."""
        step = max(1, BLOCK_CELLS // max(1, self.n))
        for start in range(0, self.n, step):
            stop = min(self.n, start + step)
            if (self.label == self.label[0]).all():
                break
            common = self.common(start, stop).astype(np.int64)
            link = 100 * common >= self.percent * (self.size[start:stop, None] + self.size - common)
            for i in range(start, stop):
                others = np.flatnonzero(link[i - start])
                others = others[self.label[others] != self.label[i]]
                for of, at in zip(*np.unique(self.label[others], return_index=True)):
                    self.pairs.append((i, int(others[at])))
                    self.label[self.label == of] = self.label[i]
        return self.pairs


def linked(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs of places in ``sets`` (none of them empty) that link and connect all that links connect."""
    return Links(sets, percent).compare()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Class of every document: key, n_shingles, component_id, kept.

    A document's set holds its distinct shingles of five words (A-Z lower-cased); fewer words are one shingle;
    a text that is missing, empty or without words has none and links with nothing. Documents link when
    their Jaccard similarity is ``percent`` hundredths or more, confirmed on the full sets; component_id is the smallest key that
    links reach, kept says that it is the document's own. Rows that repeat a key are one member of each of
    their sets; rows without a key have no component and are kept. Other columns are ignored; an empty table
    gives an empty result.

    Equal sets are one representative before anything is compared. Representatives branch by
    minwise tokens into nodes (``TREES`` trees, one token each at the root); a node beyond ``NODE_WORK`` or
    ``NODE_SHINGLES`` branches again by tokens its number chooses. A node that is still too large after ``LEVELS``
    branchings, or holds more than half of the node above it (branching does not part alike sets), is compared
    block by block. Nodes and blocks are compared exhaustively, so no pair of a node is dropped. Nodes with the same members in several trees are compared once.
    """
    spark = docs.sparkSession
    ship_package(spark)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(texts := blobs(batch.column(1)), _BLOCK):
                sets = shingle_sets(texts[part])
                digest, tokens = signatures(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part.start : part.stop], pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)),
                     pa.array([row.tobytes() for row in tokens], pa.binary())],
                    ["doc", "n", "s1", "s2", "tokens"])

    signed = stage(docs.select(docs[key].cast("long").alias("doc"), docs[text].alias("text"))
                   .mapInArrow(sign, "doc long, n long, s1 long, s2 long, tokens binary"), "signatures")
    classes = stage(signed.where("n > 0 and doc is not null").groupBy("s1", "s2", "n", "tokens").agg(F.min("doc").alias("rep")), "classes")

    def branch(trees: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint64).reshape(-1, TOKENS)
                rep, size = batch.column("rep"), batch.column("n")
                above = pa.nulls(len(batch), pa.int64()) if trees else batch.column("m")
                node = np.zeros(len(batch), np.uint64) if trees else batch.column("node").to_numpy().view(np.uint64)
                for j in range(TREES if trees else BRANCHES):
                    # The root of tree j takes token j; deeper, the number of the node chooses.
                    chosen = np.full(len(batch), j) if trees else (
                        (mix(node) % np.uint64(TOKENS) + np.uint64(j * 17)) % np.uint64(TOKENS)).astype(np.int64)
                    child = mix(mix(node ^ tokens[np.arange(len(batch)), chosen]) + chosen.astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), rep, size, above], ["node", "rep", "n", "above"])
        return run

    branches = "node long, rep long, n long, above long"
    level = stage(classes.select("rep", "n", "tokens").mapInArrow(branch(True), branches), "level")
    kept: list[DataFrame] = []
    for depth in range(LEVELS + 1):
        member = F.xxhash64("rep").cast("decimal(20,0)")
        again = F.xxhash64("rep", F.lit(1)).cast("decimal(20,0)")
        counted = (level.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("size"), F.max("above").alias("above"),
                                             F.sum(member).alias("d1"), F.sum(again).alias("d2"))
                   .where("m > 1").groupBy("m", "size", "d1", "d2").agg(F.min(F.struct("node", "above")).alias("x"))
                   .select(F.col("x.node").alias("node"), "m", "size", F.col("x.above").alias("of")))
        nodes = stage(level.join(counted, "node"), "nodes")
        work = F.greatest(F.col("size").cast("double") * F.col("m") / NODE_WORK, F.pow(F.col("size") / NODE_SHINGLES, 2))
        large = (work > 1) & (F.col("m") > 2)
        stuck = large & ((2 * F.col("m") > F.coalesce("of", 2 * F.col("m"))) | F.lit(depth == LEVELS))
        # The exact way for what does not part: all pairs of blocks of a node.
        split = F.ceil(F.sqrt(work) * 2).cast("int")
        mine = F.pmod(F.xxhash64("rep", "node"), split)
        blocks_ = (nodes.where(stuck).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), split - 1)))
                   .select(F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("node"), "rep"))
        kept += [nodes.where(~large).select("node", "rep"), blocks_]
        deeper = nodes.where(large & ~stuck).select("node", "rep", "m")
        if deeper.isEmpty():
            break
        level = stage(deeper.join(classes.select("rep", "n", "tokens"), "rep").select("node", "rep", "n", "tokens", "m")
                      .mapInArrow(branch(False), branches), "level")
    members = kept[0]
    for more in kept[1:]:
        members = members.unionAll(more)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        node, reps, sets = None, [], []

        def links() -> pa.RecordBatch:
            pairs = linked(sets, percent)
            return pa.RecordBatch.from_arrays([pa.array([reps[a] for a, _ in pairs], pa.int64()),
                                               pa.array([reps[b] for _, b in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            for a in range(0, len(batch), 64):
                part = batch.slice(a, 64)
                found = shingle_sets([unpack.decompress(x, max_output_size=0) for x in part.column(2).to_pylist()])
                for at, rep, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), found):
                    if at != node:
                        if len(reps) > 1:
                            yield links()
                        node, reps, sets = at, [], []
                    reps.append(rep)
                    sets.append(own)
        if len(reps) > 1:
            yield links()

    texts = _pack(docs, key, text)
    edges = (texts.join(members.withColumnRenamed("rep", "doc"), "doc").select("node", F.col("doc").alias("rep"), "packed")
             .repartition("node").sortWithinPartitions("node", "rep").mapInArrow(compare, "a long, b long"))
    joined = components(edges)
    of_class = (classes.select("s1", "s2", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
                .select("s1", "s2", F.coalesce("component", "rep").alias("component")))
    out = signed.select("doc", "n", "s1", "s2").join(of_class, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc"))
    component = F.when(F.col("doc").isNotNull(), component)
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"))


def op6_chosen_path_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
