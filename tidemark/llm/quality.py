"""Quality rules: compression bands over whole documents and fixed chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.words import SPACE, Words, blobs, blocks, grams
from tidemark.shipping import ship_package

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Band:
    """Accepted ratios of raw to compressed bytes for texts of less than ``below`` bytes."""

    below: float
    low: float
    high: float


#: Short texts hold the frame header and little repetition; ratios rise with length. From 256 bytes on the lower limits
#: lie between random data as base64 (up to 1.14, 1.19, 1.26, 1.33) and the prose of the test tables (from 1.20, 1.41, 1.43, 1.69).
DOCUMENT_BANDS = (Band(256, 0.80, 3.0), Band(384, 1.16, 4.5), Band(512, 1.25, 4.5), Band(1024, 1.35, 4.5), Band(4096, 1.45, 7.0),
                  Band(16384, 1.45, 10.0), Band(float("inf"), 1.45, 14.0))
#: Limits of one chunk of ``CHUNK_BYTES``; the last, shorter one takes the band of its length.
CHUNK_BANDS = (Band(256, 0.70, 6.0), Band(384, 1.16, 12.0), Band(512, 1.25, 12.0), Band(1024, 1.35, 12.0), Band(float("inf"), 1.45, 24.0))
CHUNK_BYTES = 4096
#: A document goes when more than this share of its chunks lies outside the chunk bands.
BAD_CHUNK_SHARE = 0.5
LEVEL = 3

SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, n_bytes long, ratio double, n_chunks long, n_repetitive_chunks long, "
          "n_random_chunks long, verdict string, kept boolean")


def _band(size: int, bands: tuple[Band, ...]) -> Band:
    return next(b for b in bands if size < b.below)


def compression(text: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, int, int, int, str]:
    """Ratio, chunks, repetitive and incompressible chunks, verdict of one text; an empty text passes."""
    if not text:
        return 1.0, 0, 0, 0, "ok"
    ratio = len(text) / len(compressor.compress(text))
    band, repetitive, incompressible = _band(len(text), DOCUMENT_BANDS), 0, 0
    n = -(-len(text) // CHUNK_BYTES)
    for i in range(n):
        chunk = text[i * CHUNK_BYTES : (i + 1) * CHUNK_BYTES]
        of = len(chunk) / len(compressor.compress(chunk)) if n > 1 else ratio
        limits = _band(len(chunk), CHUNK_BANDS)
        repetitive += of > limits.high
        incompressible += of < limits.low
    if ratio > band.high:
        verdict = "repetitive"
    elif ratio < band.low:
        verdict = "incompressible"
    elif repetitive > BAD_CHUNK_SHARE * n:
        verdict = "repetitive_chunks"
    elif incompressible > BAD_CHUNK_SHARE * n:
        verdict = "incompressible_chunks"
    else:
        verdict = "ok"
    return ratio, n, repetitive, incompressible, verdict


def measure(texts: list[bytes]) -> dict[str, list]:
    """Base counts of several texts at once, and the compression verdict of each."""
    words = Words(texts)
    n_words = words.last - words.first
    hashes = words.hashes()
    triple = grams(hashes, 3)
    inside = words.text[: len(triple)] == words.text[2:] if len(triple) else np.zeros(0, bool)
    covered = np.zeros(len(words), bool)
    if inside.any():
        at = np.flatnonzero(inside)
        # A window counts within its own text: the text number is part of what is compared.
        order = np.lexsort((triple[at], words.text[at]))
        same = (triple[at][order][1:] == triple[at][order][:-1]) & (words.text[at][order][1:] == words.text[at][order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        for j in range(3):
            covered[at[twice] + j] = True
    repeated = np.concatenate([[0], np.cumsum(covered)])
    n_repeat = repeated[words.last] - repeated[words.first]
    letters = words.count(~words.gap & ((words.data & 0xC0) != 0x80))
    symbols = words.count(_SYMBOL[words.data])
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    rows = []
    for i, text in enumerate(texts):
        lines = [x for x in text.split(b"\n") if x.strip()]
        ratio, n, rep, rnd, verdict = compression(text, compressor)
        failed = bool(n_words[i] < 50 or 100 * n_repeat[i] > 50 * n_words[i])
        rows.append((int(n_words[i]), int(letters[i]), int(symbols[i]), len(lines) - len(set(lines)), int(n_repeat[i]),
                     failed, len(text), ratio, n, rep, rnd, verdict, not failed and verdict == "ok"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}


_ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def quality_rules(docs: DataFrame, text: str = "text", carry: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Counts, compression figures and the verdict of every whole text, beside its row.

    ``carry`` names the columns of ``docs`` to return, all by default; result columns, whose
    names ``prefix`` goes before, replace columns of the same name. A missing
    text is empty: it has no words, fails the base rules and compresses to nothing. Repeated rows
    are judged one by one; an empty table gives an empty result. No shuffle: texts are judged
    in the task that reads them, about a megabyte at a time.
    """
    ship_package(docs.sparkSession)
    fields = [(prefix + n, t) for n, t in (x.split() for x in SCHEMA.split(", "))]
    new = {name for name, _ in fields}
    carried = [c for c in (docs.columns if carry is None else carry) if c not in new]
    source = docs.select(docs[text].alias("__text"), *[docs[c] for c in carried])
    types = [(n, _ARROW[t]) for n, t in fields]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(texts := blobs(batch.column(0))):
                found = measure(texts[part])
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[1:], *[pa.array(found[n.removeprefix(prefix)], t) for n, t in types]],
                    [*batch.schema.names[1:], *[n for n, _ in types]])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[1:]] + [f"{n} {t}" for n, t in fields])
    return source.mapInArrow(judge, schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["doc_id"])
