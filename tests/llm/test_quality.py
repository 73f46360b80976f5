import base64
import random
import re
from collections import Counter

import pytest
import zstandard

from tidemark.llm.quality import CHUNK_BYTES, compression, op10_quality_rules, quality_rules

WORDS = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    words = WORDS.findall(text)
    triples = list(zip(words, words[1:], words[2:]))
    twice = {t for t, c in Counter(triples).items() if c > 1}
    inside = {i + j for i, t in enumerate(triples) if t in twice for j in range(3)}
    lines, seen, repeated = text.split("\n"), set(), 0
    for line in lines:
        if WORDS.search(line):
            repeated += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(inside), failed


def texts():
    r = random.Random(5)
    alphabet = "abcdefgh éßñ日😀\n\t\x0b\x0c\r\x1c\xa0#*$%&|<>.,"
    out = ["".join(r.choices(alphabet, k=r.choice([0, 1, 5, 60, 400, 3000]))) for _ in range(60)]
    prose = " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(400))
    return out + [None, "", " \n ", "a", "a b c a b c", prose, prose + "\n" + prose, "line one is here\n" * 90, "word " * 60000, prose.replace(" ", "\n")]


def test_base_counts(spark):
    rows = [(i % 50, t, "x", 0.5) for i, t in enumerate(texts())]  # keys repeat
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept double").repartition(3)
    got = [(r.doc_id, r.text, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(docs).collect()]
    want = [(i, t, *plain(t or "")) for i, t, *_ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_bands():
    z = zstandard.ZstdCompressor(level=3)
    r = random.Random(3)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 8))) for _ in range(3000)]
    prose = " ".join(r.choice(words) for _ in range(6000)).encode()
    for size in (60, 300, 2000, 9000, 30000):
        assert compression(prose[:size], z)[4] == "ok"
    assert compression(b"the same again " * 900, z)[4] == "repetitive"
    noise = bytes(r.choices(range(33, 127), k=20000))
    assert compression(bytes(r.choices(range(256), k=20000)), z)[4] == "incompressible"
    assert compression(noise, z)[4] in ("incompressible", "incompressible_chunks")
    # Most chunks are runs of one letter, which the whole does not show.
    half = prose[: 4 * CHUNK_BYTES] + b"".join(bytes([97 + i]) * CHUNK_BYTES for i in range(6))
    assert compression(half, z)[4] == "repetitive_chunks"
    assert compression(b"", z) == (1.0, 0, 0, 0, "ok")


def test_encoded_noise():
    z = zstandard.ZstdCompressor(level=3)
    r = random.Random(7)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n)).encode()[:n]
    noise = lambda n, encode=base64.b64encode: encode(r.randbytes(n))[:n]
    for size in (256, 383, 384, 511, 512, 1023, 1024, 2500, 4095, 4096, 9000, 40000):
        for encode in (base64.b64encode, base64.encodebytes, base64.b85encode):
            assert compression(noise(size, encode), z)[4] == "incompressible", (size, encode)
        assert compression(prose(size), z)[4] == "ok", size
    # Most chunks are base64, which the whole does not show.
    parts = [noise(CHUNK_BYTES), prose(CHUNK_BYTES), noise(CHUNK_BYTES), prose(CHUNK_BYTES), noise(CHUNK_BYTES)]
    _, n, _, bad, verdict = compression(b"".join(parts * 4), z)
    assert (n, bad, verdict) == (20, 12, "incompressible_chunks")
    assert compression(b"".join(parts[:4] * 4), z)[4] == "ok"  # half is not most


def test_registered_query(spark):
    got = op10_quality_rules(spark, "/root/testdata/sf0.001")
    assert "text" not in got.columns
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(docs[r.doc_id])
        assert r.kept == (not r.base_failed and r.verdict == "ok")


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(Exception):
        quality_rules(spark.createDataFrame([], "doc_id long")).count()
