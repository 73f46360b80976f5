import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm.fmindex import FMIndex, WaveletMatrix, earlier_windows, word_windows
from tidemark.llm.pfp import Parse, byte_windows, shared_windows

SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "ß", "日本"]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passages = [some(r.randint(15, 80)) for _ in range(4)]
    rows = []
    for i in range(60):
        words = some(r.randint(0, 60))
        for p in r.sample(passages, r.randint(0, 2)):
            words += p + some(r.randint(0, 9))
        rows.append((i * 3 + 1, r.choice([" ", "\n", "  "]).join(words)))
    base = some(120)
    for i in range(40):  # near and exact copies
        copy = list(base)
        for _ in range(r.randint(0, 2)):
            copy[r.randrange(120)] = r.choice(vocabulary)
        rows.append((500 + i, " ".join(copy)))
    return rows + [(900, None), (901, ""), (902, "a " * 700), (903, "abc" * 300), (904, " \t\n"), (905, "x" * 199), (906, "x" * 200)]


def plain_words(rows):
    texts = sorted((i, SPLIT.findall((t or "").encode())) for i, t in rows)
    seen, out = set(), []
    for i, words in texts:
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            w = tuple(words[s : s + 20])
            if w in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(w)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def plain_bytes(rows):
    texts = sorted((i, (t or "").encode()) for i, t in rows)
    count = {}
    for _, b in texts:
        for s in range(len(b) - 199):
            count[b[s : s + 200]] = count.get(b[s : s + 200], 0) + 1
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 199):
            if count[b[s : s + 200]] > 1:
                gone[s : s + 200] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_word_windows(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "n", 5) for i, t in rows], "doc_id long, text string, n string, key int").repartition(5)
    assert sorted(map(tuple, word_windows(docs).collect())) == plain_words(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_byte_windows(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "n", 5) for i, t in rows], "doc_id long, text string, tag string, doc int").repartition(5)
    assert sorted(map(tuple, byte_windows(docs).collect())) == plain_bytes(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert word_windows(empty).count() == 0 and byte_windows(empty).count() == 0
    lone = spark.createDataFrame([(None, "a " * 30), (3, None)], "doc_id long, text string")
    assert sorted((r.n_words, r.n_removed) for r in word_windows(lone, with_text=True).collect()) == [(0, 0), (30, 0)]
    long = spark.createDataFrame([(1, "lorem ipsum dolor " * 40000), (2, "y" * 100000)], "doc_id long, text string")
    got = {r.doc_id: r for r in word_windows(long).collect()}
    # The first three windows are first places; every word after the first window is inside a later one.
    assert got[1].n_words == 120000 and got[1].n_removed == 119997
    assert {r.doc_id: r.n_removed for r in byte_windows(long).collect()} == {1: 720000, 2: 100000}


def test_wavelet_rank():
    r = np.random.default_rng(1)
    s = r.integers(0, 37, 500)
    tree = WaveletMatrix(s, 6)
    for c in range(37):
        at = r.integers(0, 501, 20)
        assert tree.rank(np.full(20, c), at).tolist() == [int((s[:a] == c).sum()) for a in at]


def test_matching_statistics_of_the_index():
    r = random.Random(3)
    words = [r.randint(1, 3) for _ in range(300)]
    index = FMIndex(np.array([*words, 0]), 8)
    text = np.array([*words, 0])
    length, low, high = index.statistics(text, np.array([0]), np.array([300]))
    for i in range(292):
        assert length[i] == 8
        want = sum(words[j : j + 8] == words[i : i + 8] for j in range(293))
        assert high[i] - low[i] == want


def test_corpus_order_of_a_parse():
    r = random.Random(5)
    texts = ["".join(r.choices("ab", k=r.randint(0, 900))).encode() for _ in range(6)]
    texts += [texts[0][:300], texts[0], b"", b"b" * 500]
    parse = Parse(texts)
    places = np.arange(len(parse.raw))
    rest = lambda p: parse.raw[p : parse.stop[np.searchsorted(parse.stop, p, "right")]]
    got = [rest(p) for p in parse.order(places, 400)]
    # Texts are compared up to 400 bytes: a text's own end is smaller or equal to what follows elsewhere.
    full = [x for x in got if len(x) >= 400]
    assert [x[:400] for x in full] == sorted(x[:400] for x in full)


def test_kernels_on_one_shard():
    texts = [b"a b c " * 10, b"z " * 25]
    n = np.array([11, 6])
    lost = earlier_windows(texts, n, np.array([4, 2]), np.array([0, 0]), np.array([1, 1]))
    assert [x.tolist() for x in lost] == [list(range(3, 11)), [1, 2, 3, 4, 5]]
    assert [len(x) for x in shared_windows([b"q" * 210], np.array([11]), np.array([1]), np.array([0]), np.array([1]))] == [11]


def periodic(sizes, unit):
    """One document per size and period, each with periodic text of its own among words of its own."""
    rows = []
    for size in sizes:
        for period in range(1, 13):
            i = len(rows)
            words = [unit(i, j % period) for j in range(size)]
            rows.append((i, "".join([*(f"a{i}x{j} " for j in range(30)), *words, *(f" b{i}x{j}" for j in range(30))])))
    return rows


def test_periodic_words_of_one_document(spark):
    rows = periodic(range(21, 35), lambda i, j: f"p{i}q{j} ")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain_words(rows)
    assert sum(x[2] for x in want) > 0
    assert sorted(map(tuple, word_windows(docs).collect())) == want


def test_periodic_bytes_of_one_document(spark):
    rows = periodic((201, 202, 207, 212, 230, 260, 300, 340, 375, 376), lambda i, j: chr(0x21 + (i * 7 + j * 5) % 90))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain_bytes(rows)
    assert sum(x[2] for x in want) > 0
    assert sorted(map(tuple, byte_windows(docs).collect())) == want


def test_many_phrases_of_one_key(monkeypatch):
    """Phrases around one common passage: parsed a bounded number of bytes at a time, with the windows of all pairs."""
    from tidemark.llm import pfp

    r = random.Random(9)
    some = lambda k: "".join(r.choices(["th", "er", "on", "an", "re", " ", "é"], k=k)).encode()
    common, copies = some(30), [some(120) for _ in range(9)]
    content = [some(r.randint(50, 90)) + common + (some(90) if i % 3 else r.choice(copies)[: r.randint(150, 200)]) for i in range(300)]
    content += [b"q" * 300, b"q" * 299, b"ab" * 400, content[0][1:], common + copies[0]]
    content = [x for x in dict.fromkeys(content) if len(x) >= 200]
    n = np.array([len(x) - 199 for x in content])
    places = np.where(np.arange(len(n)) % 50 == 7, 2, 1)
    count = {}
    for x in content:
        for s in range(len(x) - 199):
            count[x[s : s + 200]] = count.get(x[s : s + 200], 0) + 1
    want = [[s for s in range(m) if p > 1 or count[x[s : s + 200]] > 1] for x, m, p in zip(content, n.tolist(), places.tolist())]
    sizes = []

    class Seen(pfp.Parse):
        def __init__(self, texts):
            sizes.append(sum(map(len, texts)))
            super().__init__(texts)

    monkeypatch.setattr(pfp, "Parse", Seen)
    monkeypatch.setattr(pfp, "PARSE_BYTES", 1 << 13)
    got = pfp.shared_windows(content, n, np.zeros_like(n), np.zeros_like(n), places)
    assert [x.tolist() for x in got] == want and sum(map(len, want)) > 500
    assert len(sizes) > 5 and max(sizes) <= 1 << 14
    monkeypatch.setattr(pfp, "PARTINGS", 0)
    assert [x.tolist() for x in pfp.shared_windows(content, n, np.zeros_like(n), np.zeros_like(n), places)] == want


def test_keys_over_several_batches(spark):
    """Many phrases of one key come in several batches and stay one shard."""
    r = random.Random(4)
    some = lambda k: "".join(r.choices("abcdefgh ", k=k))
    common, copies = some(80), [some(150) for _ in range(20)]
    rows = [(i, some(r.randint(100, 160)) + common + (some(120) if i % 4 else r.choice(copies))) for i in range(400)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert sorted(map(tuple, byte_windows(docs).collect())) == plain_bytes(rows)
        assert sorted(map(tuple, word_windows(docs).collect())) == plain_words(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
