import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from tidemark.llm.bpe import Merges, bpe_round_trip
from tidemark.llm.pieces import PieceCache

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return (Merges.load(PATH, P.PATTERN),
            tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}))


ODD = ["", " ", "  a  b ", "a\n b\n\n  c", "aaaa aaaaa aaaaaaa", "it's we'll 'tis'", "x\t\r\n y z 　q", "\x1c\x1d a\x1e b",
       "1234567890 12.5%", "日本語 テキスト 😀😀", "é" * 50, "<|endoftext|>", "abc" * 300, " \n \n x", "a \n", "\n a", "trailing  "]


def test_same_ids_as_the_reference_library(both):
    merges, own = both
    cache = PieceCache(merges.encode)
    letters = "ab c\n\téöß1'.,-日"
    texts = ODD + ["".join(random.Random(i).choices(letters, k=i)) for i in range(200)]
    for text, ids in zip(texts, cache.ids([t.encode() for t in texts])):
        assert ids.tolist() == own.encode_ordinary(text), text
        assert merges.decode(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=60))
def test_any_text(both, text):
    merges, own = both
    ids = PieceCache(merges.encode).ids([text.encode()])[0]
    assert ids.tolist() == own.encode_ordinary(text)


def test_one_by_one_agrees_with_replay(both):
    merges, _ = both
    words = [b"", b"thethethe", "überfluß".encode(), b"aaaaaaaaaaaaa", b" information", b"\xff\xfe\x00"]
    for word, ids in zip(words, merges.replay(words)):
        assert np.frombuffer(ids, "<u4").tolist() == merges.one_by_one(word)


def test_small_cache_gives_the_same(both):
    merges, own = both
    cache = PieceCache(merges.encode, limit=3)
    for text in ODD * 2:
        assert cache.ids([text.encode()])[0].tolist() == own.encode_ordinary(text)


def test_table(spark, both):
    _, own = both
    rows = [(i % 3, t, "x", 1) for i, t in enumerate(ODD)] + [(7, None, "x", 1), (None, "abc", None, None), (8, "word " * 50000, "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids_sha256 int")
    got = sorted(map(tuple, bpe_round_trip(docs, PATH, P.PATTERN, ids=True).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert got == sorted(want, key=str)
    assert bpe_round_trip(docs.limit(0), PATH, P.PATTERN).count() == 0
