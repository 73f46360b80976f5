import math
import random
import re

import numpy as np
import pytest

from tidemark.llm.k2treap import K2Treap, build_index, op11_k2_treap_search, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = "/root/testdata/sf0.001"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n, length = len(held), sum(len(t) for _, t in held)
    out = []
    for item, text in items:
        wanted, scores = set(terms(text)), []
        df = {w: sum(w in t for _, t in held) for w in wanted}
        for i, t in held:
            m = 100 - 90 + (90 * len(t) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * t.count(w)) // (1000 * t.count(w) + 8 * m))
                        for w in wanted if w in t)
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("seed", range(4))
def test_tree_holds_all_points_and_maxima(seed):
    r = np.random.default_rng(seed)
    n = [1, 2, 60, 3000][seed]
    points = np.unique(r.integers(0, [5, 9, 40, 900][seed], (n, 2)), axis=0)
    value = r.integers(0, 1_000_000, len(points))
    built = K2Treap.build(points[:, 0], points[:, 1], value)
    for tree in (built, K2Treap.unpack(built.pack())):
        assert np.array_equal(tree.top, built.top) and tree.top[0] == value.max()
        assert sorted(zip(tree.row.tolist(), tree.col.tolist(), tree.top[tree.leaf].tolist())) == sorted(
            zip(points[:, 0].tolist(), points[:, 1].tolist(), value.tolist()))
        assert (tree.top[tree._parents()] >= tree.top[1:]).all()


@pytest.mark.parametrize("shard", [400, 1 << 20])
def test_against_plain_scores(spark, monkeypatch, shard):
    import tidemark.llm.k2treap as module

    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "é", "日本", "x1y", "K", "Kelvin"]
    some = lambda n: r.choice([" ", "-", ", "]).join(r.choice(vocabulary) for _ in range(n))
    docs = [(i, some(r.randint(0, 40))) for i in range(150)]
    docs += [(500 - i, "w1 w2 W3 rare") for i in range(40)]  # copies: equal scores
    docs += [(900, None), (901, ""), (902, "... --"), (903, "w5 " * 3000), (903, "w5 w6"), (903, "w5 w6"), (None, "w5 w6 rare")]
    items = [(i, some(r.randint(1, 12))) for i in range(25)] + [(100, None), (101, "?!"), (102, "unseen"), (103, "w1 w1 W1 rare"), (104, "w5")]
    monkeypatch.setattr(module, "SHARD_BYTES", shard)
    monkeypatch.setattr(module, "BLOCK_ITEMS", 12)
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, terms string, df int").repartition(3)
    queries = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    assert result(search(build_index(frame), queries)) == plain(docs, items)


def test_no_documents_no_items(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert result(search(build_index(docs), items)) == []
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert result(search(build_index(some), items.where("false"))) == []
    nulls = spark.createDataFrame([(None, None), (None, "a")], "doc_id long, text string")
    assert result(search(build_index(nulls), items)) == []


def test_repeated_items_are_one(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "d e")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (1, "c a"), (None, "d")], "item_id long, text string")
    one = spark.createDataFrame([(1, "a c"), (None, "d")], "item_id long, text string")
    rows = lambda df: sorted(map(str, df.collect()))
    index = build_index(docs)
    assert rows(search(index, items)) == rows(search(index, one)) and len(rows(search(index, one))) == 3


def test_whole_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert result(op11_k2_treap_search(spark, SMALL)) == plain(docs, items)
