import random
import re
import time

import numpy as np
import pytest

from tidemark.llm import cpsjoin
from tidemark.llm.components import components
from tidemark.llm.cpsjoin import linked, near_duplicates

WORDS = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain(rows):
    """Components by comparing all pairs."""
    sets = [(k, shingles(t)) for k, t in rows]
    parent = {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return sorted((k, len(s), root(k), root(k) == k) for k, s in sets)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "É", "ß"]
    rows, k = [], 0
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 3, 5, 30, 90, 200]))]
        for _ in range(r.choice([1, 1, 2, 8])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            text = r.choice([" ", "\n", " \t"]).join(copy)
            rows.append((k := k + r.randint(1, 3), text.upper() if r.random() < 0.2 else text))
    chain = [r.choice(vocabulary) for _ in range(400)]
    for _ in range(60):  # a path: each links with its neighbours only
        chain = chain[5:] + [r.choice(vocabulary) for _ in range(5)]
        rows.append((k := k + 1, " ".join(chain)))
    return rows + [(9001, None), (9002, ""), (9003, " \n"), (9004, "one"), (9005, "ONE"), (9006, "one two three four")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_classes_as_all_pairs(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, kept string, n int").repartition(3)
    assert sorted(map(tuple, near_duplicates(docs).collect())) == plain(rows)


def test_large_nodes_branch_and_end_in_blocks(spark, monkeypatch):
    rows = corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(cpsjoin, "NODE_SHINGLES", 1500)
    monkeypatch.setattr(cpsjoin, "LEVELS", 2)
    assert sorted(map(tuple, near_duplicates(docs).collect())) == plain(rows)


@pytest.mark.parametrize("share, cells", [(8, 1 << 21), (2, 200), (40, 200)])
def test_linked_connects_what_all_pairs_connect(monkeypatch, share, cells):
    monkeypatch.setattr(cpsjoin, "DENSE_SHARE", share)
    monkeypatch.setattr(cpsjoin, "BLOCK_CELLS", cells)
    for seed in range(20):
        r = random.Random(seed)
        base = r.sample(range(10**6), 60)
        sets = [np.unique(np.array(r.sample(base, r.randint(48, 60)) + r.sample(range(10**6), r.randint(0, 6)), np.uint64)) for _ in range(40)]

        def classes(pairs):
            label = list(range(40))
            for a, b in pairs:
                label = [label[a] if x == label[b] else x for x in label]
            return [label.index(x) for x in label]

        every = [(i, j) for i in range(40) for j in range(i)
                 if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
        assert classes(linked(sets)) == classes(every)


@pytest.mark.parametrize("shared, own, links", [(70, 15, False), (76, 12, False), (84, 8, False), (169, 15, False), (170, 15, True), (34, 3, True)])
def test_groups_about_the_threshold(shared, own, links):
    """All pairs of a group have the similarity shared / (shared + 2 * own): none links, or all are one class."""
    sets = [np.append(np.arange(shared), np.arange(own) + 10**7 + i * own).astype(np.uint64) for i in range(400)]
    begin = time.perf_counter()
    pairs = linked(sets)
    assert time.perf_counter() - begin < 2
    assert len(pairs) == (len(sets) - 1 if links else 0)


def test_recall_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    sets = [(r.doc_id, x) for r in docs.collect() if (x := shingles(r.text))]
    pairs = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i]
             if 100 * min(len(x), len(y)) >= 85 * max(len(x), len(y)) and 100 * len(x & y) >= 85 * len(x | y)]
    found = sum(got[a] == got[b] for a, b in pairs)
    print(f"recall {found} of {len(pairs)} links")
    assert len(pairs) > 50 and found >= 0.9 * len(pairs)


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)] + [(5, 5)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {}
    for a, b in edges:
        if a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_edges_of_the_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).count() == 0
    long = "many words here and more of them " * 20000
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (6, long), (7, long + "x")]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (4, 2, 4, True), (4, 2, 4, True), (6, 7, 6, True), (7, 8, 6, False)], key=str)
