import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid
from tidemark.llm.langid import BUCKETS, fit_ftrl, fit_temperature, fold, gram_counts, op2_language_id, predict, softmax, train


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = got[got.held_out]
    right = held.lang == held.lang_pred
    assert right.mean() > 0.97
    assert got.score.between(0, 1).all()
    # Calibrated: the mean score is close to the share of right answers.
    assert abs(held.score.mean() - right.mean()) < 0.03


def test_nothing_but_text_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = train(docs.where(fold(F.col("doc_id")) != 2))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")).withColumn("score", F.lit(9))
    a, b = (sorted(map(tuple, predict(d, model).collect())) for d in (docs, other))
    assert a == b


def test_edges(spark):
    docs = spark.createDataFrame([(1, "der die das und nicht ein", "de"), (2, "the and of with that is", "en"), (3, None, "en"), (4, "", None),
                                  (5, "12 -- !", "de"), (6, "the " * 50000, None), (None, "the of and", None), (2, "the and of with that is", "en")],
                                 "doc_id long, text string, lang string")
    more = [(100 + i, t, l) for i in range(20) for t, l in (("der die das und nicht ein", "de"), ("the and of with that is", "en"))]
    model = train(docs.unionAll(spark.createDataFrame(more, docs.schema)))
    got = {(r.doc_id, r.lang_pred) for r in predict(docs, model).collect()}
    assert {(1, "de"), (2, "en"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (None, "en")} == got
    none = train(docs.where("lang is null"))
    assert {r.lang_pred for r in predict(docs, none).collect()} == {"und"}
    assert predict(docs.limit(0), model).count() == 0 and train(docs.limit(0)).languages == []
    assert predict(docs, train(docs.where("lang = 'en'"))).where("lang_pred = 'en'").count() == 5


def test_counts_do_not_cross_texts():
    alone = [gram_counts([t])[0][0] for t in (b"abc", b"", "Éß".encode())]
    together, letters = gram_counts([b"abc", b"", "Éß".encode()])
    assert np.array_equal(together, np.stack(alone)) and letters.tolist() == [3, 0, 2]


def test_ftrl_is_sparse_and_separates():
    r = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(300):
        y = r.integers(0, 3)
        at = np.unique(np.append(r.integers(100, BUCKETS, 30), [y * 7, y * 7 + 1])).astype(np.int32)
        rows.append((at, np.full(len(at), 1 / np.sqrt(len(at)), np.float32)))
        labels.append(y)
    weights = fit_ftrl(rows, np.array(labels), 3, l1=0.3)
    assert (weights != 0).mean() < 0.02
    scores = np.array([x @ weights[at] for at, x in rows])
    assert (scores.argmax(1) == labels).mean() > 0.99


def test_temperature_minimises_log_loss():
    r = np.random.default_rng(2)
    scores = r.normal(size=(4000, 4))
    labels = np.array([r.choice(4, p=p) for p in softmax(scores)])
    assert abs(fit_temperature(scores * 5, labels) - 5) < 0.6
    assert fit_temperature(np.zeros((0, 2)), np.zeros(0, int)) == 1.0
