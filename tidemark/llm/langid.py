"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.words import blocks, blobs, stream
from tidemark.shipping import ship_package

#: Buckets that n-grams of 1 to 3 characters are hashed to; they bound the model and the counts.
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: Expected labelled rows of each language that the classifier is fitted on; document frequencies come from all.
SAMPLE_PER_LANGUAGE = 600
EPOCHS = 3
UNKNOWN = "und"

_BLOCK = 1 << 18
_HASH = stream(21, 3) | np.uint64(1)
_NORMS = 1e-12


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams of each text as a matrix, and the number of its letters.

    Texts are lower-cased; whatever is not a letter counts as one kind of space.
    """
    lowered = [t.decode("utf-8", "replace").lower() for t in texts]
    size = np.fromiter(map(len, lowered), np.int64, len(texts))
    # Two spaces between texts: no n-gram has characters of both.
    codes = np.frombuffer("".join(t + "  " for t in lowered).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    letter = _letters()[codes]
    codes[~letter] = 32
    start = np.cumsum(size + 2) - size - 2
    one = codes * _HASH[0]
    two = one[:-1] + codes[1:] * _HASH[1]
    three = two[:-1] + codes[2:] * _HASH[2]
    shift = np.uint64(64 - BUCKET_BITS)
    spread = lambda x, k: ((x ^ (x >> np.uint64(29))) * _HASH[k] >> shift).astype(np.int64)
    grams = [spread(one, 1), spread(two, 2), spread(three, 0)]
    counts = np.zeros((len(texts), BUCKETS), np.float32)
    total = np.append(0, np.cumsum(letter))
    for i, (a, n) in enumerate(zip(start.tolist(), size.tolist())):
        for g in grams:
            counts[i] += np.bincount(g[a : a + n], minlength=BUCKETS)
    return counts, total[start + size] - total[start]


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Logarithmic counts times inverse document frequency, of length one."""
    values = np.log1p(counts) * idf
    return values / np.maximum(np.sqrt((values * values).sum(1, keepdims=True)), _NORMS)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    temperature: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        return softmax(tf_idf(counts, self.idf) @ self.weights / self.temperature)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_classes: int, alpha: float = 1.0,
             beta: float = 1.0, l1: float = 0.02, l2: float = 0.001, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights by follow the regularised leader with L1 and L2 penalties, one example after another.

    ``rows`` are (buckets, values) of each example. A weight is zero as long as its sum of adjusted
    gradients stays within ``l1``, which is what keeps the model sparse.
    """
    z, n = np.zeros((BUCKETS, n_classes)), np.zeros((BUCKETS, n_classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            at, x = rows[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[at] = more
    return weights(z, n).astype(np.float32)


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """Divisor of the scores with the least log loss on held-back rows (golden-section search)."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(softmax(scores / np.exp(t))[np.arange(len(labels)), labels] + 1e-15).mean()
    a, b, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 4; 2 is held out. A row without a key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4, F.lit(0))


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on rows with a language: document frequencies of all, a classifier on a bounded sample.

    Rows of fold 1 of the sample set the temperature, the others the weights. Without labelled rows
    the model knows no language.
    """
    spark = labelled.sparkSession
    ship_package(spark)
    rows = labelled.where(labelled[lang].isNotNull()).select(labelled[key].alias("key"), labelled[text].alias("text"), labelled[lang].alias("lang"))
    sizes = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, 0), np.float32), 1.0)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            texts = blobs(batch.column(0))
            for part in blocks(texts, _BLOCK):
                for a in range(part.start, part.stop, 64):
                    counts, _ = gram_counts(texts[a : min(a + 64, part.stop)])
                    documents[:-1] += (counts > 0).sum(0)
                    documents[-1] += len(counts)
        some = np.flatnonzero(documents)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(documents[some])], ["bucket", "n"])

    found = rows.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    documents = np.zeros(BUCKETS + 1)
    documents[found["bucket"].to_numpy()] = found["n"].to_numpy()
    idf = (np.log((1 + documents[-1]) / (1 + documents[:-1])) + 1).astype(np.float32)

    # Each row is taken by a hash of key and text, with the share that its language needs.
    share = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(min(1.0, SAMPLE_PER_LANGUAGE / sizes[name])))])
    chance = F.pmod(F.xxhash64("key", "text"), F.lit(1_000_003)) / 1_000_003
    sample = rows.where(chance < F.element_at(share, F.col("lang")))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = blobs(batch.column(0))
            for a in range(0, len(texts), 64):
                values = tf_idf(gram_counts(texts[a : a + 64])[0], idf)
                at = [np.flatnonzero(v).astype(np.int32) for v in values]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[a : a + 64], batch.column(2)[a : a + 64], pa.array([x.tobytes() for x in at], pa.binary()),
                     pa.array([v[x].tobytes() for v, x in zip(values, at)], pa.binary())], ["lang", "fold", "at", "x"])

    taken = (sample.select("text", "lang", fold(F.col("key")).alias("fold"), F.xxhash64("key", "text").alias("h"))
             .select("text", "lang", "fold", "h").mapInArrow(lambda b: vectors(x.select(["text", "lang", "fold"]) for x in b),
                                                             "lang string, fold long, at binary, x binary").toPandas())
    taken = taken.sort_values(["lang", "at", "x"], kind="stable").reset_index(drop=True)  # the same order on any cluster
    data = [(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32)) for a, x in zip(taken["at"], taken["x"])]
    labels = taken["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy()
    check = (taken["fold"] == 1).to_numpy()
    if check.all():
        check[:] = False
    weights = fit_ftrl([d for d, c in zip(data, check) if not c], labels[~check], len(languages))
    scores = np.array([x @ weights[at] for (at, x), c in zip(data, check) if c]).reshape(-1, len(languages))
    return Model(languages, idf, weights, fit_temperature(scores, labels[check]))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, lang_pred and score of every whole text.

    A text that is missing or has no letter is ``und`` with score 0, and so is every text if the model knows
    no language. Ties go to the first language by name. Rows are judged where they are read.
    """
    ship_package(docs.sparkSession)
    names = np.array([*model.languages, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = blobs(batch.column(1))
            for part in blocks(texts, _BLOCK):
                for a in range(part.start, part.stop, 64):
                    b = min(a + 64, part.stop)
                    counts, letters = gram_counts(texts[a:b])
                    best, score = np.full(b - a, len(names) - 1), np.zeros(b - a)
                    if len(names) > 1:
                        p = model.probabilities(counts)
                        some = letters > 0
                        best[some], score[some] = p.argmax(1)[some], p.max(1)[some]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[a:b], pa.array(names[best], pa.string()), pa.array(np.minimum(score, 1.0))],
                        [key, "lang_pred", "score"])

    return docs.select(docs[key], docs[text]).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(fold(F.col("doc_id")) != 2))
    return predict(docs, model).withColumn("held_out", fold(F.col("doc_id")) == 2)
