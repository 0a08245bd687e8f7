"""Toxicity scores from subword-bag embeddings and a linear softmax."""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.shared import give_back_memory, words_of

BUCKETS, DIMENSIONS = 1 << 20, 8
GRAMS = (3, 4, 5, 6)
#: Most labelled documents of each class that a model is fitted on.
FIT_ROWS = 1500
EPOCHS, RATE, DECAY = 300, 0.05, 1e-3
#: A bucket is trained if its mean share differs between the classes by so many standard errors.
LEAST_EVIDENCE = 6.0
#: Empty places in every bag, so that one odd n-gram does not decide about a few words.
BLANK = 60
CACHED = 400_000


def subword_buckets(word: bytes) -> list[int]:
    """Buckets of a lower-cased word and its character 3- to 6-grams with border marks."""
    mask, crc = BUCKETS - 1, zlib.crc32
    if word.isascii():  # characters are bytes
        w = b"<" + word.lower() + b">"
        return [crc(w) & mask, *[crc(w[i : i + n]) & mask for n in GRAMS for i in range(len(w) - n + 1)]]
    w = f"<{word.decode().lower()}>"
    return [crc(g.encode()) & mask for g in (w, *[w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1)])]


def subwords(word: bytes) -> np.ndarray:
    return np.array(subword_buckets(word), np.int64)


@dataclass
class SubwordModel:
    """Weight of each bucket in the class-1 margin, and the margin of an empty bag.

    The softmax is linear and the bag is a plain mean, so a bucket's embedding
    enters the margin only through its product with the difference of the two
    class vectors: one number per bucket scores any text.
    """

    weight: np.ndarray
    margin: float

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer(dict):
    """Word -> (sum of its buckets' weights, number of buckets), kept for repeated words."""

    def __init__(self, model: SubwordModel):
        super().__init__()
        self.model = model
        self.weight = array("d", model.weight.tolist())

    def __missing__(self, word: bytes) -> tuple[float, int]:
        at = subword_buckets(word)
        got = sum(map(self.weight.__getitem__, at)), len(at)
        if len(word) <= 48:
            if len(self) >= CACHED:
                self.clear()
            self[word] = got
        return got

    def score(self, text: str | None) -> float:
        """Probability of class 1; a text without words gets the empty bag's."""
        total, count = 0.0, 0
        for weight, n in map(self.__getitem__, words_of(text)):
            total += weight
            count += n
        return float(1 / (1 + np.exp(-(self.model.margin + total / (count + BLANK)))))


def fit(texts: list[str | None], labels: list[int]) -> SubwordModel:
    """Train bucket embeddings and class vectors together by Adam on class-balanced log loss.

    A bag is the mean of a document's subword vectors. Only buckets whose share
    tells the classes apart are trained; the others keep the zero vector. One class alone, or no row, gives a model that always answers with the share
    of class 1 (0 without rows).
    """
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        return SubwordModel(np.zeros(BUCKETS), 20.0 if len(y) and y[0] == 1 else -20.0)
    bags, known = [], {}
    having = np.zeros((2, BUCKETS))
    for text, label in zip(texts, labels):
        words = Counter(words_of(text))
        parts = [known.setdefault(w, subwords(w)) if len(w) <= 48 else subwords(w) for w in words]
        sizes = [len(p) for p in parts]
        every = np.concatenate([np.zeros(0, np.int64), *parts])
        times = np.repeat(list(words.values()), sizes).astype(float)
        at, place = np.unique(every, return_inverse=True)
        found = np.bincount(place, times, len(at)).astype(np.int64)
        # Whole counts in the narrowest type: all bags are held at a time, on the driver.
        bags.append((at.astype(np.int32), found.astype(np.min_scalar_type(found.max(initial=0))), times.sum() + BLANK))
        having[label, at] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()])[:, None]
    rate = having.sum(0) / n.sum()
    error = np.sqrt(np.maximum(rate * (1 - rate), 1 / n.sum()) * (1 / n).sum())
    kept = np.flatnonzero(np.abs(having[1] / n[1] - having[0] / n[0]) / error >= LEAST_EVIDENCE)
    column = np.full(BUCKETS, -1)
    column[kept] = np.arange(len(kept))
    x = np.zeros((len(y), len(kept)))
    for row, (at, found, size) in enumerate(bags):
        hit = column[at] >= 0
        x[row, column[at[hit]]] = found[hit].astype(float) / size
    del bags, known, having
    scale = 1 / np.maximum(np.sqrt((x * x).mean(0)), 1e-12)
    x *= scale

    rng = np.random.default_rng(5)
    embed = np.zeros((len(kept), DIMENSIONS))
    vectors, bias = rng.uniform(-1, 1, (DIMENSIONS, 2)), np.zeros(2)
    parameters = [embed, vectors, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    target = np.stack([1 - y, y], 1)
    for step in range(1, EPOCHS + 1):
        hidden = x @ embed
        logits = hidden @ vectors + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        wrong = (p - target) * balance[:, None]
        gradients = [x.T @ (wrong @ vectors.T) + DECAY * embed, hidden.T @ wrong + DECAY * vectors, wrong.sum(0)]
        for q, (m, v), g in zip(parameters, moments, gradients):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-4)
    weight = np.zeros(BUCKETS, np.float32)
    weight[kept] = scale * (embed @ (vectors[:, 1] - vectors[:, 0]))
    return SubwordModel(weight, float(bias[1] - bias[0]))


def fit_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> SubwordModel:
    """Fit on at most ``rows`` labelled documents of each class, those with the smallest hash of their key.

    A key labelled twice counts once, as class 1 if any row says so; null labels
    and keys are left out. The chosen labels (at most ``2 * rows`` of them) are broadcast.
    """
    named = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).dropna().groupBy("key").agg(F.max("label").alias("label"))
    chosen = [named.where(F.col("label") == k).orderBy(F.xxhash64("key"), "key").limit(rows) for k in (0, 1)]
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(
        F.broadcast(chosen[0].unionByName(chosen[1])), "key"
    )
    got = picked.dropDuplicates(["key"]).orderBy("key").toPandas()  # bounded by 2 * rows documents
    model = fit(got["text"].tolist(), [int(x) for x in got["label"]])
    del got
    give_back_memory()
    return model


def score_toxicity(
    docs: DataFrame, model: SubwordModel, key: str = "doc_id", text: str = "text", threshold: float = 0.7, carry: list[str] | None = None
) -> DataFrame:
    """``key`` (or the columns of ``carry``, the text's among them)``, score, predicted`` of every whole text, in place.

    A null or empty text gets the empty bag's score. Null and repeated keys keep
    a row per input row; an empty table gives none; other columns are ignored.
    """
    columns = carry or [key, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            scores = [scorer.score(t) for t in batch.column(columns.index(text)).to_pylist()]
            kept = batch.columns if carry else batch.columns[:1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], names)

    out = [f.simpleString().split(":", 1) for f in docs.select(*(carry or [key])).schema]
    names = [n for n, _ in out] + ["score"]
    scored = docs.select(*columns).mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in out) + ", score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
