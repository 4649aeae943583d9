"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of a text (lower case, white space as one kind). The ratio of an
n-gram is the log of its smoothed share in toxic documents over that in others; n-grams whose ratio
isn't beyond ``LEAST_Z`` standard errors have none. Logistic regression with an L2 penalty weighs the
scaled features. It is learned on a bounded labelled sample, in one task, so that
neither its texts nor its arrays are on the driver; texts are scored whole.

Null and empty texts get the score of a text without features. Without rows of both labels the score
is 1 or 0, by the one label there is (0 without any row). Every row has its result, repeated ones the same,
whatever its id; an empty table gives none, further columns are ignored (``scores``) or carried on
(``keep_civil``) whatever their names. Very long texts are read whole, each in a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm import ngrams
from evenkeel.llm.arrow import bounded_batches, slices, text_array, trimmed

SIZES, BITS = range(3, 7), 20
#: Smoothing of the counts; least standard errors of a ratio; least documents of an n-gram; L2 penalty; steps.
SMOOTH, LEAST_Z, LEAST_DOCS, PENALTY, STEPS = 0.5, 3.0, 3, 1.0, 300


@dataclass
class Model:
    weights: np.ndarray  # of each bucket: weight times ratio, 0 for most
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        points, at = ngrams.code_points(texts)
        text, bucket = _kept(points, at, self.weights != 0)
        z = self.bias + np.bincount(text, self.weights[bucket], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _kept(points: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs (text, bucket) of the buckets in ``keep``."""
    pairs = [np.zeros(0, np.int64)]
    for n, bucket in ngrams.hashes(points, SIZES, BITS):
        start = np.flatnonzero(keep[bucket])
        text = np.searchsorted(at, start, side="right") - 1
        own = start + n <= at[text + 1]
        pairs.append((text[own].astype(np.int64) << BITS) | bucket[start[own]])
    pairs = np.unique(np.concatenate(pairs))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def fit(rows: list[tuple[str, int]]) -> Model:
    y = np.array([int(label) for _, label in rows], float)
    if len(set(y)) < 2:
        p = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(1 << BITS, np.float32), 500.0 if p else -500.0)
    parts = [slice(i, i + 200) for i in range(0, len(rows), 200)]
    arrays = [ngrams.code_points(text_array(pa.array([t for t, _ in rows[p]]))) for p in parts]
    count = np.zeros((2, 1 << BITS))
    for p, (points, at) in zip(parts, arrays):
        text, bucket = _kept(points, at, np.ones(1 << BITS, bool))
        for k in (0, 1):
            count[k] += np.bincount(bucket[y[p][text] == k], minlength=1 << BITS)
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    ratio = np.log((count[1] + SMOOTH) / (n[1] + 2 * SMOOTH)) - np.log((count[0] + SMOOTH) / (n[0] + 2 * SMOOTH))
    error = np.sqrt(1 / (count[1] + SMOOTH) + 1 / (count[0] + SMOOTH))
    ratio[(np.abs(ratio) < LEAST_Z * error) | (count.sum(0) < LEAST_DOCS)] = 0

    text, bucket = (np.concatenate(x) for x in zip(*((t + p.start, b) for p, (points, at) in zip(parts, arrays) for t, b in [_kept(points, at, ratio != 0)])))
    used, column = np.unique(bucket, return_inverse=True)
    x = ratio[used][column]
    share = n[1] / len(y)
    w, b = np.full(len(used), 1.0 / max(1, len(x) / len(y))), float(np.log(share / (1 - share)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):  # Adam
        z = b + np.bincount(text, w[column] * x, len(y))
        r = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        g = np.append(np.bincount(column, r[text] * x, len(w)) / len(y) + PENALTY * w / len(y), r.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        d = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - d[:-1], b - d[-1]
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w * ratio[used]
    return Model(weights, float(b))


def learned(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", **options) -> Model:
    from evenkeel.llm.sample import labelled_rows

    bounded_batches(docs.sparkSession)
    rows = labelled_rows(docs, labels, label_col, learn, **options).withColumn("label", F.col("label").cast("int"))
    # One partition already, as the sample is the first rows in an order.
    got = rows.coalesce(1).mapInArrow(trimmed(_fitted), "bucket int, weight double").toArrow()
    return unpacked(got["bucket"].to_numpy(), got["weight"].to_numpy()) if got.num_rows else fit([])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows (text, label) of a partition."""
    texts, labels = [], []
    for batch in batches:
        texts += batch.column("text").to_pylist()
        labels += batch.column("label").to_pylist()
    bucket, weight = packed(fit(list(zip(texts, labels))))
    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(weight)], ["bucket", "weight"])


def packed(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that have a weight, and their weights; before them -1 and the bias."""
    used = np.flatnonzero(model.weights)
    return np.append(-1, used).astype(np.int32), np.append(model.bias, model.weights[used].astype(float))


def unpacked(bucket: np.ndarray, weight: np.ndarray) -> Model:
    weights = np.zeros(1 << BITS, np.float32)
    weights[bucket[bucket >= 0]] = weight[bucket >= 0]
    return Model(weights, float(weight[bucket < 0][0]))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score; one row per row, no shuffle."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for b in slices(batch):
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(m.score(text_array(b.column("text"))))], ["id", "score"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(trimmed(run), f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_civil(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with all their columns; no shuffle."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for b in slices(batch, text_col):
                yield b.filter(pa.array(m.score(text_array(b.column(text_col))) < 0.5))

    return docs.mapInArrow(trimmed(run), docs.schema)
