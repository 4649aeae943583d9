"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

The term frequency is relative to the text's n-grams. The weights are learned by
follow-the-regularised-leader with elastic-net penalties on a bounded sample, on the driver; a
temperature is then fitted on the part of the sample that was held back. Every text is scored whole.

Null texts and texts without a letter are ``und`` with score 0. Without labelled rows all are. Of languages
with equal scores the first by name is predicted. Every row has its result, repeated ones the same; an
empty table gives none, further columns are ignored whatever their names. Very long texts are read whole,
each in a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm import ngrams
from evenkeel.llm.arrow import bounded_batches, slices, text_array, trim, trimmed

SIZES, BITS = range(1, 5), 18
#: Scale of the features; learning rate and its offset; L1 and L2; passes; share held back for the temperature.
SCALE, ALPHA, BETA, L1, L2, PASSES, HELD_BACK = 30.0, 0.3, 1.0, 0.002, 0.001, 2, 0.2


@dataclass
class Model:
    names: list[str]
    weights: np.ndarray  # (2 ** BITS, languages), the inverse document frequencies are part of it
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: the scores by language; whether it has a letter."""
        points, at = ngrams.code_points(texts)
        total, count = np.zeros((len(texts), len(self.names))), np.zeros(len(texts))
        for n, bucket in ngrams.hashes(points, SIZES, BITS):
            count += np.maximum(np.diff(at) - n + 1, 0)
            for k in range(len(self.names)):
                total[:, k] += ngrams.per_text(self.columns[k][bucket], at, n)
        return self.bias + SCALE * total / np.maximum(count, 1)[:, None], ngrams.has_letter(points, at)

    @property
    def columns(self) -> list[np.ndarray]:
        if not hasattr(self, "_columns"):
            self._columns = [np.ascontiguousarray(self.weights[:, k]) for k in range(len(self.names))]
        return self._columns

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        z, letter = self.logits(texts)
        p = softmax(z / self.temperature)
        best = p.argmax(1)
        return [self.names[k] if ok else "und" for k, ok in zip(best, letter)], np.where(letter, p[np.arange(len(p)), best], 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _features(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct buckets, their counts, and the number of n-grams."""
    points, _ = ngrams.code_points(text_array(pa.array([text])))
    every = np.concatenate([b for _, b in ngrams.hashes(points, SIZES, BITS)])
    bucket, count = np.unique(every, return_counts=True)
    return bucket, count, len(every)


def fit(rows: list[tuple[str, str]]) -> Model:
    names = sorted({lang for _, lang in rows})
    if not names:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    y = np.array([names.index(lang) for _, lang in rows])
    xs = [_features(t) for t, _ in rows]
    df = np.zeros(1 << BITS)
    for bucket, _, _ in xs:
        df[bucket] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    back = max(1, int(len(rows) * HELD_BACK)) if len(rows) >= 20 else 0
    z, n = np.zeros((1 << BITS, len(names))), np.zeros((1 << BITS, len(names)))
    zb, nb = np.zeros(len(names)), np.zeros(len(names))

    def weights(z, n, l1=L1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    order = np.random.default_rng(0)
    for _ in range(PASSES):
        for i in order.permutation(np.arange(back, len(rows))):
            bucket, count, total = xs[i]
            x = (SCALE * count / total * idf[bucket])[:, None]
            w, b = weights(z[bucket], n[bucket]), weights(zb, nb, 0.0)
            g = softmax((b + (w * x).sum(0))[None])[0]
            g[y[i]] -= 1
            for state, squares, at, old, grad in ((z, n, bucket, w, x * g), (zb, nb, slice(None), b, g)):
                s = squares[at]
                state[at] += grad - (np.sqrt(s + grad * grad) - np.sqrt(s)) / ALPHA * old
                squares[at] = s + grad * grad
    model = Model(names, (weights(z, n) * idf[:, None]).astype(np.float32), weights(zb, nb, 0.0))
    if back:
        logits = model.logits(text_array(pa.array([t for t, _ in rows[:back]])))[0]
        grid = np.geomspace(0.05, 20, 60)
        loss = [-np.log(softmax(logits / t)[np.arange(back), y[:back]] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred, score; one row per row, no shuffle."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for b in slices(batch):
                lang, score = m.predict(text_array(b.column("text")))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(lang, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(trimmed(run), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def learned(docs: DataFrame, learn: Column, lang_col: str = "lang", rows: int = 3000) -> Model:
    """A model of the languages in ``lang_col`` of a sample of the rows that ``learn`` names."""
    from evenkeel.llm.sample import labelled

    model = fit(labelled(docs, docs, lang_col, learn & (F.length("text") > 0), rows))
    trim()
    return model
