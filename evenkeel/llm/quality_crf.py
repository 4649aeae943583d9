"""Quality: a linear-chain conditional random field labels every line of a text good or bad.

A line's features, each cut into bins, and those of the lines before and after it weigh for the label
good; a table of transitions joins the labels of neighbours. Forward-backward gives each line's
marginal; the length-weighted mean over the lines is the score of the document.

Documents carry one label, which stands for all their lines in training (on a bounded sample, on the
driver). Texts are scored whole. Lines of white space only are left out; a text that has no others
(null, empty) is one line of length 0, so it has a score too. Without rows of both labels the score is
the share of good ones (0 without any row).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm import shingles
from evenkeel.llm.arrow import bounded_batches, buffers, slices, text_array, trim, trimmed

BINS, PENALTY, STEPS, RATE = 8, 0.5, 120, 0.08
SLICE_BYTES = 2 << 20
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"|", b"!?", b"#$%&*@^~+=<>\\/_{}[]", b".", b",;:", bytes(range(128, 256))]


def lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines of all texts: a row of features, the length in bytes; and the n + 1 offsets of the texts' first lines."""
    data, at = buffers(texts)
    n = len(at) - 1
    cut = np.unique(np.concatenate([at, np.flatnonzero(data == 10) + 1]))
    cut = cut[cut <= len(data)]
    start, end = cut[:-1], cut[1:]
    words, _, word_start = _words(texts)
    in_line = np.concatenate([[0], np.cumsum(np.bincount(np.searchsorted(cut, word_start, side="right") - 1, minlength=len(start)))]) if len(start) else np.zeros(1, np.int64)
    full = np.diff(in_line) > 0
    start, end, first, last = start[full], end[full], in_line[:-1][full], in_line[1:][full]
    text = np.searchsorted(at, start, side="right") - 1
    size = np.maximum(end - start, 1).astype(float)
    n_words = (last - first).astype(float)
    columns = [np.log1p(size), n_words / size]
    for c in CLASSES:
        member = np.zeros(256, np.int32)
        member[list(c)] = 1
        total = np.concatenate([[0], np.cumsum(member[data], dtype=np.int64)])
        columns.append((total[end] - total[start]) / size)
    same = np.concatenate([[False], words[1:] == words[:-1]]) if len(words) else np.zeros(0, bool)
    run = np.concatenate([[0], np.cumsum(same)])
    columns.append((run[last] - run[first] - (same[first] if len(first) else 0)) / np.maximum(n_words, 1))
    of = np.repeat(np.arange(len(start), dtype=np.uint64), (last - first))
    own = np.concatenate([words[a:b] for a, b in [(first[0], last[-1])]]) if len(first) else words
    key = np.sort((of << np.uint64(40)) | (own >> np.uint64(24)))
    fresh = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    distinct = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=len(start))
    columns.append(distinct / np.maximum(n_words, 1))
    total = np.concatenate([[np.uint64(0)], np.cumsum(shingles.mixed(words), dtype=np.uint64)])
    whole = shingles.mixed(total[last] - total[first])
    key = (text.astype(np.uint64) << np.uint64(40)) | (whole >> np.uint64(24))
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    columns.append(np.log(times[back]) if len(key) else np.zeros(0))
    a_line = np.bincount(text, minlength=n)
    columns.append(np.log(a_line[text]))
    features = np.stack(columns, axis=1) if len(start) else np.zeros((0, len(columns)))
    # Texts without a line get one of length 0.
    none = np.flatnonzero(a_line == 0)
    order = np.argsort(np.concatenate([text, none]), kind="stable")
    features = np.concatenate([features, np.full((len(none), features.shape[1]), -1.0)])[order]
    length = np.concatenate([size if len(start) else np.zeros(0), np.zeros(len(none))])[order]
    return features, length, np.concatenate([[0], np.cumsum(np.maximum(a_line, 1))])


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, offsets of the texts' first words, and the words' places in the bytes."""
    hashes, at = shingles.word_hashes(texts)
    data, bounds = buffers(texts)
    if len(data) == 0:
        return hashes, at, np.zeros(0, np.int64)
    inside = ~shingles._byte_table()[1][data]
    cut = np.zeros(len(data), bool)
    cut[bounds[:-1][bounds[:-1] < len(data)]] = True
    return hashes, at, np.flatnonzero(inside & (cut | np.concatenate([[True], ~inside[:-1]])))


@dataclass
class Model:
    bounds: list[np.ndarray]  # of each feature, between its bins
    weights: np.ndarray  # of (before, own, after) x bins of all features
    ends: np.ndarray  # for having no line before, none after, and always
    moves: np.ndarray  # log weight of (label, next label)
    prior: float | None = None

    def codes(self, features: np.ndarray) -> np.ndarray:
        out, base = np.zeros(features.shape, np.int64), 0
        for k, b in enumerate(self.bounds):
            out[:, k] = base + np.searchsorted(b, features[:, k], side="right")
            base += len(b) + 1
        return out

    def unary(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        first, last = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
        first[at[:-1]], last[at[1:] - 1] = True, True
        before, own, after = (self.weights[k][codes].sum(1) for k in range(3))
        u = own + self.ends[2]
        u[1:] += np.where(first[1:], 0, before[:-1])
        u[:-1] += np.where(last[:-1], 0, after[1:])
        return u + self.ends[0] * first + self.ends[1] * last

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        features, length, at = lines(texts)
        good = marginals(self.unary(self.codes(features), at), at, self.moves)[0]
        weight = np.maximum(length, 1e-9)
        return np.clip(np.add.reduceat(good * weight, at[:-1]) / np.add.reduceat(weight, at[:-1]), 0, 1) if len(texts) else np.zeros(0)


def marginals(u: np.ndarray, at: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all texts at once: P(good) of each line, expected number of each move."""
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    start, n = at[:-1][order], n[order]
    m = np.exp(moves)
    e = np.stack([np.ones(len(u)), np.exp(np.clip(u, -30, 30))], axis=1)
    ahead, back = np.empty((len(u), 2)), np.ones((len(u), 2))
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(1, longest + 1), side="right")
    for t in range(longest):
        i = start[: active[t]] + t
        a = e[i] if t == 0 else (ahead[i - 1] @ m) * e[i]
        ahead[i] = a / a.sum(1, keepdims=True)
    expected = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        i = start[: active[t + 1]] + t
        out = e[i + 1] * back[i + 1]
        b = out @ m.T
        back[i] = b / b.sum(1, keepdims=True)
        pair = ahead[i][:, :, None] * m * out[:, None, :]
        expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
    p = ahead * back
    return p[:, 1] / p.sum(1), expected


def fit(rows: list[tuple[str, int]]) -> Model:
    y = np.array([int(label) for _, label in rows], float)
    if len(set(y)) < 2:
        return Model([], np.zeros((3, 0)), np.zeros(3), np.zeros((2, 2)), float(y.mean()) if len(y) else 0.0)
    made = [lines(text_array(pa.array([t for t, _ in rows[i : i + 500]]))) for i in range(0, len(rows), 500)]
    features = np.concatenate([x for x, _, _ in made])
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(a) for _, _, a in made]))])
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    bounds = [np.unique(np.concatenate([np.quantile(f, quantiles), [0.0, 1e-9, np.quantile(f, 0.98)]])) for f in features.T]
    size = sum(len(b) + 1 for b in bounds)
    model = Model(bounds, np.zeros((3, size)), np.zeros(3), np.zeros((2, 2)))
    codes = model.codes(features)
    label = np.repeat(y, np.diff(at))
    first, last = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
    first[at[:-1]], last[at[1:] - 1] = True, True
    steps = np.diff(at) - 1
    seen = np.array([[(steps * (1 - y)).sum(), 0], [0, (steps * y).sum()]])
    flat = np.zeros(3 * size + 3 + 4)
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, STEPS + 1):  # Adam
        model.weights, model.ends, model.moves = flat[: 3 * size].reshape(3, size), flat[3 * size : 3 * size + 3], flat[-4:].reshape(2, 2)
        good, expected = marginals(model.unary(codes, at), at, model.moves)
        r = good - label
        before, after = np.where(last, 0, np.append(r[1:], 0)), np.where(first, 0, np.append(0, r[:-1]))
        parts = [np.bincount(codes.ravel(), np.repeat(x, codes.shape[1]), size) for x in (before, r, after)]
        g = np.concatenate([*parts, [r[first].sum(), r[last].sum(), r.sum()], (expected - seen).ravel()]) + PENALTY * flat
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        flat = flat - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights, model.ends, model.moves = flat[: 3 * size].reshape(3, size), flat[3 * size : 3 * size + 3], flat[-4:].reshape(2, 2)
    return model


def learned(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", **options) -> Model:
    from evenkeel.llm.sample import labelled

    model = fit(labelled(docs, labels, label_col, learn, **options))
    trim()
    return model


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score; one row per row, no shuffle."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for b in slices(batch, most=SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(m.score(text_array(b.column("text"))))], ["id", "score"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(trimmed(run), f"id {kind}, score double").withColumnRenamed("id", id_col)
