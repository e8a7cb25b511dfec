"""Quality classification: naive Bayes support vectors over n-gram indicators.

The n-grams are hashed words and word pairs, trigrams of character classes, and runs of repeated
words. Each indicator is scaled by its log-count ratio between the classes (in training rows), and
a linear hinge-loss model is fitted on the scaled indicators by dual coordinate descent. A logistic
curve fitted on rows left out of the descent turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, fold_latin, hash_sample, held_out, learnable, span_hashes, text_chunks, word_spans

WORD_BITS = 15
#: About so many labelled rows are learned from; a quarter of them fit the curve.
SAMPLE_ROWS = 8000
#: And about so many bytes of text.
SAMPLE_BYTES = 64 << 20
KEEP_SCORE = 0.7
PENALTY = 1.0

# character classes: letters by case, digits, space, line end, other scripts; each other ASCII mark is its own
_CLASS = np.zeros(256, np.uint32)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:0x100] = 1, 2, 3, 1
_CLASS[0x20], _CLASS[0x0A] = 4, 5
for _i, _c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CLASS[ord(_c)] = 6 + _i
_CLASSES = 6 + 33
_SHAPES = _CLASSES**3
FEATURES = 2 * (1 << WORD_BITS) + _SHAPES + 64


def indicators(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For runs of rows: first row, and the distinct n-gram places of each row."""
    for a, b, data, offsets in text_chunks(texts):
        kinds = _CLASS[data]
        starts, ends, first = word_spans(data, offsets)
        words = span_hashes(fold_latin(data), starts, ends)
        slot = (words >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        pair = np.zeros(len(words), np.int64)
        again = np.zeros(len(words), np.int64)
        if len(words) > 1:
            pair[1:] = ((words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
            again[1:] = words[1:] == words[:-1]
        runs = again.copy()
        for shift in range(1, 6):  # the last six words: which repeat the word before them
            runs[shift:] |= again[:-shift] << shift if shift < len(again) else 0
        shape = kinds[:-2] * (_CLASSES**2) + kinds[1:-1] * _CLASSES + kinds[2:] if len(kinds) > 2 else np.zeros(0, np.uint32)
        seen = np.zeros(_SHAPES, bool)
        out = []
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            x, y = offsets[i], max(offsets[i], offsets[i + 1] - 2)
            seen[:] = False
            seen[shape[x:y]] = True
            out.append(np.concatenate([np.unique(slot[lo:hi]), (1 << WORD_BITS) + np.unique(pair[lo + 1 : hi]), 2 * (1 << WORD_BITS) + np.flatnonzero(seen), 2 * (1 << WORD_BITS) + _SHAPES + np.unique(runs[lo + 6 : hi])]))
        yield a, out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    centre: float

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        margin = margins(self.weights, self.bias, rows)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.centre, -30, 30)))


def margins(weights: np.ndarray, bias: float, rows: list[np.ndarray]) -> np.ndarray:
    """Weighted sums of each row's indicators, over the root of their number."""
    return np.array([weights[r].sum() / np.sqrt(max(1, len(r))) for r in rows]) + bias


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 15, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model, one dual variable at a time.

    A row's vector is ``scale`` at its indicators over the root of their number, and a constant 1.
    """
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    values = [scale[r] / np.sqrt(max(1, len(r))) for r in rows]
    norm = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and centre of the logistic curve through (margin, label) by Newton steps with smoothed labels."""
    pos, neg = max(1, (y > 0).sum()), max(1, (y <= 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(1e-9, margin.std())
    x, a, b = margin / scale, 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - target) * x).sum() + 1e-3 * (a - 1), (p - target).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3) / scale, b


def fit_rows(rows: list[np.ndarray], labels: np.ndarray) -> Model | None:
    y = np.where(labels > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        return None if not len(y) else Model(np.zeros(FEATURES), 0.0, 1.0, 4.0 * y[0])
    part = np.arange(len(y)) % 4 == 3 if len(y) >= 40 else np.zeros(len(y), bool)
    if len(set(y[part].tolist())) < 2:
        part[:] = False
    counts = {s: np.ones(FEATURES) for s in (1, -1)}
    for r, s in zip(rows, y):
        counts[s][r] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())
    ratio[(counts[1] + counts[-1]) < 4 if len(y) > 200 else np.zeros(FEATURES, bool)] = 0
    train = [i for i in range(len(y)) if not part[i]]
    share = {s: max(1, sum(y[i] == s for i in train)) for s in (1, -1)}
    cost = np.array([PENALTY * len(train) / (2 * share[y[i]]) for i in train])
    w, bias = dual_descent([rows[i] for i in train], ratio, y[train], cost)
    weights = w * ratio
    on = np.flatnonzero(part) if part.any() else np.arange(len(y))
    slope, centre = logistic_curve(margins(weights, bias, [rows[i] for i in on]), y[on])
    return Model(weights, bias, slope, centre)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Learns from about ``sample_rows`` labelled rows that aren't held out; None if there are none."""
    known = learnable(labels.filter("quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("label")), 4, 2)
    chosen = hash_sample(known, "doc_id", sample_rows).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    rows = bounded_rows(rows, "doc_id", SAMPLE_BYTES).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    found = [r for _, part in indicators(rows["text"]) for r in part]
    return fit_rows(found, rows["label"].to_numpy())


def score_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, predicted for every whole text; a null or empty text has no n-grams and gets the bias' score.

    Without a model every score is 0.5. Repeated rows get equal scores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(len(batch), 0.5)
            if model:
                for a, rows in indicators(batch.column(1)):
                    score[a : a + len(rows)] = model.scores(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= KEEP_SCORE).astype(np.int32))], ["doc_id", "score", "predicted"])

    frame = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def quality_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Null and empty texts have no n-grams and share one score. Rows with a null doc_id are scored,
    never learned from, and not held out; repeated rows get equal scores. Repeated labels of one id
    count as the larger; null labels aren't learned from, and without labels every score is 0.5.
    Other columns of any name are ignored, and an empty table gives no rows.
    """
    return score_quality(docs, fit(docs, labels)).select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")
