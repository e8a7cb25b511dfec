"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

A word's embedding is the sum of hashed embeddings of the word and of its four- and five-byte
beginnings. Filters over one, two and three words are max-pooled over the whole text, rectified,
and combined by a logistic unit. Training is Adagrad over small batches; the gradient of max
pooling reaches only the winning positions. Languages are told apart by smoothed word counts over
the same hashed words (learned from ``lang`` of training rows, applied to text only); each gets the
probability threshold that separates its calibration rows best, and scores are shifted so that this
threshold is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, bounded_rows, fold_latin, hash_sample, held_out, learnable, span_hashes, text_chunks, word_spans

BITS = 15
WIDTH = 12
FILTERS = 12
SPANS = (1, 2, 3)
EPOCHS = 5
BATCH = 32
#: Fewer rows are gone over more often, for at least so many steps.
LEAST_STEPS = 700
#: About so many rows of each label are learned from; a fifth of them calibrate.
SAMPLE_ROWS = {1: 2400, 0: 3000}
#: And about so many bytes of text.
SAMPLE_BYTES = 64 << 20

_PAD = 3 << BITS  # an embedding that stays zero


def word_slots(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, three embedding places of each word, and the place of each row's first word."""
    for a, _, data, offsets in text_chunks(texts):
        data = fold_latin(data)
        starts, ends, first = word_spans(data, offsets, NOT_ALNUM)
        cut = np.uint64(64 - BITS)
        slots = np.empty((len(starts), 3), np.int32)
        for k, hashes in enumerate((span_hashes(data, starts, ends), *(span_hashes(data, starts, np.minimum(starts + n, ends)) for n in (4, 5)))):
            slots[:, k] = (hashes >> cut).astype(np.int32) + (k << BITS)
        yield a, slots, first


def padded(slots: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of a run with two blank words after each row, so that no filter spans rows; and each row's start."""
    sizes = np.diff(first)
    begin = first[:-1] + 2 * np.arange(len(sizes))
    out = np.full((len(slots) + 2 * len(sizes) + 2, 3), _PAD, np.int32)
    to = np.arange(len(slots)) + 2 * np.repeat(np.arange(len(sizes)), sizes)
    out[to] = slots
    return out, begin


@dataclass
class Model:
    embed: np.ndarray
    filters: list[np.ndarray]  # per span: (span, WIDTH, FILTERS)
    bias: np.ndarray
    top: np.ndarray
    base: float
    languages: list[str] = field(default_factory=list)
    words: np.ndarray | None = None  # log probability of each whole-word place by language
    shift: np.ndarray | None = None  # what moves each language's threshold to 0.5, on the logit

    def pooled(self, slots: np.ndarray, begin: np.ndarray, keep: bool = False):
        """Max-pooled filters of each row; with ``keep`` also all filter values."""
        x = self.embed[slots[:, 0]]
        x += self.embed[slots[:, 1]]
        x += self.embed[slots[:, 2]]
        n, across = len(x) - 2, np.ascontiguousarray(x.T)
        values = np.empty((len(SPANS) * FILTERS, n), np.float32)
        for k, f in enumerate(self.filters):
            part = values[k * FILTERS : (k + 1) * FILTERS]
            np.matmul(f[0].T, across[:, :n], out=part)
            for j in range(1, len(f)):
                part += f[j].T @ across[:, j : n + j]
        top = np.maximum.reduceat(values, begin, axis=1).T
        return (top, values, x) if keep else top

    def logits(self, slots: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(slots, begin) + self.bias, 0) @ self.top + self.base

    def language(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The likeliest language of each row by its whole words; the first where it has none."""
        sums = np.vstack([np.zeros(len(self.languages)), np.cumsum(self.words[slots[:, 0]], axis=0, dtype=float)])
        return (sums[first[1:]] - sums[first[:-1]]).argmax(axis=1)

    def scores(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        out, begin = padded(slots, first)
        z = self.logits(out, begin)
        if self.shift is not None:
            z = z + self.shift[self.language(slots, first)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def leaning(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """For each embedding place, by how many deviations toxic texts with it exceed their share, from -2 to 6."""
    count = np.zeros((2, _PAD + 1))
    for r, y in zip(rows, labels):
        count[int(y > 0), np.unique(r)] += 1
    expected = count.sum(axis=0) * (labels > 0).mean()
    return np.clip((count[1] - expected) / np.sqrt(expected + 1), -2, 6)


def train(rows: list[np.ndarray], labels: np.ndarray, seed: int = 3, epochs: int = EPOCHS) -> Model:
    """Fits the network; rows are arrays of word places."""
    rng = np.random.default_rng(seed)
    model = Model(
        embed=rng.normal(0, 0.15, (_PAD + 1, WIDTH)).astype(np.float32),
        filters=[rng.normal(0, 0.4 / np.sqrt(s), (s, WIDTH, FILTERS)).astype(np.float32) for s in SPANS],
        bias=np.zeros(len(SPANS) * FILTERS, np.float32),
        top=rng.normal(0, 0.3, len(SPANS) * FILTERS).astype(np.float32),
        base=0.0,
    )
    model.embed[:, 0] = 0.3 * leaning(rows, labels)  # one dimension starts from what training texts say of a word
    model.filters[0][0, :, 0], model.filters[0][0, 0, 0], model.top[0] = 0, 1, 1
    model.embed[_PAD] = 0
    seen = {"embed": np.full(model.embed.shape, 1e-2, np.float32), "bias": np.full(model.bias.shape, 1e-2), "top": np.full(model.top.shape, 1e-2), "base": 1e-2}
    seen_f = [np.full(f.shape, 1e-2) for f in model.filters]
    weight = np.where(labels > 0, len(labels) / (2 * max(1, (labels > 0).sum())), len(labels) / (2 * max(1, (labels <= 0).sum())))
    epochs = max(epochs, -(-LEAST_STEPS * BATCH // max(1, len(rows))))
    for epoch in range(epochs):
        rate = 0.12 / (1 + EPOCHS * epoch / epochs)
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            first = np.zeros(len(pick) + 1, np.int64)
            np.cumsum([len(rows[i]) for i in pick], out=first[1:])
            slots, begin = padded(np.vstack([rows[i] for i in pick]), first)
            top, values, x = model.pooled(slots, begin, keep=True)
            act = np.maximum(top + model.bias, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ model.top + model.base, -30, 30)))
            g = (p - labels[pick]) * weight[pick] / len(pick)
            d_top = act.T @ g + 1e-4 * model.top
            d_pool = np.where(act > 0, g[:, None] * model.top, 0).astype(np.float32)
            stops = np.append(begin[1:], values.shape[1])
            where = np.array([values[:, a:b].argmax(axis=1) + a for a, b in zip(begin, stops)])
            touched, pulls = [], []
            for k, f in enumerate(model.filters):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                d, w = d_pool[:, cols], where[:, cols]
                grad = np.empty(f.shape)
                for j in range(len(f)):
                    grad[j] = np.einsum("bf,bfe->ef", d, x[w + j]) + 1e-5 * f[j]
                    touched.append((w + j).ravel())
                    pulls.append((d[:, :, None] * f[j].T[None]).reshape(-1, WIDTH))
                seen_f[k] += grad * grad
                f -= (rate * grad / np.sqrt(seen_f[k])).astype(np.float32)
            touched, pulls = np.concatenate(touched), np.vstack(pulls)
            live = np.flatnonzero(np.abs(pulls).sum(axis=1) > 0)
            if len(live):
                to, inverse = np.unique(slots[touched[live]].ravel(), return_inverse=True)
                grad = np.zeros((len(to), WIDTH), np.float32)
                np.add.at(grad, inverse.ravel(), np.repeat(pulls[live], 3, axis=0))
                seen["embed"][to] += grad * grad
                model.embed[to] -= rate * grad / np.sqrt(seen["embed"][to])
                model.embed[_PAD] = 0
            for name, grad in (("bias", d_pool.sum(axis=0)), ("top", d_top), ("base", float(g.sum()))):
                seen[name] = seen[name] + grad * grad
                setattr(model, name, getattr(model, name) - rate * grad / np.sqrt(seen[name]))
    model.bias, model.top, model.base = model.bias.astype(np.float32), model.top.astype(np.float32), float(model.base)
    return model


def best_threshold(logit: np.ndarray, labels: np.ndarray) -> float:
    """The logit that separates the labels with the fewest weighted errors, in the middle of its gap."""
    order = np.argsort(logit)
    z, y = logit[order], labels[order] > 0
    share = {True: max(1, y.sum()), False: max(1, (~y).sum())}
    # errors if everything from place i on counts as toxic
    missed = np.concatenate([[0], np.cumsum(y)]) / share[True]
    false = np.concatenate([[(~y).sum()], (~y).sum() - np.cumsum(~y)]) / share[False]
    error = missed + 3 * false  # toxic texts are the rarer ones: a false alarm rate counts more than a miss rate
    i = np.flatnonzero(error == error.min())
    i = int(i[len(i) // 2])
    lo = z[i - 1] if i else z[0] - 1
    hi = z[i] if i < len(z) else z[-1] + 1
    return float((lo + hi) / 2)


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, languages: list[str | None]) -> Model | None:
    """Trains on four of five rows and calibrates by language on the rest."""
    if len(set(labels.tolist())) < 2:
        return None
    part = np.arange(len(rows)) % 5 == 4
    if len(rows) < 200 or len(set(labels[part].tolist())) < 2:
        part[:] = False
    use = np.flatnonzero(~part)
    model = train([rows[i] for i in use], labels[use])
    model.languages = sorted({x for x in languages if x}) or [""]
    counts = np.full((1 << BITS, len(model.languages)), 0.1)
    for r, x in zip(rows, languages):
        if x:
            np.add.at(counts[:, model.languages.index(x)], r[:, 0], 1)
    model.words = (np.log(counts) - np.log(counts.sum(axis=0))).astype(np.float32)
    on = np.flatnonzero(part) if part.any() else np.arange(len(rows))
    first = np.zeros(len(on) + 1, np.int64)
    np.cumsum([len(rows[i]) for i in on], out=first[1:])
    flat = np.vstack([rows[i] for i in on])
    slots, begin = padded(flat, first)
    z, of = model.logits(slots, begin), model.language(flat, first)
    common = best_threshold(z, labels[on])
    shift = []
    for k in range(len(model.languages)):
        mine = of == k
        some = mine.sum() and min((labels[on][mine] > 0).sum(), (labels[on][mine] <= 0).sum())
        own = best_threshold(z[mine], labels[on][mine]) if some else common
        shift.append(-(own * some + common * 10) / (some + 10))  # a language with few rows leans on all
    model.shift = np.array(shift)
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Learns from about SAMPLE_ROWS labelled rows of each class that aren't held out; None without both classes."""
    known = learnable(labels.filter("toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("label")), 5, 0)
    parts = [hash_sample(known.filter(F.col("label") == v), "doc_id", n) for v, n in SAMPLE_ROWS.items()]
    chosen = parts[0].union(parts[1]).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).join(F.broadcast(chosen), "doc_id")
    rows = bounded_rows(rows.select("doc_id", "text", "label", "lang", F.xxhash64("doc_id").alias("h")), "doc_id", SAMPLE_BYTES).toArrow().sort_by([("h", "ascending"), ("text", "ascending")])
    found = []
    for _, slots, first in word_slots(rows["text"]):
        found += [slots[a:b] for a, b in zip(first, first[1:])]
    return fit_rows(found, rows["label"].to_numpy(), rows["lang"].to_pylist())


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, predicted for every whole text; a null, empty or wordless text has blank words only.

    Without a model every score is 0. Repeated rows get equal scores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(len(batch))
            if model:
                for a, slots, first in word_slots(batch.column(1)):
                    score[a : a + len(first) - 1] = model.scores(slots, first)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    frame = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def toxicity_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; ``lang`` is read of training rows only.

    Null, empty and wordless texts get the score of a text of blank words, the same for all of them.
    Rows with a null doc_id are scored, never learned from, and not held out; repeated rows get
    equal scores. Repeated labels of one id count as the larger; null labels aren't learned from, and
    without labels of both classes every score is 0. Other columns of any name are ignored, and an
    empty table gives no rows.
    """
    return score_toxicity(docs, fit(docs, labels)).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")
