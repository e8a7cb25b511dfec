"""Language identification by the nearest of several clustered TF-IDF centroids per language.

A text's vector holds log(1 + count) x idf of hashed byte trigrams of its letters (lower case,
everything else a space), normalised. Each language has up to CENTROIDS centroids from spherical
k-means. The language of the closest centroid by cosine wins; a text whose cosine is far below
what passages of its length reach in training is rejected. What they reach is measured on passages
of every length, cut out of the training texts, so that short texts are held to a limit as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NOT_ALNUM, bounded_rows, fold_latin, fresh, has_letter, hash_sample, held_out, learnable, text_chunks, without

BUCKETS = 1 << 13
#: Rows whose vectors a worker holds at a time, however short their texts are.
ROWS_TOGETHER = 256
CENTROIDS = 4
#: About so many rows are learned from, over all languages.
SAMPLE_ROWS = 2500
SAMPLE_BYTES = 64 << 20
#: A text is rejected under this share of the cosine that all but a twentieth of training passages of its length reach.
REJECT_SHARE = 0.36
#: Passages of each length, in powers of two, that set the limits; fewer than LEAST_PASSAGES set none of their own.
PASSAGES, LEAST_PASSAGES, LENGTHS = 400, 20, 15

_BLANK = NOT_ALNUM.copy()
_BLANK[0x30:0x3A] = True


def vectors(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, log counts of hashed trigrams, and the number of trigrams of each row."""
    for a, b, data, offsets in text_chunks(texts, rows=ROWS_TOGETHER):
        clean = fold_latin(data)
        clean[_BLANK[clean]] = 0x20
        counts = np.zeros((b - a, BUCKETS), np.float32)
        sizes = np.zeros(b - a, np.int64)
        if len(clean) >= 3:
            wide = clean.astype(np.uint32)
            code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
            slot = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
            letters = clean != 0x20
            good = letters[1:-1] | (letters[:-2] & letters[2:])
            for i in range(b - a):
                lo, hi = offsets[i], offsets[i + 1] - 2
                if hi > lo:
                    mine = slot[lo:hi][good[lo:hi]]
                    sizes[i] = len(mine)
                    counts[i] = np.bincount(mine, minlength=BUCKETS)
        np.log1p(counts, out=counts)
        yield a, counts, sizes


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray  # the language of each centroid
    centroids: np.ndarray  # already times idf
    idf: np.ndarray
    floor: np.ndarray  # least cosine by the binary logarithm of the number of trigrams

    def limit(self, sizes: np.ndarray) -> np.ndarray:
        """The least cosine of texts with so many trigrams."""
        return np.interp(np.log2(np.maximum(sizes, 1)), np.arange(len(self.floor)), self.floor)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language index and cosine of each vector; ties go to the first language."""
        weights = (self.centroids * self.idf).T
        owner, most = np.zeros(len(counts), int), np.zeros(len(counts))
        for a in range(0, len(counts), 256):
            part = counts[a : a + 256]
            size = np.linalg.norm(part * self.idf, axis=1)
            cosine = part @ weights / np.maximum(size, 1e-12)[:, None]
            best = cosine.argmax(axis=1)
            owner[a : a + 256], most[a : a + 256] = self.owner[best], cosine[np.arange(len(best)), best]
        return owner, most


def fit_vectors(counts: np.ndarray, sizes: np.ndarray, languages: list[str]) -> Model | None:
    names = sorted({x for x, n in zip(languages, sizes) if n})
    if not names:
        return None
    present = (counts > 0).sum(axis=0)
    idf = (np.log((1 + len(counts)) / (1 + present)) + 1).astype(np.float32)
    of = np.array(languages, object)
    owner, centroids = [], []
    for k, name in enumerate(names):
        mine = counts[(of == name) & (sizes > 0)]  # one language's vectors at a time
        mine *= idf
        mine /= np.maximum(np.linalg.norm(mine, axis=1, keepdims=True), 1e-12)
        # farthest-first seeds, then spherical k-means
        seeds = [_unit(mine.mean(axis=0, keepdims=True))[0]]
        while len(seeds) < min(CENTROIDS, len(mine)):
            seeds.append(mine[int(np.argmin((mine @ np.array(seeds).T).max(axis=1)))])
        seeds = np.array(seeds, np.float32)
        for _ in range(8):
            to = (mine @ seeds.T).argmax(axis=1)
            for j in range(len(seeds)):
                if (to == j).any():
                    seeds[j] = mine[to == j].mean(axis=0)
            seeds = _unit(seeds)
        owner += [k] * len(seeds)
        centroids.append(seeds)
        del mine
    return Model(names, np.array(owner), np.vstack(centroids).astype(np.float32), idf, np.zeros(LENGTHS))


def fit_limits(model: Model, texts: list[str], seed: int = 11) -> None:
    """Sets the least cosine for every length from passages of that length, cut out of ``texts`` at random.

    A length for which the texts give too few passages takes the limit of the length below it.
    """
    rng = np.random.default_rng(seed)
    least = 0.0
    for k in range(LENGTHS):
        long_enough = [t for t in texts if len(t) >= (1 << k) + 2]
        if len(long_enough) >= LEAST_PASSAGES:
            passages = []
            for i in rng.integers(len(long_enough), size=PASSAGES):
                at = int(rng.integers(len(long_enough[i]) - (1 << k) - 1))
                passages.append(long_enough[i][at : at + (1 << k) + 2])
            cosine = np.concatenate([model.nearest(counts)[1][sizes > 0] for _, counts, sizes in vectors(pa.array(passages, pa.string()))])
            least = max(least, float(np.quantile(cosine, 0.05)) * REJECT_SHARE) if len(cosine) >= LEAST_PASSAGES else least
        model.floor[k] = least


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Learns from about ``sample_rows`` rows with text and lang that aren't held out, of SAMPLE_BYTES together at most; None if there are none."""
    known = learnable(docs, 3, 1).filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sample = bounded_rows(hash_sample(known, "doc_id", sample_rows), "doc_id", SAMPLE_BYTES)
    rows = sample.select(F.xxhash64("doc_id").alias("h"), "text", "lang").toArrow().sort_by([("h", "ascending"), ("text", "ascending")])
    counts, sizes = np.zeros((len(rows), BUCKETS), np.float32), np.zeros(len(rows), np.int64)
    for a, part, size in vectors(rows["text"]):
        counts[a : a + len(part)], sizes[a : a + len(part)] = part, size
    model = fit_vectors(counts, sizes, rows["lang"].to_pylist())
    del counts
    if model:
        fit_limits(model, [x for x, n in zip(rows["text"].to_pylist(), sizes) if n])
    return model


def identify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, lang_pred, score (cosine, 0 to 1) and rejected of every whole text.

    A null text or one without a letter is ``und``, score 0, rejected. Others get a learned
    language, and are rejected if they lie too far from all centroids. Without a model everything is
    ``und``, and only what has no letter is rejected. Ties go to the alphabetically first language.
    Repeated rows give repeated results, and an empty table none. A column of ``keep`` that is named
    like a result gives way to it; to carry columns of any name, pack them into one struct. A string
    ``text`` among ``keep`` goes to Python once.
    """
    names = model.languages if model else []
    keep = without(keep, "lang_pred", "score", "rejected")
    kept = "text" in keep and docs.schema["text"].dataType == T.StringType()
    at = keep.index("text") if kept else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lettered = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            n = len(batch)
            best, cosine, sizes = np.zeros(n, int), np.zeros(n), np.zeros(n, np.int64)
            if model:
                for a, counts, size in vectors(batch.column(at)):
                    b = a + len(counts)
                    best[a:b], cosine[a:b] = model.nearest(counts)
                    sizes[a:b] = size
            score = np.where(lettered, np.clip(cosine, 0, 1), 0.0)
            far = score < model.limit(sizes) if model else np.zeros(n, bool)
            lang = [names[k] if ok and names else "und" for k, ok in zip(best, lettered)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(lang, pa.string()), pa.array(score.astype(float)), pa.array(far | ~lettered)], [*keep, "lang_pred", "score", "rejected"])

    text = F.col("text").cast("string")
    frame = docs.select(*(F.col(f"`{k}`") for k in keep), *([] if kept else [text.alias(fresh("_text", keep))]), has_letter(text).alias(fresh("_lettered", keep)))
    results = T.StructType().add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return frame.mapInArrow(run, T.StructType([*frame.schema.fields[: len(keep)], *results.fields]))


def language_of(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every document; learned from rows that aren't held out.

    ``lang``, ``source`` and ``doc_id`` are never inputs of a prediction. Rows with a null doc_id are
    never learned from and count as not held out; other columns of any name are ignored. A null,
    empty or letterless text is ``und`` with score 0; an empty table gives no rows.
    """
    return identify(docs, fit(docs)).select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score", "rejected")
