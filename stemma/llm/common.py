"""What the training-data operators share: reading tables, checkpoints, and vectorised text codes.

The numpy half works on the raw buffers of an Arrow string column, a bounded run of rows at a
time, so that a worker's memory depends on ``CHUNK_BYTES`` and the longest text, not on the batch.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); one of our own where it is unset in local mode.

    On a cluster a folder of the driver's machine is of no use to executors, so there an unset folder is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stemma-checkpoint-"))
            current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get()
    elif spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """The frame, marked for broadcast if a count proves that it has no more than ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def without(names, *results: str) -> tuple[str, ...]:
    """The column names that aren't, in any case, the name of a result."""
    taken = {r.lower() for r in results}
    return tuple(k for k in names if k.lower() not in taken)


def fresh(name: str, names) -> str:
    """``name`` with as many underscores as make it differ, in any case, from all ``names``."""
    taken = {k.lower() for k in names}
    while name.lower() in taken:
        name += "_"
    return name


def as_row(docs: DataFrame, name: str = "row"):
    """All columns of ``docs`` as one struct column, out of the way of other names."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(name)


def ascii_lower(col):
    """Lower-case A-Z only (``lower`` would also fold other scripts)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(col, upper, upper.lower())


def hash_sample(df: DataFrame, key: str, rows: int, seed: int = 7) -> DataFrame:
    """About ``rows`` rows chosen by a hash of ``key``: the same rows however the table is laid out.

    One count over the key column sets the share; a table of no more than ``rows`` rows is kept whole.
    """
    n = df.select(key).count()
    if n <= rows:
        return df
    share = int(1_000_000 * rows / n)
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < share)


def bounded_rows(rows: DataFrame, key: str, most_bytes: int) -> DataFrame:
    """A sample's rows with a column text, kept by a hash of ``key`` so that the texts together have about ``most_bytes``.

    The sample is written once, so that its documents are read in one pass.
    """
    rows = checkpoint(rows)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= most_bytes:
        return rows
    share = int(1_000_000 * most_bytes / total)
    return rows.filter(F.pmod(F.xxhash64(F.col(key), F.lit(13)), F.lit(1_000_000)) < share)


# ---------------------------------------------------------------- numpy text codes


def _splitmix(i: int) -> int:
    x = (i * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODE = np.array([_splitmix(i + 1) for i in range(256)], dtype=np.uint64)
_BASE = _splitmix(1001) | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the hash base and of its inverse modulo 2^64."""
    if len(_POWERS[0]) <= n:
        size = 1 << max(n, 1 << 16).bit_length()
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


#: Bytes that stand between words: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def text_chunks(texts: pa.Array, chunk_bytes: int = CHUNK_BYTES, rows: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of at most ``rows`` rows as (first row, row after the last, bytes, offsets); a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, where, raw = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk_bytes, "right")) - 1)
        end = min(end, n, at + (rows or n))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def text_runs(texts: pa.Array, chars: int) -> Iterator[list[str]]:
    """The texts in runs of about ``chars`` characters, or one longer text; a null counts as an empty text."""
    run, size = [], 0
    for x in texts:
        t = x.as_py() or ""
        if run and size + len(t) > chars:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in a run of texts, and for each text the place of its first word (plus the total)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from one running sum over the whole run."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(BYTE_CODE[data] * power[: len(data)], dtype=np.uint64, out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


SHINGLE = 5
_PLACE = [np.uint64(_splitmix(2000 + i) | 1) for i in range(SHINGLE)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text its set of 5-word shingles as sorted distinct 64-bit hashes; A-Z count as a-z.

    A text of one to four words has one shingle, its whole sequence; a text without words has none.
    """
    data = ASCII_LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    n = len(words)
    if n >= SHINGLE:
        runs = words[: n - SHINGLE + 1] * _PLACE[0]
        for i in range(1, SHINGLE):
            runs += words[i : n - SHINGLE + 1 + i] * _PLACE[i]
        runs = mix64(runs)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            s = np.sort(runs[a : b - SHINGLE + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for i in range(b - a):
                whole = whole + words[a + i : a + i + 1] * _PLACE[i]
            out.append(mix64(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


#: Separators of letter-and-digit words: every ASCII byte but letters and digits.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def fold_latin(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters of UTF-8 bytes."""
    out = ASCII_LOWER[data]
    if len(out) > 1:
        high = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E)
        out[1:][high] += 0x20
    return out


def has_letter(col):
    """Whether a text has a letter of any script; false for null."""
    return F.coalesce(col.rlike(r"\p{L}"), F.lit(False))


def learnable(docs: DataFrame, modulus: int, held: int) -> DataFrame:
    """The rows that a classifier may learn from: crc32(doc_id as text) modulo ``modulus`` isn't ``held``."""
    return docs.filter((F.crc32(F.col("doc_id").cast("string")) % modulus) != held)


def held_out(modulus: int, held: int):
    """Whether a row is held out; false where doc_id is null (such rows are learned from by nobody)."""
    return F.coalesce((F.crc32(F.col("doc_id").cast("string")) % modulus) == held, F.lit(False))
