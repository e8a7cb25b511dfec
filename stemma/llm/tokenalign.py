"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

The ends of both token sequences cut a text into elementary intervals; each lies in one token of
either side, so it is one overlap (``searchsorted`` finds the two owners), and an end that both sides
share closes a group. Neither tokenizer joins a visible character and a space after it, so a text
falls into words that a worker tokenizes, aligns and remembers; what is wanted of a text is a sum over
its words. Texts are read once: their distinct linked id pairs are written packed beside the results,
counted over all documents from there, and looked up in the counts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, fresh, text_runs, without

#: Words, and their characters, that a worker remembers before it forgets rare ones; characters of text that are read at a time.
MEMO, MEMO_CHARS, RUN_CHARS = 400_000, 8_000_000, 2_000_000
#: Pairs of ids that are sent to all workers; beyond it pairs are joined by a shuffle.
SENT_PAIRS = 4_000_000
#: Pairs that a task counts before it passes them on, and parts of a pair that many documents hold in the shuffled join.
HELD_PAIRS, SALTS = 4_000_000, 32
PAD = "\u2581"
#: Blanks of any kind: no tokenizer's rule for them is relied on, so words are cut only behind something else.
_BLANKS = "[\\s\\u180e\\u200b]"
_UNSAFE, _ENDS_BLANK = re.compile(f"{_BLANKS} |^ "), re.compile(f"{_BLANKS}\\Z")


def byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, the others from U+0100 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level tokenizer from its JSON file; the bytes of each id."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.of.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", ())}
        code, vocab = byte_of(), self.of.get_vocab(with_added_tokens=True)
        self.tokens = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.tokens[i] = special.get(i) or bytes(code[c] for c in token)

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word with a space before it."""
        return [e.ids for e in self.of.encode_batch_fast([f" {w}" for w in words], add_special_tokens=False)]


class Pieces:
    """A sentencepiece model that adds a space before a text; the bytes of each id."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.of = SentencePieceProcessor(model_file=path)
        size = self.of.get_piece_size()
        names = [self.of.id_to_piece(i) for i in range(size)]
        self.tokens = [bytes([int(n[3:5], 16)]) if self.of.is_byte(i) else n.replace(PAD, " ").encode() for i, n in enumerate(names)]
        self.space = self.of.piece_to_id(PAD)

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word with a space before it; a space alone is one piece."""
        return [ids if w else [self.space] for w, ids in zip(words, self.of.encode(words, num_threads=1))]


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each elementary interval of two ascending sequences of token ends: its end, its owner on either side, and whether the end is shared."""
    cuts = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    return cuts, a, b, (ends_a[a] == cuts) & (ends_b[b] == cuts)


class Aligner:
    """Texts as sequences of remembered words.

    For word w (a column of ``counts``): tokens of A and of B, groups, links, and whether the bytes
    of both sides are not those of the word; ``pairs`` holds the links' id pairs, word after word.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.width = len(self.b.tokens)
        self.size_a, self.size_b = (np.array([len(t) for t in side.tokens], np.int64) for side in (self.a, self.b))
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.counts = np.zeros((5, 0), np.int64)
        self.pairs, self.at = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.seen = np.zeros(0, np.int64)

    def thin(self) -> None:
        """Keeps the words that were met again since they came or were last kept, half of the memo at most."""
        keep = np.flatnonzero(self.seen > 1)
        if len(keep) > MEMO // 2:
            keep = np.sort(keep[np.argsort(-self.seen[keep], kind="stable")[: MEMO // 2]])
        names = list(self.memo)
        self.memo = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.chars = sum(map(len, self.memo))
        if self.chars > MEMO_CHARS // 2:
            return self.forget()
        self.groups = [self.groups[i] for i in keep.tolist()]
        n = self.at[keep + 1] - self.at[keep]
        self.pairs = self.pairs[_ranges(self.at[keep], n)]
        self.at = np.concatenate([[0], np.cumsum(n)])
        self.counts, self.seen = self.counts[:, keep], np.ones(len(keep), np.int64)

    @staticmethod
    def words(text: str) -> list[str]:
        """The words whose concatenation, each with a space before it, is a space and the text."""
        parts = text.split(" ")
        if not _UNSAFE.search(text):
            return parts
        out = parts[:1]
        for part in parts[1:]:
            if out[-1] and not _ENDS_BLANK.search(out[-1]):
                out.append(part)
            else:
                out[-1] = f"{out[-1]} {part}"
        return out

    def learn(self, words: list[str]) -> None:
        """Tokenizes and aligns new words, all in one."""
        found_a, found_b = self.a.encode(words), self.b.encode(words)
        raw = [f" {w}".encode() for w in words]
        fits = [b"".join(map(self.a.tokens.__getitem__, x)) == r == b"".join(map(self.b.tokens.__getitem__, y)) for r, x, y in zip(raw, found_a, found_b)]
        found_a, found_b = ([x if f else [] for x, f in zip(found, fits)] for found in (found_a, found_b))
        n = len(words)
        counts = np.zeros((5, n), np.int64)
        counts[0], counts[1], counts[4] = [len(x) for x in found_a], [len(x) for x in found_b], [not f for f in fits]
        ids_a, ids_b = (np.fromiter((i for x in found for i in x), np.int64, int(total)) for found, total in ((found_a, counts[0].sum()), (found_b, counts[1].sum())))
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        cuts, a, b, shared = overlaps(ends_a, ends_b)
        codes = ids_a[a] * self.width + ids_b[b]
        # a word's last interval ends where its bytes end
        until = np.cumsum([len(r) if f else 0 for r, f in zip(raw, fits)])
        link_end = np.searchsorted(cuts, until, "right")
        group_end = np.concatenate([[0], np.cumsum(shared)])[link_end]
        counts[3], counts[2] = np.diff(link_end, prepend=0), np.diff(group_end, prepend=0)
        self.groups += self._groups(ids_a, ids_b, a[shared] + 1, b[shared] + 1, group_end)
        for w in words:
            self.memo[w] = len(self.memo)
            self.chars += len(w)
        self.counts = np.concatenate([self.counts, counts], axis=1)
        self.pairs = np.concatenate([self.pairs, codes])
        self.at = np.concatenate([self.at, self.at[-1] + link_end])
        self.seen = np.concatenate([self.seen, np.zeros(n, np.int64)])

    @staticmethod
    def _groups(ids_a: np.ndarray, ids_b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray, group_end: np.ndarray) -> list[str]:
        """The groups of each word as text."""
        name_a, name_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        told, i, j = [], 0, 0
        for x, y in zip(to_a.tolist(), to_b.tolist()):
            told.append(f"{name_a[i] if x == i + 1 else ','.join(name_a[i:x])}|{name_b[j] if y == j + 1 else ','.join(name_b[j:y])}")
            i, j = x, y
        ends = group_end.tolist()
        return [";".join(told[s:e]) for s, e in zip([0, *ends[:-1]], ends)]

    def read(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """For each text its words' numbers; and whether it has tokens."""
        words = [self.words(t) if t else [] for t in texts]
        new = {w for x in words for w in x} - self.memo.keys()
        if len(self.memo) + len(new) > MEMO or self.chars > MEMO_CHARS:
            self.thin()
            new = {w for x in words for w in x} - self.memo.keys()
        if new:
            self.learn(sorted(new))
        numbers = [np.fromiter(map(self.memo.__getitem__, x), np.int64, len(x)) for x in words]
        self.seen += np.bincount(np.concatenate([np.zeros(0, np.int64), *numbers]), minlength=len(self.seen))
        has = np.array([bool(t) and not self.counts[4, k].any() for t, k in zip(texts, numbers)], bool)
        return numbers, has


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (n of them) for each start, one after the other."""
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of a worker."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _links(aligner: Aligner, numbers: list[np.ndarray], has: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, id pair) of a run of texts, and how often each pair is linked in its text."""
    span = len(aligner.a.tokens) * aligner.width
    word, times, doc = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, (k, h) in enumerate(zip(numbers, has.tolist())):
        if h:
            w, c = np.unique(k, return_counts=True)
            word.append(w)
            times.append(c)
            doc.append(np.full(len(w), i))
    word, times, doc = np.concatenate(word), np.concatenate(times), np.concatenate(doc)
    n = aligner.at[word + 1] - aligner.at[word]
    keys = np.repeat(doc, n) * span + aligner.pairs[_ranges(aligner.at[word], n)]
    order = np.argsort(keys, kind="stable")
    keys, weight = keys[order], np.repeat(times, n)[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first] // span, keys[first] % span, np.add.reduceat(weight, first) if len(keys) else first


def _sum_by(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(n, first) if len(codes) else n


def _packed(values: np.ndarray) -> bytes:
    """Numbers from 0 in the narrowest type, compressed; the first byte names the type."""
    narrow = values.astype(np.min_scalar_type(int(values.max(initial=0))))
    return narrow.dtype.char.encode() + zlib.compress(narrow.tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed[1:]), packed[:1].decode()).astype(np.int64)


def unpack_links(codes: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A document's distinct linked id pairs, ascending, and how often each is linked."""
    return np.cumsum(_unpacked(codes)), _unpacked(times)


def link_counts(links: DataFrame, width: int) -> DataFrame:
    """code, docs, best from packed links (codes, times): how many documents hold each linked id pair, and whether that is the most of its A id (ties included)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, waiting, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        out = lambda c, m: pa.RecordBatch.from_arrays([pa.array(c), pa.array(m)], ["code", "docs"])
        for batch in batches:
            found = [np.cumsum(_unpacked(x.as_py())) for x in batch.column(0)]
            new, times = np.unique(np.concatenate([codes[:0], *found]), return_counts=True)
            waiting.append((new, times))
            held += len(new)
            if held > 2 * len(codes) + 500_000:
                codes, n = _sum_by(np.concatenate([codes, *(c for c, _ in waiting)]), np.concatenate([n, *(m for _, m in waiting)]))
                waiting, held = [], 0
            if len(codes) > HELD_PAIRS:
                yield out(codes, n)
                codes, n = codes[:0], n[:0]
        yield out(*_sum_by(np.concatenate([codes, *(c for c, _ in waiting)]), np.concatenate([n, *(m for _, m in waiting)])))

    counts = links.select("codes").mapInArrow(run, "code long, docs long").groupBy("code").agg(F.sum("docs").alias("docs"))
    counts = checkpoint(counts).withColumn("a", F.expr(f"code div {width}"))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(most, "a").select("code", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _summed(batches: Iterator[pa.RecordBatch], known: np.ndarray, docs: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The row number, n_best and count_sum of packed links, by looking their pairs up."""
    for batch in batches:
        best_links, total = [], []
        for c, t in zip(batch.column(1), batch.column(2)):
            codes, times = unpack_links(c.as_py(), t.as_py())
            at = np.searchsorted(known, codes)
            best_links.append(int(times[best[at]].sum()))
            total.append(int((times * docs[at]).sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best_links, pa.int64()), pa.array(total, pa.int64())], ["row", "n_best", "count_sum"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed links as rows: the row number, an id pair and how often it is linked."""
    for batch in batches:
        for row, c, t in zip(batch.column(0), batch.column(1), batch.column(2)):
            codes, times = unpack_links(c.as_py(), t.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), row.as_py())), pa.array(codes), pa.array(times)], ["row", "code", "times"])


RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align_documents(docs: DataFrame, path_a: str, path_b: str, keep: tuple[str, ...] = ("doc_id",), sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """Aligns the tokens of two tokenizers over every whole text: ``keep``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level tokenizer (JSON) over a space and the text, B a sentencepiece model that adds that
    space. Links are the pairs of tokens whose byte ranges overlap; a pair of ids counts the documents
    (rows) that hold it linked. n_best: links whose count is the highest of their A id, ties included;
    count_sum: the counts of all links, added up. Groups are cut where tokens of both end.

    A null or empty text, and one whose bytes don't come back from both token sequences (it holds
    U+2581), has no tokens: zeros, and '' as digest. Repeated rows count as documents of their own; an
    empty table gives no rows; a column of ``keep`` that is named like a result gives way to it.

    Counts of up to ``sent_pairs`` id pairs (their number is bounded by both vocabularies) are sent to
    all workers; beyond it links become rows and are joined, a pair spread over ``SALTS`` parts.
    """
    results = [c.split()[0] for c in RESULT.split(", ")]
    keep = without(keep, *results)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        for batch in batches:
            at = 0
            for texts in text_runs(batch.column(len(keep)), RUN_CHARS):
                numbers, has = aligner.read(texts)
                sums = np.array([aligner.counts[:4, k].sum(axis=1) if h else np.zeros(4, np.int64) for k, h in zip(numbers, has.tolist())]).reshape(len(texts), 4)
                digest = [hashlib.sha256(";".join(map(aligner.groups.__getitem__, k.tolist())).encode()).hexdigest() if h else "" for k, h in zip(numbers, has.tolist())]
                doc, code, times = _links(aligner, numbers, has)
                cut = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
                packed = [(_packed(np.diff(code[a:b], prepend=0)), _packed(times[a:b])) for a, b in zip(cut, cut[1:])]
                kept = [batch.column(k).slice(at, len(texts)) for k in range(len(keep))]
                columns = [pa.StructArray.from_arrays(kept, list(keep)) if keep else pa.nulls(len(texts), pa.struct([])), *(pa.array(sums[:, k]) for k in range(4)), pa.array(digest, pa.string()), *(pa.array([p[k] for p in packed], pa.binary()) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, ["kept", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"])
                at += len(texts)

    frame = docs.select(*(F.col(f"`{k}`") for k in keep), F.col("text").cast("string").alias(fresh("_text", keep)))
    kept = T.StructType(frame.schema.fields[: len(keep)])
    schema = T.StructType().add("kept", kept)
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        schema = schema.add(name, "long")
    schema = schema.add("groups_sha256", "string").add("codes", "binary").add("times", "binary")
    done = checkpoint(frame.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    links = done.filter("n_links > 0").select("row", "codes", "times")
    counts = checkpoint(link_counts(links, len(Pieces(path_b).tokens)))
    if counts.count() <= sent_pairs:
        table = counts.toArrow()
        order = np.argsort(table.column("code").to_numpy())
        sent = docs.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy()[order] for c in ("code", "docs", "best")))
        sums = links.mapInArrow(lambda batches: _summed(batches, *sent.value), "row long, n_best long, count_sum long")
    else:
        one = links.mapInArrow(_listed, "row long, code long, times long").withColumn("salt", (F.col("row") % SALTS).cast("int"))
        spread = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        sums = one.join(spread, ["code", "salt"]).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    out = done.drop("codes", "times").join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"])
    return out.select("kept.*", *results)


def aligned_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, group_no (from 0), a, b: the ids of every group of every text, in order; the product of a and b has all its id pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        for batch in batches:
            at = 0
            for texts in text_runs(batch.column(1), RUN_CHARS):
                numbers, has = aligner.read(texts)
                for i, (k, h) in enumerate(zip(numbers, has.tolist())):
                    sides = [g.split("|") for w in k.tolist() for g in aligner.groups[w].split(";")] if h else []
                    a, b = ([[int(x) for x in s[side].split(",")] for s in sides] for side in (0, 1))
                    n = len(sides)
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[at + i].as_py()] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(a, pa.list_(pa.int32())), pa.array(b, pa.list_(pa.int32()))], ["doc_id", "group_no", "a", "b"])
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, group_no long, a array<int>, b array<int>")


def group_products(groups: DataFrame) -> DataFrame:
    """The groups' products as rows: doc_id, group_no, a, b for every pair of ids within a group."""
    return groups.select("doc_id", "group_no", F.explode("a").alias("a"), "b").select("doc_id", "group_no", "a", F.explode("b").alias("b"))
