"""Byte-level BPE: encoding by rank files, with a segment tree over byte positions, and decoding.

A segment tree over the positions of a piece holds, at each leaf, the rank of the pair that starts
there (with its position, so that the leftmost of equal ranks wins) and above it minima; the root is
the next merge. A merge writes three leaves (itself, its left neighbour, the byte run it swallowed)
and their logarithmic paths. Short pieces of one length class are merged side by side as rows of one
matrix; long pieces get a tree each. Pieces seen before come from a bounded memo.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, without

#: Pieces that a worker remembers before it starts afresh; those longer than the widest class are never kept.
MEMO = 100_000
#: Characters of text that are split into pieces at a time.
RUN_CHARS = 1_000_000
_CLASSES = (8, 16, 32, 64)
_NONE = np.iinfo(np.int64).max
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Ranks:
    """A rank file: the bytes of each id, and a hash table from pairs of ids to the id of their union."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.width = max(self.ids.values()) + 1
        self.tokens = [b""] * self.width
        for token, i in self.ids.items():
            self.tokens[i] = token
        pairs = {}
        for token, i in self.ids.items():
            for k in range(1, len(token)):
                a, b = self.ids.get(token[:k]), self.ids.get(token[k:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = i
        self.pairs = pairs
        self.bits = max(4, (3 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int64)
        wanted = np.fromiter(pairs, np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int64, len(pairs))
        place = self._place(wanted)
        while len(wanted):  # all that find their slot empty try it; one wins, the others move on
            free = self.keys[place] == -1
            self.keys[place[free]] = wanted[free]
            won = self.keys[place] == wanted
            self.values[place[won]] = values[won]
            wanted, values, place = wanted[~won], values[~won], (place[~won] + 1) & ((1 << self.bits) - 1)
        self.byte_ids = np.array([self.ids.get(bytes([i]), -1) for i in range(256)], np.int64)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or the largest integer where the pair never merges."""
        keys = left * self.width + right
        place = self._place(keys)
        found = self.keys[place]
        out = np.where(found == keys, self.values[place], _NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            place[open_] = (place[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[place[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[place[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


_RANKS: dict[str, Ranks] = {}


def ranks_of(path: str) -> Ranks:
    if path not in _RANKS:
        _RANKS[path] = Ranks(path)
    return _RANKS[path]


def _merge_rows(pieces: list[bytes], width: int, ranks: Ranks) -> list[bytes]:
    """Merges pieces of at most ``width`` bytes side by side; the ids of each as little-endian bytes."""
    n = len(pieces)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    size = np.fromiter(map(len, pieces), np.int64, n)
    at = np.arange(width)
    ids = np.zeros((n, width + 1), np.int64)
    ids[:, :width] = ranks.byte_ids[raw]
    live = np.zeros((n, width + 1), bool)
    live[:, :width] = at < size[:, None]
    after = np.minimum(np.broadcast_to(np.arange(1, width + 2), (n, width + 1)), size[:, None])
    after = np.where(after >= size[:, None], width, after)
    before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
    tree = np.full((n, 2 * width), _NONE, np.int64)
    rank = ranks.pair_ranks(ids[:, : width - 1].ravel(), ids[:, 1:width].ravel()).reshape(n, width - 1)
    usable = (at[1:] < size[:, None]) & (rank != _NONE)
    tree[:, width : 2 * width - 1] = np.where(usable, rank * width + at[:-1], _NONE)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    rows = np.arange(n)
    while True:
        root = tree[rows, 1]
        going = root != _NONE
        rows, root = rows[going], root[going]
        if not len(rows):
            break
        pos, new = root % width, root // width
        gone = after[rows, pos]
        nxt, prv = after[rows, gone], before[rows, pos]
        ids[rows, pos] = new
        live[rows, gone] = False
        after[rows, pos] = nxt
        before[rows, nxt] = pos
        tree[rows, width + gone] = _NONE
        right = np.where(nxt < width, ranks.pair_ranks(new, ids[rows, nxt]), _NONE)
        tree[rows, width + pos] = np.where(right != _NONE, np.where(right != _NONE, right, 0) * width + pos, _NONE)
        has = prv >= 0
        left = ranks.pair_ranks(ids[rows[has], prv[has]], new[has])
        tree[rows[has], width + prv[has]] = np.where(left != _NONE, np.where(left != _NONE, left, 0) * width + prv[has], _NONE)
        paths = [(rows, width + gone), (rows, width + pos), (rows[has], width + prv[has])]
        for _ in range(width.bit_length() - 1):
            paths = [(r, k >> 1) for r, k in paths]
            for r, k in paths:
                tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])
    flat = ids[live].astype("<u4").tobytes()
    ends = np.cumsum(live.sum(axis=1)).tolist()
    return [flat[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]


def _merge_long(piece: bytes, ranks: Ranks) -> bytes:
    """One piece of any length, by a segment tree of its own."""
    n, none, pairs, scale = len(piece), _NONE, ranks.pairs, ranks.width
    width = 1 << (n - 1).bit_length()
    ids = [int(ranks.byte_ids[b]) for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [none] * (2 * width)

    def key(i: int) -> int:
        j = after[i]
        rank = pairs.get(ids[i] * scale + ids[j]) if j < n else None
        return none if rank is None else rank * width + i

    for i in range(n - 1):
        tree[width + i] = key(i)
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: int) -> None:
        k = width + i
        tree[k] = value
        while k > 1:
            k >>= 1
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                break
            tree[k] = least

    while tree[1] != none:
        rank, i = divmod(tree[1], width)
        gone = after[i]
        ids[i], after[i] = rank, after[gone]
        ids[gone] = -1
        if after[i] < n:
            before[after[i]] = i
        put(gone, none)
        put(i, key(i))
        if before[i] >= 0:
            put(before[i], key(before[i]))
    return np.array([x for x in ids if x >= 0], "<u4").tobytes()


def encode_pieces(pieces: Iterable[bytes], ranks: Ranks) -> list[bytes]:
    """The ids of each piece, as little-endian unsigned 32-bit integers."""
    pieces = list(pieces)
    out: list[bytes] = [b""] * len(pieces)
    groups: dict[int, list[int]] = {w: [] for w in _CLASSES}
    for i, piece in enumerate(pieces):
        whole = ranks.ids.get(piece)
        if whole is not None:
            out[i] = whole.to_bytes(4, "little")
        elif len(piece) > _CLASSES[-1]:
            out[i] = _merge_long(piece, ranks)
        elif piece:
            groups[next(w for w in _CLASSES if len(piece) <= w)].append(i)
    for width, members in groups.items():
        for a in range(0, len(members), 1 << 14):
            part = members[a : a + (1 << 14)]
            for i, ids in zip(part, _merge_rows([pieces[i] for i in part], width, ranks)):
                out[i] = ids
    return out


#: The split pattern for which boundaries are found by class codes instead of a regex engine (fixed value).
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_CLASS: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """The class of each code point, asked once of the regex engine itself."""
    if not _CLASS:
        points = np.arange(0x110000, dtype="<u4")
        points[0xD800:0xE000] = 0  # surrogates
        every = points.tobytes().decode("utf-32-le")
        codes = np.zeros(0x110000, np.uint8)
        for code, name in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
            codes[[m.start() for m in regex.finditer(name, every)]] = code
        _CLASS.append(codes)
    return _CLASS[0]


def split_known(data: bytes, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The matches of KNOWN_PATTERN over texts laid end to end, and for each text the place of its first piece.

    A run of one class is a piece, together with a single space (0x20) before it. Other white space
    before a run is a piece of its own but for its last character, and a contraction is one where
    nothing is attached before its apostrophe.
    """
    raw = np.frombuffer(data, np.uint8)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    points = np.frombuffer(data.decode().encode("utf-32-le"), "<u4")
    n = len(points)
    begin = np.searchsorted(lead, offsets)
    fresh = np.zeros(n + 3, bool)  # a text starts here, or all have ended
    fresh[begin] = True
    fresh[n:] = True
    if not n:
        return [], begin
    kind = _class_table()[points]
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= fresh[:n]
    runs = np.flatnonzero(start)
    ends = np.append(runs[1:], n)
    white = kind[runs] == _SPACE
    solid = runs[~white]
    held = (solid > 0) & ~fresh[solid] & (points[solid - 1] == 0x20)
    start[solid[held]] = False
    start[solid[held] - 1] = True
    first, last, stop = runs[white], ends[white] - 1, ends[white]
    alone = ~fresh[stop] & (last > first) & (points[last] != 0x20)
    start[last[alone]] = True
    quote = solid[(points[solid] == 0x27) & ~held]
    quote = quote[~fresh[quote + 1]]
    if len(quote):
        one = points[quote + 1]
        two = np.where(fresh[quote + 2], 0, points[np.minimum(quote + 2, n - 1)])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        start[quote[short | long] + 1] = False
        for chosen, width in ((short, 2), (long, 3)):
            to = quote[chosen] + width
            start[to[to < n]] = True
    places = np.flatnonzero(start)
    cuts = lead[places].tolist()
    pieces = [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)])]
    return pieces, np.searchsorted(places, begin)


class Encoder:
    """Texts to ids and back, with the memo of pieces."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks, self.split, self.memo = ranks_of(path), regex.compile(pattern), {}
        self.known = pattern == KNOWN_PATTERN

    def _pieces(self, texts: list[str]) -> tuple[list[bytes], list[int]]:
        raw = [t.encode() for t in texts]
        if self.known:
            offsets = np.zeros(len(raw) + 1, np.int64)
            np.cumsum([len(x) for x in raw], out=offsets[1:])
            pieces, first = split_known(b"".join(raw), offsets)
            return pieces, first.tolist()
        found = [[p.encode() for p in self.split.findall(t)] for t in texts]
        first = np.zeros(len(found) + 1, np.int64)
        np.cumsum([len(x) for x in found], out=first[1:])
        return [p for x in found for p in x], first.tolist()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pieces, first = self._pieces(texts)
        new = set(pieces)
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
        new = list(new - self.memo.keys())
        self.memo.update(zip(new, encode_pieces(new, self.ranks)))
        ids = list(map(self.memo.__getitem__, pieces))
        for piece in new:
            if len(piece) > _CLASSES[-1]:
                del self.memo[piece]
        return [b"".join(ids[a:b]) for a, b in zip(first, first[1:])]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _runs(texts: pa.Array) -> Iterator[list[str]]:
    """A batch's texts in runs of a bounded number of characters; null is empty."""
    run, size = [], 0
    for x in texts:
        t = x.as_py() or ""
        if run and size + len(t) > RUN_CHARS:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns the columns ``keep``, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit
    integers), decoded_sha256 (of the decoded bytes) and, if asked for, ids as array<int>. A null
    text counts as empty and has no ids; a text is never cut; an empty table gives no rows; repeated
    rows give repeated results. ``path`` is read on each worker, ``pattern`` splits a text before
    merging, and special tokens' strings are ordinary text. A column of ``keep`` that is named like
    a result gives way to it.
    """
    keep = without(keep, "n_tokens", "ids_sha256", "decoded_sha256", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.setdefault((path, pattern), None) or Encoder(path, pattern)
        _ENCODERS[path, pattern] = encoder
        for batch in batches:
            at = 0
            for texts in _runs(batch.column(len(keep))):
                encoded = encoder.encode(texts)
                sizes = np.fromiter((len(x) >> 2 for x in encoded), np.int64, len(encoded))
                columns = [batch.column(k).slice(at, len(texts)) for k in range(len(keep))]
                columns += [pa.array(sizes), pa.array([hashlib.sha256(x).hexdigest() for x in encoded]), pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in encoded])]
                if ids:
                    offsets = np.zeros(len(encoded) + 1, np.int32)
                    np.cumsum(sizes, out=offsets[1:])
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), "<i4"))))
                yield pa.RecordBatch.from_arrays(columns, [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids])
                at += len(texts)

    frame = docs.select(*(F.col(f"`{k}`") for k in keep), F.col("text").cast("string").alias(fresh("_text", keep)))
    results = T.StructType().add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    results = results.add("ids", T.ArrayType(T.IntegerType())) if ids else results
    return frame.mapInArrow(run, T.StructType([*frame.schema.fields[: len(keep)], *results.fields]))


def decode_ids(frame: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """Adds the decoded text of an array of ids; bytes that are not UTF-8 become U+FFFD. Null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ranks_of(path).tokens
        for batch in batches:
            k = batch.schema.get_field_index(ids)
            texts = [None if x is None else b"".join(map(tokens.__getitem__, x)).decode(errors="replace") for x in batch.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, into])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, T.StructField(into, T.StringType())]))
