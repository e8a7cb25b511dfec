"""Source divergence audit: how far the word use of each source of a language lies from every other's.

Term counts are packed per (language, block of terms, source). A packed vector stays in the partition
of its source, and its peers' vectors circulate: the circle method of round-robin tournaments says who
visits whom in which round, so that each pair of sources meets once in every block and both directions
are computed from one meeting. A task holds one resident and one visitor at a time. Terms of a group
are ranked by bounded heaps in the tasks that pack them; only what heaps keep is ranked globally.
All arithmetic is on integers.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, checkpoint, small, text_chunks, word_spans

LEAST_DOCS = 3
TOP_TERMS = 200
#: Bytes of text that are counted at a time.
RUN_BYTES = 1 << 24
#: Terms of a block, rows that are packed at a time, entries that the heaps of a task hold before they are let go.
BLOCK_TERMS, PACK_ROWS, HEAP_ROWS = 8192, 200_000, 1_000_000
#: Groups are joined by broadcast up to this many.
BROADCAST_ROWS = 100_000
#: Separators: ASCII but for letters.
NOT_LETTER = np.zeros(256, bool)
NOT_LETTER[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def share(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (n + 1) / of), exactly, for n < of < 9 * 10^15: division in three steps of a thousand."""
    rest, out = n.astype(np.int64) + 1, np.zeros(len(n), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // of
        rest = rest % of
    return out + 1


def _grouped(docs: DataFrame) -> DataFrame:
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(plain("lang"), plain("source"), plain("text"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at, end, data, offsets in text_chunks(batch.column(2), RUN_BYTES):
            data = ASCII_LOWER[data]
            starts, ends, first = word_spans(data, offsets, NOT_LETTER)
            if not len(starts):
                continue
            groups: dict[tuple[str, str], int] = {}
            of = np.array([groups.setdefault(k, len(groups)) for k in zip(names[at:end], sources[at:end])], np.int64)
            where = np.zeros(len(starts) + 1, np.int64)
            np.cumsum(ends - starts, out=where[1:])
            words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(where), pa.py_buffer(data[~NOT_LETTER[data]])).dictionary_encode()
            n = len(words.dictionary)
            doc = np.repeat(np.arange(end - at, dtype=np.int64), np.diff(first))
            keys, c = np.unique(doc * n + words.indices.to_numpy(), return_counts=True)
            keys = of[keys // n] * n + keys % n
            order = np.argsort(keys, kind="stable")
            keys, c = keys[order], c[order]
            cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            group, term = keys[cut] // n, keys[cut] % n
            label = [pa.array([k[i] for k in groups]).take(pa.array(group)) for i in (0, 1)]
            terms = words.dictionary.cast(pa.string()).take(pa.array(term))
            out = [*label, terms, pa.array(np.add.reduceat(c, cut).astype(np.int64)), pa.array(np.diff(np.r_[cut, len(keys)]))]
            table = pa.RecordBatch.from_arrays(out, ["lang", "source", "term", "n", "docs"])
            for k in range(0, table.num_rows, PACK_ROWS):
                yield table.slice(k, PACK_ROWS)


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n, lang_n, first of the terms in at least ``least_docs`` documents of a language.

    n: occurrences in the group; lang_n: in the language; first: true in one row of each term of a language.
    """
    runs = _grouped(docs).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    per = runs.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    per = per.withColumn("lang_n", F.sum("n").over(w)).withColumn("spread", F.sum("docs").over(w)).withColumn("first", F.row_number().over(w.orderBy("source")) == 1)
    return checkpoint(per.filter(F.col("spread") >= least_docs).select("lang", "source", "term", "n", "lang_n", "first"))


def groups_of(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Every (lang, source): seat (from 0 by source), seats, den (N + V of the group) and lang_den (of the language)."""
    g = _grouped(docs).select("lang", "source").distinct()
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    whole = counts.groupBy("lang").agg(F.sum("n").alias("whole"), F.count_if("first").alias("v"))
    g = g.join(own, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0, ["own", "whole", "v"])
    seat = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    g = g.select("lang", "source", seat.alias("seat"), F.count("*").over(Window.partitionBy("lang")).cast("int").alias("seats"), (F.col("own") + F.col("v")).alias("den"), (F.col("whole") + F.col("v")).alias("lang_den"))
    return checkpoint(g)


def _packed(counts: np.ndarray) -> bytes:
    small_counts = counts.astype(np.min_scalar_type(int(counts.max(initial=0))))
    return small_counts.dtype.char.encode() + zlib.compress(small_counts.tobytes(), 1)


def _unpacked(packed: bytes | None, terms: int) -> np.ndarray:
    if packed is None:
        return np.zeros(terms, np.int64)
    return np.frombuffer(zlib.decompress(packed[1:]), packed[:1].decode()).astype(np.int64)


PACKED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("block", pa.int64()), ("terms", pa.int32()), ("packed", pa.binary()), ("term", pa.string()), ("value", pa.int64())])


def _starts(*columns: pa.Array) -> np.ndarray:
    """Where any of the columns differs from the row before; the first row counts."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = np.logical_or.reduce([pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in columns])
    return new


class _Packer:
    """Packs rows that come by language, term and source, and ranks the terms of each group in heaps."""

    def __init__(self, task: int, top: int) -> None:
        self.block, self.top, self.heaps, self.held = task << 32, top, {}, 0

    def vectors(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        lang, term, source = (rows.column(k).combine_chunks() for k in ("lang", "term", "source"))
        n, den, lang_n, lang_den = (rows.column(k).to_numpy() for k in ("n", "den", "lang_n", "lang_den"))
        p, q = share(n, den), share(lang_n, lang_den)
        value = np.where(p > q, (p - q) ** 2 // q, -1)
        number = np.cumsum(_starts(lang, term)) - 1
        edge = np.r_[np.flatnonzero(_starts(lang)), len(n)]
        coded = source.dictionary_encode()
        of, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        out = []
        for a, b in zip(edge[:-1], edge[1:]):
            name, base = lang[int(a)].as_py(), number[a]
            for group in np.unique(of[a:b]).tolist():
                mine = a + np.flatnonzero((of[a:b] == group) & (value[a:b] >= 0))
                best = mine[np.argsort(-value[mine], kind="stable")[: self.top]]
                self.push((name, names[group]), zip((-value[best]).tolist(), term.take(pa.array(best)).to_pylist()))
            for k in range(base, number[b - 1] + 1, BLOCK_TERMS):
                i, j = a + np.searchsorted(number[a:b], [k, k + BLOCK_TERMS])
                size = int(min(BLOCK_TERMS, number[b - 1] + 1 - k))
                for group in np.unique(of[i:j]).tolist():
                    mine = i + np.flatnonzero(of[i:j] == group)
                    dense = np.zeros(size, np.int64)
                    dense[number[mine] - k] = n[mine]
                    out.append((name, names[group], self.block, size, _packed(dense), None, None))
                self.block += 1
        yield _rows(out, PACKED)
        if self.held > HEAP_ROWS:
            yield self.release()

    def push(self, group: tuple[str, str], entries) -> None:
        before = self.heaps.get(group, [])
        after = heapq.nsmallest(self.top, heapq.merge(before, entries))
        self.held += len(after) - len(before)
        self.heaps[group] = after

    def release(self) -> pa.RecordBatch:
        out = [(*g, None, None, None, t, -v) for g, heap in self.heaps.items() for v, t in heap]
        self.heaps, self.held = {}, 0
        return _rows(out, PACKED)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pack(counts: DataFrame, groups: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """Packed vectors (lang, source, block, terms, packed), and beside them what heaps keep (lang, source, term, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held, n = _Packer(TaskContext.get().partitionId(), top), [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACK_ROWS:  # up to the last term that is surely complete
                rows = pa.Table.from_batches(held).combine_chunks()
                cut = int(np.flatnonzero(_starts(*(rows.column(k).combine_chunks() for k in ("lang", "term"))))[-1])
                if cut:
                    yield from packer.vectors(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                n -= cut
        if n:
            yield from packer.vectors(pa.Table.from_batches(held))
        yield packer.release()

    rows = counts.join(small(groups.select("lang", "source", "den", "lang_den"), BROADCAST_ROWS), ["lang", "source"]).select("lang", "term", "source", "n", "den", "lang_n", "lang_den")
    rows = rows.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return checkpoint(rows.mapInArrow(run, "lang string, source string, block long, terms int, packed binary, term string, value long"))


def round_of(i: Column, j: Column, seats: Column) -> Column:
    """The round in which seats i and j meet, by the circle method: the last of an even number of seats stands still."""
    last = seats - 1 + seats % 2
    low, high = F.least(i, j), F.greatest(i, j)
    return F.when(high == last, (2 * low) % last).otherwise((low + high) % F.greatest(last, F.lit(1)))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("seat", pa.int32()), ("other", pa.int32()), ("value", pa.int64())])
    at, mine = None, None
    for batch in batches:
        out = []
        for lang, block, home, meeting, seat, den, terms, packed in zip(*(c.to_pylist() for c in batch.columns)):
            theirs = share(_unpacked(packed, terms), np.int64(den)) if terms else np.zeros(0, np.int64)
            if meeting < 0:  # the resident comes first and stays
                at, mine = (lang, block, home), theirs
                continue
            assert at == (lang, block, home)
            apart = (mine - theirs) ** 2
            out += [(lang, home, seat, int((apart // theirs).sum())), (lang, seat, home, int((apart // mine).sum()))]
        yield _rows(out, schema)


def meetings(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, seat, other, value: the divergence of every source from every other one of its language, over all blocks.

    Every group has a vector in every block of its language (nothing there: zeros), and one in an
    empty block, so that languages without terms have their meetings too.
    """
    g = groups.select("lang", "source", "seat", "seats", "den")
    blocks = vectors.select("lang", "block", "terms").distinct().union(g.select("lang", F.lit(-1).cast("long"), F.lit(0)).distinct())
    full = blocks.join(small(g, BROADCAST_ROWS), "lang").join(vectors.select("lang", "block", "source", "packed"), ["lang", "block", "source"], "left")
    host = F.filter(F.sequence(F.lit(0), F.col("seats") - 1), lambda h: (h != F.col("seat")) & F.when((h + F.col("seat")) % 2 == 0, h < F.col("seat")).otherwise(h > F.col("seat")))
    carried = ("seat", "den", "terms", "packed")
    residents = full.select("lang", "block", F.col("seat").alias("home"), F.lit(-1).alias("meeting"), *carried)
    visitors = full.withColumn("home", F.explode(host)).select("lang", "block", "home", round_of(F.col("home"), F.col("seat"), F.col("seats")).alias("meeting"), *carried)
    seated = residents.union(visitors).repartition("lang", "block", "home").sortWithinPartitions("lang", "block", "home", "meeting")
    return seated.mapInArrow(_met, "lang string, seat int, other int, value long").groupBy("lang", "seat", "other").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """Divergences of the sources of each language: lang, source, part, item, value, rank.

    Terms are runs of letters (non-ASCII characters included, A-Z as a-z) in at least ``least_docs``
    documents (rows) of the language. A group gives a term of count c the share p = 1 + floor(10^9 (c +
    1) / (N + V)), with N the group's count of all V kept terms; the divergence of p from q is the sum
    of floor((p - q)^2 / q). Part ``pair``: each other source of the language, all ranks. Part
    ``term``: the group's terms whose share is over the language's, the ``top`` first. Ranks go by
    falling value, then by item.

    Null text, lang and source count as empty strings; repeated rows count as often as they stand
    there; texts are never cut; other columns are ignored. A language with one source has no pairs, one
    without kept terms has pairs of value 0. An empty table gives no rows.
    """
    counts = term_counts(docs, least_docs)
    groups = groups_of(docs, counts)
    packed = pack(counts, groups, top)
    met = meetings(packed.filter("block IS NOT NULL"), groups)
    names = small(groups.select("lang", "seat", "source"), BROADCAST_ROWS)
    pairs = met.join(names, ["lang", "seat"]).join(names.withColumnRenamed("source", "item").withColumnRenamed("seat", "other"), ["lang", "other"])
    order = lambda: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", order())
    terms = packed.filter("block IS NULL").withColumnRenamed("term", "item")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", order()).filter(F.col("rank") <= top)
    return pairs.union(terms)
