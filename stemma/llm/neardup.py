"""MinHash near-duplicates: one-permutation sketches, banded buckets, star-shaped candidate edges.

A document's set is its distinct 5-word shingles. Its shingle hashes are binned once (one
permutation); an empty bin copies a full bin found by the optimal densification walk. Three bins
make a band. Equal sets are one class before anything is compared, so a group of exact copies costs
one row. In each bucket one hub, the member that meets most others over all its bands, is paired
with the rest: a bucket of m members gives m - 1 pairs. A second sketch of the same binning, finer
and without filled bins, ends a pair whose estimate is well below the limit; every other pair is confirmed on the full sets. Members of a bucket that are in different
groups after that are compared with each other by their sketches, so that no pair is lost because
its hub is like neither end. Members that a hub did not join to the rest of their group are compared
with the whole group, so that no link is lost behind a hub. Both run in blocks of bounded size, which
give only the pairs that join groups or components.

Components come from alternating large-star and small-star steps over the confirmed links, as
DataFrames; nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_row, checkpoint, mix64, shingle_sets, small, text_chunks

BINS = 72
ROWS_PER_BAND = 3
BANDS = BINS // ROWS_PER_BAND
LINK_PERCENT = 75
#: Bytes of text that a worker sketches at a time.
RUN_BYTES = 1 << 18
#: Bins of the sketch that rules pairs out: one byte each, empty bins left empty.
FINE_BINS = 256
#: A pair is not confirmed if its estimated similarity lies so many standard deviations under the limit.
DEVIATIONS = 5

_BAND_SALT = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
_ROW_SALT = mix64(np.arange(101, 101 + ROWS_PER_BAND, dtype=np.uint64)) | np.uint64(1)


def probes(attempt: int, bins: int) -> np.ndarray:
    """Where each empty bin looks at this attempt: the same walk for every document."""
    return (mix64(np.arange(bins, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)


_PROBES = [probes(t, BINS) for t in range(1, 33)]


def sketch(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One-permutation MinHash of sorted distinct hashes, with optimal densification; all zeros for an empty set."""
    out = np.zeros(bins, np.uint32)
    if not len(hashes):
        return out
    place = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    least = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    full = np.zeros(bins, bool)
    full[place[least]] = True
    out[place[least]] = hashes[least].astype(np.uint32)
    empty, attempt = np.flatnonzero(~full), 1
    while len(empty):
        walk = _PROBES[attempt - 1] if bins == BINS and attempt <= len(_PROBES) else probes(attempt, bins)
        seen = walk[empty]
        hit = full[seen]
        out[empty[hit]] = out[seen[hit]]
        empty, attempt = empty[~hit], attempt + 1
    return out


def fine_sketch(hashes: np.ndarray, bins: int = FINE_BINS) -> np.ndarray:
    """The least of sorted distinct hashes in each bin, as a byte from 1 to 255; 0 for an empty bin."""
    out = np.zeros(bins, np.uint8)
    place = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    least = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])[: len(hashes)]
    out[place[least]] = (hashes[least] & np.uint64(0xFFFFFFFF)) % np.uint64(255) + np.uint64(1)
    return out


def likely(same: np.ndarray, full: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether fine sketches leave a link possible.

    same, full: bins that hold equal values, and that hold any in either sketch; sizes: both sets'
    sizes together. Their quotient estimates the similarity; it is a sample of the joint set without
    repetition, so where the set is small, and nearly all of it in a bin of its own, it hardly errs.
    """
    share = LINK_PERCENT / 100
    full = np.maximum(full, 1)
    joint = np.maximum(sizes / (1 + share), 1)
    unseen = np.clip(1 - (full - 1) / joint, 0.05, 1)
    return same >= full * (share - DEVIATIONS * np.sqrt(share * (1 - share) * unseen / full))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sketches, keys, sizes = len(batch), [], [], np.zeros(len(batch), np.int64)
        bands = np.zeros((n, BANDS), np.uint64)
        for a, _, data, offsets in text_chunks(batch.column(1), RUN_BYTES):
            for i, hashes in enumerate(shingle_sets(data, offsets), a):
                sizes[i] = len(hashes)
                s = sketch(hashes)
                sketches.append(fine_sketch(hashes).tobytes())
                # two independent sums over the set name its class
                two = np.array([np.bitwise_xor.reduce(mix64(hashes)) if len(hashes) else 0, hashes.sum(dtype=np.uint64), len(hashes)], np.uint64)
                keys.append(two.tobytes())
                parts = s.reshape(BANDS, ROWS_PER_BAND).astype(np.uint64) * _ROW_SALT
                bands[i] = mix64(mix64(parts).sum(axis=1, dtype=np.uint64) + _BAND_SALT)
        flat = pa.array(bands.view(np.int64).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), lists], ["doc_id", "text_key", "n_shingles", "set_key", "sketch", "bands"])


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (equal for equal sets), sketch and band keys of each document."""
    return _keyed(docs).mapInArrow(_sketched, "doc_id long, text_key long, n_shingles long, set_key binary, sketch binary, bands array<long>")


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose sketches leave a link possible."""
    for batch in batches:
        if not len(batch):
            continue
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, FINE_BINS) for k in (2, 3))
        keep = likely(((a == b) & (a > 0)).sum(axis=1), ((a | b) > 0).sum(axis=1), batch.column(4).to_numpy() + batch.column(5).to_numpy())
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], ["a", "b"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs of texts whose full shingle sets reach the limit."""
    for batch in batches:
        keep, last, held = np.zeros(len(batch), bool), None, None
        left, right = batch.column(2), batch.column(3)
        for i in range(len(batch)):
            x = left[i].as_py()
            if x != last:
                last, held = x, _set_of(x)
            other = _set_of(right[i].as_py())
            both = len(np.intersect1d(held, other, assume_unique=True))
            keep[i] = 100 * both >= LINK_PERCENT * (len(held) + len(other) - both) and both > 0
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], ["a", "b"])


def _set_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return shingle_sets(data, np.array([0, len(data)], np.int64))[0]


def plausible(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches don't rule a link out."""
    s = reps.select("rep", "sketch", "n_shingles")
    return pairs.join(s.toDF("a", "sa", "na"), "a").join(s.toDF("b", "sb", "nb"), "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(_near, "a long, b long")


#: Tables of keys are broadcast up to this many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000


#: Members of a bucket aimed at for one side of a block.
BLOCK_ROWS = 8192


def _compared(others: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins in which each of other fine sketches holds the same as one, and bins that hold any in either."""
    on = np.flatnonzero(mine)
    there = others[:, on]
    return (there == mine[on]).sum(axis=1), (others > 0).sum(axis=1) + (there == 0).sum(axis=1)


def _apart(table: pa.Table) -> pa.Table:
    """Plausible pairs between the rows outside the bucket's largest group and the members of one block, as far as they join groups."""
    ids, label, left = table["rep"].to_numpy(), table["group"].to_numpy().copy(), table["left"].to_numpy()
    s = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, FINE_BINS)
    cols = np.flatnonzero(~left)
    others = s[cols]
    n = table["n_shingles"].to_numpy()
    a, b = [], []
    for i in np.flatnonzero(left):
        hits = cols[likely(*_compared(others, s[i]), n[cols] + n[i])]
        while len(hits := hits[label[hits] != label[i]]):
            a.append(int(ids[i]))
            b.append(int(ids[hits[0]]))
            label[label == label[hits[0]]] = label[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def behind_buckets(buckets: DataFrame, hubs: DataFrame, groups: DataFrame, reps: DataFrame) -> DataFrame:
    """Plausible pairs (a, b) of members that share a bucket and that no hub brought into one group.

    ``buckets``: bucket, rep; ``hubs``: bucket, hub; ``groups``: node, component of the plausible pairs
    with hubs. A hub has met all of its bucket; buckets with the same other members are looked at
    once. Only pairs that join two groups come out.
    """
    met = buckets.select("bucket", "rep").join(hubs, "bucket").filter("rep <> hub").select("bucket", "rep")
    met = met.join(groups.toDF("rep", "group"), "rep", "left").withColumn("group", F.coalesce("group", "rep"))
    sizes = met.groupBy("bucket", "group").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("h"))
    mixed = sizes.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("h").alias("h"), F.max(F.struct("n", "group")).alias("main")).filter("k > 1")
    mixed = mixed.groupBy("n", "h").agg(F.min(F.struct("bucket", "main")).alias("m")).select("m.bucket", "n", F.col("m.main.group").alias("main"), F.col("m.main.n").alias("in_main"))
    blocks = lambda size: F.ceil(size / BLOCK_ROWS).cast("int")
    mixed = mixed.select("bucket", "main", blocks(F.col("n")).alias("all_blocks"), blocks(F.col("n") - F.col("in_main")).alias("left_blocks"))
    members = checkpoint(met.join(small(checkpoint(mixed), BROADCAST_ROWS), "bucket").withColumn("left", F.col("group") != F.col("main")))
    members = members.join(reps.select("rep", "sketch", "n_shingles"), "rep")
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    cols = members.select("bucket", F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)).alias("i"), place("all_blocks").alias("j"), F.lit(False).alias("left"), "rep", "group", "sketch", "n_shingles")
    rows = members.filter("left").select("bucket", place("left_blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("j"), F.lit(True).alias("left"), "rep", "group", "sketch", "n_shingles")
    return cols.union(rows).groupBy("bucket", "i", "j").applyInArrow(_apart, "a long, b long").distinct()


def _texts(docs: DataFrame, reps: DataFrame, ids: DataFrame) -> DataFrame:
    """rep and the text of one document of each set whose ``rep`` is among ``ids``."""
    asked = small(checkpoint(reps.join(ids, "rep", "left_semi").select("rep", "doc_id", "text_key")), BROADCAST_ROWS)
    return _keyed(docs).join(asked, ["doc_id", "text_key"]).dropDuplicates(["rep"]).select("rep", "text")


#: Pairs of one set in one task; the text of a set with more is there once for so many.
PAIRS_TOGETHER = 1000


def confirm(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) that hold on the full sets of their texts.

    The pairs of a hub are dealt out by its other ends, and each part gets the hub's text once.
    """
    texts = checkpoint(_texts(docs, reps, pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()))
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_TOGETHER).cast("int").alias("parts")).filter("parts > 1")
    parts = small(checkpoint(parts), BROADCAST_ROWS)
    dealt = pairs.join(parts, "a", "left").select("a", "b", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).otherwise(0).alias("part"))
    hubs = texts.toDF("a", "ta").join(parts, "a", "left").select("a", "ta", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    both = dealt.join(texts.toDF("b", "tb"), "b").join(hubs, ["a", "part"]).select("a", "b", "ta", "tb")
    return both.mapInArrow(_confirmed, "a long, b long")


#: Bytes of text aimed at for one side of a block.
BLOCK_BYTES = 1 << 20


def _block(table: pa.Table) -> pa.Table:
    """Links between the rows left out by the hub and the members of one block, as far as they join components."""
    sets = [h for _, _, data, offsets in text_chunks(table["text"]) for h in shingle_sets(data, offsets)]
    ids, of = table["rep"].to_numpy(), dict(zip(table["rep"].to_pylist(), table["component"].to_pylist()))
    left = table["left"].to_numpy()
    rows, cols = np.flatnonzero(left), np.flatnonzero(~left)
    fine = [fine_sketch(h) for h in sets]
    others = np.array([fine[j] for j in cols], np.uint8).reshape(len(cols), FINE_BINS)
    sizes = np.array([len(x) for x in sets], np.int64)
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    a, b = [], []
    for i in rows:
        same, full = _compared(others, fine[i])
        hits = np.flatnonzero(likely(same, full, sizes[cols] + sizes[i]))
        for k in hits[np.argsort(-same[hits] / full[hits], kind="stable")]:
            j = cols[k]
            x, y = root(of[int(ids[i])]), root(of[int(ids[j])])
            n, m = len(sets[i]), len(sets[j])
            if x == y or 100 * min(n, m) < LINK_PERCENT * max(n, m):
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= LINK_PERCENT * (n + m - both):
                a.append(int(ids[i]))
                b.append(int(ids[j]))
                parent[max(x, y)] = min(x, y)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def behind_hubs(groups: DataFrame, found: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) that pass no hub: in a group (node, component) of plausible pairs, between members outside its largest component and all others.

    Both sides come in blocks of bounded bytes, each pair of blocks is one task's work, and only
    links that join two components come out.
    """
    groups = groups.toDF("rep", "group")
    of = found.select(F.col("node").alias("rep"), "component")
    members = groups.join(of, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = members.groupBy("group", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("group").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.max_by("component", F.struct("n", -F.col("component"))).alias("main")).filter("k > 1 AND n > 2").select("group", "main")
    members = checkpoint(members.join(small(checkpoint(mixed), BROADCAST_ROWS), "group").withColumn("left", F.col("component") != F.col("main")).select("rep", "group", "component", "left"))
    members = checkpoint(members.join(_texts(docs, reps, members.select("rep")), "rep"))
    blocks = lambda size: F.greatest(F.lit(1), F.ceil(size / BLOCK_BYTES)).cast("int")
    counted = members.groupBy("group").agg(blocks(F.sum(F.octet_length("text"))).alias("all_blocks"), blocks(F.sum(F.when(F.col("left"), F.octet_length("text")).otherwise(0))).alias("left_blocks"))
    members = members.join(small(checkpoint(counted), BROADCAST_ROWS), "group")
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    cols = members.select("group", F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)).alias("i"), place("all_blocks").alias("j"), F.lit(False).alias("left"), "rep", "component", "text")
    rows = members.filter("left").select("group", place("left_blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("j"), F.lit(True).alias("left"), "rep", "component", "text")
    return cols.union(rows).groupBy("group", "i", "j").applyInArrow(_block, "a long, b long")


#: Edges aimed at for one partition while components are found.
EDGES_TOGETHER = 10_000


def components(links: DataFrame) -> DataFrame:
    """node, component for each node of the links (a, b); component is the smallest node reachable.

    Large-star and small-star steps alternate until nothing changes; the edges then point at the
    smallest node of their component. Each step is a partial minimum and a join, both safe for a
    node with very many links.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = checkpoint(edges)
    mark = None
    while True:
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen.n, seen.h) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct().toDF("node", "component"))
        mark = (seen.n, seen.h)
        # few edges in many partitions would be many files a step, and there are several steps a round
        parts = 1 + seen.n // EDGES_TOGETHER
        edges = edges.coalesce(parts)
        # large-star: every larger neighbour of u now points at u's smallest neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts).distinct()
        # small-star: u and its smaller neighbours point at the smallest of them
        edges = edges.coalesce(parts)
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        edges = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").coalesce(parts).distinct()
        edges = checkpoint(edges.coalesce(parts))


def grouped(docs: DataFrame) -> DataFrame:
    """The columns of near_duplicates, and text_key and group of each row; group: one number for all that are linked, null for what can't be."""
    known = checkpoint(sketches(docs))
    full = known.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # a set is told by its key and named by a number; its text is that of one of its documents
    reps = full.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("of"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    reps = checkpoint(reps.select(F.monotonically_increasing_id().alias("rep"), "set_key", "of.doc_id", "of.text_key", "n_shingles", "sketch", "bands"))

    buckets = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = checkpoint(buckets.join(shared, "bucket"))
    weight = buckets.groupBy("rep").agg(F.sum("size").alias("weight"))
    weighed = buckets.select("bucket", "rep").join(weight, "rep")
    hubs = weighed.groupBy("bucket").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("hub"))
    stars = buckets.select("bucket", "rep").join(hubs, "bucket").filter("rep <> hub").select(F.least("rep", "hub").alias("x"), F.greatest("rep", "hub").alias("y"), F.col("hub").alias("a"))
    stars = stars.groupBy("x", "y").agg(F.min("a").alias("a")).select("a", F.expr("x + y - a").alias("b"))
    near = checkpoint(plausible(stars, reps))
    groups = components(near)
    apart = checkpoint(behind_buckets(buckets, hubs, groups, reps))
    if not apart.isEmpty():
        near = near.union(apart)
        groups = components(near)
    links = checkpoint(confirm(near, docs, reps))
    found = components(links)
    more = checkpoint(behind_hubs(groups, found, docs, reps))
    if not more.isEmpty():
        found = components(links.union(more))

    found = found.join(reps.select(F.col("rep").alias("node"), "doc_id"), "node")
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = checkpoint(found.join(least, "component").select(F.col("node").alias("rep"), "component", "component_id"))
    classes = reps.select("rep", "set_key", "doc_id").join(small(linked, BROADCAST_ROWS), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("group"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = full.select("doc_id", "text_key", "n_shingles", "set_key").join(classes, "set_key").drop("set_key")
    alone = known.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "text_key", "n_shingles", F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id), one row per row of ``docs``.

    A null or empty text, or one without words, has an empty set and is linked with nothing. Equal
    sets are always linked. Repeated rows share their doc_id's component; a null doc_id links to
    nothing and is kept. Rows that share a doc_id but not their text are documents of their own, of
    which each is linked by its own text. Other columns are ignored. An empty table gives no rows.
    """
    return grouped(docs).select("doc_id", "n_shingles", "component_id", "kept")


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of ``docs``, with all its columns, of each group of near duplicates: a row with the group's smallest doc_id.

    Rows that repeat that doc_id and text are one row, and so are rows of one group that repeat it
    with other texts. A row with a null doc_id, or without words, is linked with nothing and stays;
    of rows without words that repeat a doc_id and text one stays.
    """
    found = checkpoint(grouped(docs).filter("doc_id IS NOT NULL").select("doc_id", "text_key", "group", "kept"))
    rows = docs.select(as_row(docs), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key"))
    out = rows.join(found.filter("NOT kept").select("doc_id", "text_key").distinct(), ["doc_id", "text_key"], "left_anti")
    again = checkpoint(found.filter("kept").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if not again.isEmpty():  # ids that repeat: one row of each group
        again = small(again, BROADCAST_ROWS)
        one = found.filter("kept").join(again, "doc_id", "left_semi").groupBy("doc_id", "group").agg(F.min("text_key").alias("text_key")).select("doc_id", "text_key").distinct()
        out = out.join(again, "doc_id", "left_anti").unionByName(out.join(small(one, BROADCAST_ROWS), ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"]))
    return out.select("row.*")
