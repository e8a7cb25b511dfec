"""Document fingerprints: one-permutation MinHash with packed low-order bits.

A text's 5-word shingles are hashed once; a hash's leading bits choose its bin, and each bin keeps
its least hash. An empty bin copies the full bin that comes first in an order of its own (optimal
densification: every empty bin chooses independently, and alike for all texts). The low eight bits
of each bin are packed into 64-bit words. Agreement by chance, one in 256, is taken out of the
likeness of two fingerprints. Only built-in functions over arrays are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW = 8
PER_WORD = 64 // LOW
SHINGLE = 5
#: Neighbours are found within ranges of doc_id of so many rows, or the root of all rows if that is more.
RANGE_ROWS = 500


def shingle_hashes(text: Column) -> Column:
    """Hashes of the 5-word shingles of a text, ascending; of the whole sequence for one to four words; none without words.

    Case doesn't count; words stand between spaces and 0x09 to 0x0D.
    """
    words = F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    # a one-element array binds the word hashes once for the expression that uses them often
    return F.flatten(F.transform(F.array(hashed), _runs))


def _runs(words: Column) -> Column:
    n = F.size(words)
    many = F.transform(F.slice(words, 1, n - (SHINGLE - 1)), lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, SHINGLE))))
    return F.when(n >= SHINGLE, F.sort_array(many)).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS)


def _minima(hashes: Column) -> Column:
    """The least hash of each full bin, in the order of the sorted hashes."""
    return F.filter(hashes, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(hashes, i - 1))))


def _values(least: Column) -> Column:
    """The value of every bin in turn, empty bins filled; least: the minima of the full bins."""
    full = F.transform(least, _bin)

    def value(j: Column) -> Column:
        at = F.array_position(full, j)
        order = F.transform(full, lambda k: F.xxhash64(j, k).bitwiseAND(F.lit(-BINS)).bitwiseOR(k))
        chosen = F.array_min(order).bitwiseAND(F.lit(BINS - 1))
        return F.when(at > 0, F.get(least, (at - 1).cast("int"))).otherwise(F.get(least, (F.array_position(full, chosen) - 1).cast("int")))

    # with all bins full the sorted minima are the bins from the sign bit on; turn them round
    straight = F.concat(F.slice(least, BINS // 2 + 1, BINS // 2), F.slice(least, 1, BINS // 2))
    return F.when(F.size(least) == BINS, straight).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), value))


def _packed(values: Column) -> Column:
    def word(i: Column) -> Column:
        out = None
        for k in range(PER_WORD):
            part = F.shiftleft(F.get(values, i * PER_WORD + k).bitwiseAND(F.lit((1 << LOW) - 1)), LOW * (PER_WORD - 1 - k))
            out = part if out is None else out.bitwiseOR(part)
        return out

    return F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_WORD - 1)), word)


def fingerprint(text: Column) -> Column:
    """The packed fingerprint as an array of 64-bit words; empty for a text without words or null."""

    def of(hashes: Column) -> Column:
        minima = F.transform(F.array(hashes), _minima)
        values = F.transform(minima, _values)
        packed = F.flatten(F.transform(values, _packed))
        return F.when(F.size(hashes) > 0, packed).otherwise(F.array().cast("array<bigint>"))

    return F.flatten(F.transform(F.array(shingle_hashes(F.coalesce(text, F.lit("")))), of))


def as_hex(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.lower(F.lpad(F.hex(w), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of two fingerprinted texts, without agreement by chance; 1 for two empty ones, 0 for one."""

    def same(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        out = None
        for k in range(PER_WORD):
            hit = F.when(F.shiftrightunsigned(z, LOW * k).bitwiseAND(F.lit((1 << LOW) - 1)) == 0, 1).otherwise(0)
            out = hit if out is None else out + hit
        return out

    agree = F.aggregate(F.zip_with(a, b, same), F.lit(0), lambda n, x: n + x) / F.lit(float(BINS))
    chance = 1.0 / (1 << LOW)
    fair = F.greatest(F.lit(0.0), (agree - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(fair)


def _place(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts a value reaches: first among blocks of cuts, then within one block."""
    if not cuts:
        return F.lit(0)
    size = math.isqrt(len(cuts)) + 1
    listed = lambda some: F.split(F.lit(",".join(map(str, some))), ",").cast("array<bigint>")
    reached = lambda some: F.size(F.filter(some, lambda c: c <= value))
    block = reached(listed(cuts[::size]))
    return F.when(block == 0, 0).otherwise((block - 1) * size + reached(F.slice(listed(cuts), (block - 1) * size + 1, size)))


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """doc_id, text, ghost, and the window in which the following row is the next document.

    Rows are dealt out by ranges of doc_id; each range ends with a ghost, the first row of the range
    after it (of the first range after the last), so that no row needs another range.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = rows.select("doc_id").filter("doc_id IS NOT NULL")
    n = ids.count()
    ranges = n // max(RANGE_ROWS, math.isqrt(n))
    cuts = []
    if ranges > 1:  # the root of all rows, at most, comes to the driver
        dealt = ids.repartitionByRange(ranges, "doc_id").select("doc_id", F.spark_partition_id().alias("range"))
        cuts = sorted(r.c for r in dealt.groupBy("range").agg(F.min("doc_id").alias("c")).collect())[1:]
    place = _place(F.col("doc_id"), cuts)
    placed = rows.select("doc_id", "text", F.when(F.col("doc_id").isNull(), 0).otherwise(place).alias("range"), F.lit(0).alias("ghost"))
    # the first document of each range: a row per range
    firsts = placed.groupBy("range").agg(F.min("doc_id").alias("id"), F.max(F.col("doc_id").isNull()).alias("has_null")).orderBy("range").collect()
    ghosts = [(None if after.has_null else after.id, here.range) for here, after in zip(firsts, [*firsts[1:], *firsts[:1]])]
    if ghosts:
        spark = docs.sparkSession
        to = F.broadcast(spark.createDataFrame(ghosts, "id long, to int"))
        least = rows.join(to, F.col("doc_id").eqNullSafe(F.col("id"))).groupBy("to").agg(F.min(F.struct("doc_id", "text")).alias("r"))
        placed = placed.union(least.select("r.doc_id", "r.text", F.col("to").alias("range"), F.lit(1).alias("ghost")))
    return placed, Window.partitionBy("range").orderBy("ghost", "doc_id", "text")


def likeness_of_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they and the next document's are.

    Edited: the last floor(n_chars / 2) code points replaced by as many first ones of the next
    document by doc_id (equal ids by text; a null id comes first; after the last comes the first).
    A null text is empty; an empty text has an empty fingerprint. A table of one row is its own next
    document. Repeated rows stay, and other columns are ignored. An empty table gives no rows.
    """
    placed, order = with_next(docs)
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) AS int))"), F.expr("substring(after, 1, cast(floor(length(text) / 2) AS int))"))
    rows = placed.withColumn("after", F.lead("text").over(order))
    rows = rows.select("doc_id", "text", "range", "ghost", n.cast("long").alias("n_chars"), F.when(F.col("ghost") == 0, edited).alias("edited"))
    rows = rows.select("doc_id", "text", "range", "ghost", "n_chars", F.when(F.col("ghost") == 0, F.sha2("edited", 256)).alias("edited_sha256"), fingerprint(F.col("text")).alias("mine"), F.when(F.col("ghost") == 0, fingerprint(F.col("edited"))).alias("theirs"))
    rows = rows.withColumn("following", F.lead("mine").over(order)).filter("ghost = 0")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex(F.col("mine")).alias("fingerprint"),
        as_hex(F.col("theirs")).alias("edited_fingerprint"),
        likeness(F.col("mine"), F.col("theirs")).alias("near_edited"),
        likeness(F.col("mine"), F.col("following")).alias("near_next"),
    )
