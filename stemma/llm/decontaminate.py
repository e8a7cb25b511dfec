"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts become templates: numbers, units of measure and names (capitalised words, wherever they stand)
turn into typed placeholders, other words into lower case. Windows of WINDOW template words of the
benchmark are joined by hash with those of the documents; a document that has enough of an item's
windows is lined up with it, and the values in the placeholders must correspond: one value of the
item stands for one value of the document, and most values of the document for one of the item. So a
question with other numbers or names is found, and a text that shares only the wording around them in
a jumbled way is not.

A document may hold several variants of one question, each with values of its own. Matches of one copy
lie at one distance between their places in text and item (within SHIFT words), so the matches are
cut into copies by this distance, and each copy is tested alone, besides all of them together.

Windows of the plain lower-case words are joined alike. They find copies in capitals or lower case,
where names can't be told, and they are the exact way for items whose template says too little: an
item with fewer than two usable template windows is found by all of its words in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_row, checkpoint, small

WINDOW = 8
#: Words of a template window that must be no placeholders.
LEAST_CONSTANT = 4
#: Words that an item must have to be looked for at all: one word is no question.
LEAST_WORDS = 2
#: Share of an item's windows that a document must have.
COVERAGE = 0.5
#: Distinct item values per distinct pair of item and document value, at least.
CONSISTENCY = 0.75
#: Distinct document values per distinct pair, at least: less, since different values of an item may well become equal.
REVERSE_CONSISTENCY = 0.6
#: Words by which a copy may be shifted within itself, by words put in or left out.
SHIFT = 4
#: The benchmark's windows are broadcast up to this many, and joined by a shuffle beyond; so are the documents to line up.
BROADCAST_ROWS = 500_000

#: Units of measure (fixed values).
UNITS = "km m cm mm mi mile miles ft feet inch inches yd yards kg g mg lb lbs pounds oz ounces l ml litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cents percent kmh mph celsius fahrenheit kelvin watt watts volt volts joule joules newton newtons hz khz mhz ghz kb mb gb tb".split()

_TOKEN = r"\p{L}[\p{L}\p{M}]*|\p{N}+(?:[.,]\p{N}+)*|[%$€£]"
_NAME = r"^\p{Lu}[\p{L}\p{M}&&[^\p{Lu}]]+$"
_NUMBER, _UNIT, _ITEM_NAME = -1, -2, -3
TEMPLATE, PLAIN = 0, 1


def tokens(text: Column) -> Column:
    """The words, numbers and unit signs of a text, in order."""
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _coded(t: Column, plain: Column) -> Column:
    """The code of a token in a template; plain: the hash of its lower case. Placeholders are the codes from -3 to -1."""
    unit = plain.isin(*(F.xxhash64(F.lit(u)) for u in [*UNITS, "%", "$", "€", "£"]))
    # digits come before letters; other scripts' digits are looked for only behind them
    number = (t < ":") | ((t > "{") & t.rlike(r"^\p{N}"))
    name = (F.xxhash64(t) != plain) & t.rlike(_NAME)
    return F.when(unit, _UNIT).when(number, _NUMBER).when(name, _ITEM_NAME).otherwise(plain).cast("long")


def _with_windows(rows: DataFrame, sizes: dict[int, set[int]]) -> tuple[DataFrame, dict[tuple[int, int], str]]:
    """Adds the hashes of all windows of the asked sizes, by kind (TEMPLATE or PLAIN), from the column ``words``.

    A window's hash is put together from those of windows half its size, so all sizes share their
    parts. Gives the frame and the name of each kind's and size's column.
    """
    rows = rows.withColumn("w1", F.transform("words", lambda t: F.xxhash64(F.lower(t)))).withColumn("n", F.size("words"))
    rows = rows.withColumn("t1", F.zip_with("words", "w1", _coded))
    names: dict[tuple[int, int], str] = {}

    def of(kind: int, size: int) -> str:
        nonlocal rows
        name = f"{'tw'[kind]}{size}"
        if size > 1 and (kind, size) not in names:
            half = 1 << ((size - 1).bit_length() - 1)
            a, b = F.col(of(kind, half)), F.col(of(kind, size - half))
            rows = rows.withColumn(name, F.when(F.col("n") >= size, F.zip_with(F.slice(a, 1, F.col("n") - (size - 1)), F.slice(b, half + 1, F.col("n") - (size - 1)), lambda x, y: F.xxhash64(F.lit(kind), x, y))).otherwise(F.array().cast("array<bigint>")))
        names[kind, size] = name
        return name

    for kind, asked in sizes.items():
        for size in sorted(asked):
            of(kind, size)
    return rows, names


def not_looked_for(benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """item_id, n_words of the items that have too few words to be evidence, nulls and empty ones included: no document is reported for them."""
    n = F.size(tokens(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("n_words")
    return benchmark.select("item_id", n).filter(F.col("n_words") < least_words)


def _items(benchmark: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return benchmark.select(F.xxhash64("item_id", text).alias("item"), "item_id", tokens(text).alias("words")).dropDuplicates(["item"])


def item_windows(benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """item, kind, size, place, hash of each distinct window of each item, n_windows of its kind, and how many must be found.

    An item shorter than a window is one window of its own length. Template windows with fewer than
    LEAST_CONSTANT constant words are left out. Null and empty items, and those of fewer than
    ``least_words`` words, have none. item is the hash of an item's id and text.
    """
    items = _items(benchmark).filter(F.size("words") >= least_words)
    sizes = set(range(min(least_words, WINDOW), WINDOW + 1))
    items, names = _with_windows(items, {TEMPLATE: sizes, PLAIN: sizes})
    size = F.least(F.lit(WINDOW), F.col("n"))
    one = None
    for kind in (TEMPLATE, PLAIN):
        hashes = F.coalesce(*(F.when(size == s, F.col(names[kind, s])) for s in sorted(sizes)))
        part = items.select("item", F.lit(kind).alias("kind"), size.alias("size"), "t1", F.posexplode(hashes).alias("place", "hash"))
        one = part if one is None else one.union(part)
    constant = F.size(F.filter(F.slice("t1", F.col("place") + 1, F.col("size")), lambda x: ~x.between(_ITEM_NAME, _NUMBER)))
    one = one.filter((F.col("kind") == PLAIN) | (constant >= LEAST_CONSTANT)).groupBy("item", "kind", "size", "hash").agg(F.min("place").alias("place"))
    one = checkpoint(one)
    n = one.groupBy("item").agg(F.count(F.when(F.col("kind") == TEMPLATE, 1)).alias("templates"), F.count(F.when(F.col("kind") == PLAIN, 1)).alias("plains"))
    total = F.when(F.col("kind") == TEMPLATE, F.col("templates")).otherwise(F.col("plains"))
    share = F.when((F.col("kind") == PLAIN) & (F.col("templates") < 2), 1.0).otherwise(COVERAGE)
    return one.join(n, "item").select("item", "kind", "size", "place", "hash", total.alias("n_windows"), F.ceil(total * share).alias("least"))


def _copies(hits: DataFrame) -> DataFrame:
    """The hits, and beside each template hit its copies: matches at one distance between text and item."""
    one = hits.filter(F.col("kind") == TEMPLATE).select("row_id", "item", "kind", "n_windows", "least", F.explode("matches").alias("m")).withColumn("far", F.col("m.at") - F.col("m.place"))
    by = Window.partitionBy("row_id", "item").orderBy("far")
    one = one.withColumn("new", F.coalesce(F.col("far") - F.lag("far").over(by) > SHIFT, F.lit(False)).cast("int")).withColumn("copy", F.sum("new").over(by))
    parts = one.groupBy("row_id", "item", "kind", "copy").agg(F.count_distinct("m.place").alias("n_matched"), F.first("n_windows").alias("n_windows"), F.first("least").alias("least"), F.collect_list("m").alias("matches"))
    return hits.unionByName(parts.filter("n_matched >= least").select(*hits.columns))


def contaminated(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """row_id, doc_id, item_id, n_matched, n_windows, coverage, consistency of each document and item it contains.

    row_id is the hash of doc_id and text. Null and empty texts contain nothing; repeated rows give
    one row; an empty table on either side gives no rows. Several copies of a passage in one text,
    variants with other values among them, give one row, that of the copy that is found best. Items of
    fewer than ``least_words`` words are those of ``not_looked_for``. Items with equal texts are all reported, and texts that share an item_id as one. A
    document that holds an item both as a template and in plain words is reported by its words. Other columns are ignored.
    """
    items = checkpoint(item_windows(benchmark, least_words))
    kinds = items.select("kind", "size").distinct().collect()  # at most two for each size of window
    sizes = {kind: {r["size"] for r in kinds if r.kind == kind} for kind in (TEMPLATE, PLAIN)}
    rows = docs.select(F.xxhash64("doc_id", F.col("text").cast("string")).alias("row_id"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cut, names = _with_windows(rows.select("row_id", tokens(F.col("text")).alias("words")), sizes)
    asked = [(kind, size) for kind in sizes for size in sorted(sizes[kind])]
    length = lambda size: F.greatest(F.col("n") - (size - 1), F.lit(0))
    every = F.flatten(F.array(*(F.col(names[k]) for k in asked))) if asked else F.array().cast("array<bigint>")
    # an outer explode, as Spark guards a plain one by the array's size, for which it would be computed twice
    found = cut.select("row_id", "n", F.posexplode_outer(every).alias("at", "hash"))
    met = found.join(small(items, BROADCAST_ROWS), "hash")
    # a window's place in its text: its place among all windows, less the windows of the kinds and sizes before
    before = reduce(lambda out, i: out.when((F.col("kind") == asked[i][0]) & (F.col("size") == asked[i][1]), sum((length(s) for _, s in asked[:i]), F.lit(0))), range(len(asked)), F.when(F.lit(False), 0))
    met = met.select("row_id", "item", "kind", "size", "n_windows", "least", "hash", "place", (F.col("at") - before).alias("at"))
    hits = met.groupBy("row_id", "item", "kind").agg(F.size(F.collect_set("hash")).cast("long").alias("n_matched"), F.first("n_windows").alias("n_windows"), F.first("least").alias("least"), F.collect_set(F.struct("place", "at", "size")).alias("matches"))
    hits = checkpoint(hits.filter("n_matched >= least"))

    # line up: the values in the placeholders, for these pairs alone
    chosen = rows.join(small(checkpoint(hits.select("row_id").distinct()), BROADCAST_ROWS), "row_id").dropDuplicates(["row_id"]).select("row_id", "doc_id", tokens(F.col("text")).alias("dt"))
    values = _items(benchmark).withColumnRenamed("words", "bt")
    lined = _copies(hits).join(small(values, BROADCAST_ROWS), "item").join(chosen, "row_id")

    def cells(match: Column) -> Column:
        both = F.arrays_zip(F.slice("bt", match["place"] + 1, match["size"]).alias("b"), F.slice("dt", match["at"] + 1, match["size"]).alias("d"))
        slots = F.filter(both, lambda x: _coded(x["b"], F.xxhash64(F.lower(x["b"]))).between(_ITEM_NAME, _NUMBER))
        return F.transform(slots, lambda x: F.struct(F.lower(x["b"]).alias("b"), F.lower(x["d"]).alias("d")))

    pairs = F.array_distinct(F.flatten(F.transform("matches", cells)))
    lined = lined.select("row_id", "doc_id", "item_id", "kind", "n_matched", "n_windows", F.when(F.col("kind") == TEMPLATE, pairs).alias("pairs"))
    agreed = lambda end: F.when(F.size("pairs") > 0, F.size(F.array_distinct(F.transform("pairs", lambda x: x[end]))) / F.size("pairs")).otherwise(1.0)
    lined = lined.withColumn("consistency", agreed("b")).filter((F.col("consistency") >= CONSISTENCY) & (agreed("d") >= REVERSE_CONSISTENCY))
    best = lined.groupBy("row_id", "item_id").agg(F.max(F.struct("kind", "n_matched", "n_windows", "consistency", "doc_id")).alias("x"))
    return best.select("row_id", "x.doc_id", "item_id", "x.n_matched", "x.n_windows", (F.col("x.n_matched") / F.col("x.n_windows")).alias("coverage"), "x.consistency")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that contain no benchmark item.

    Null and empty texts stay, repeated rows stay or go together, and an empty benchmark drops nothing.
    """
    bad = checkpoint(contaminated(docs, benchmark).select("row_id").distinct())
    rows = docs.select(as_row(docs), F.xxhash64("doc_id", F.col("text").cast("string")).alias("row_id"))
    return rows.join(small(bad, BROADCAST_ROWS), "row_id", "left_anti").select("row.*")
