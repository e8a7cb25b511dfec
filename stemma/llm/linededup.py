"""Line dedup by a log-template tree, in DataFrame functions only.

Lines fall into leaves of a tree of fixed depth: by their number of tokens, then by their leading
tokens, in which anything with a digit is a variable field. The tokens after those are cut into
SEGMENTS runs. Of all lines of a leaf, and of those that share a run, the commonest is the seed; a
line joins the commonest seed it meets with which it agrees in enough places, and a seed that joins
another takes its lines along, so a leaf holds as many templates as it has families of lines.

A template recurs if it stands in enough documents. Copies count as one document, and a document
counts only if enough of it is its own: one made up of repeated lines is a near copy of others,
which is another stage's work. Every occurrence of a recurring template is dropped but its first,
by doc_id and place (and the same place in copies of that document, so that copies stay copies).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_row, checkpoint, small, without

#: Leading tokens that the tree looks at.
DEPTH = 3
#: Runs of tokens by which lines of a leaf meet: two lines that differ in fewer places always share one.
SEGMENTS = 4
#: Tenths of all tokens in which a line agrees with its seed, at least.
SIMILARITY = 7
#: Documents, copies apart, in which a template must stand.
LEAST_DOCUMENTS = 3
#: A document counts if at least one in so many of its characters stands in lines that fewer than LEAST_DOCUMENTS
#: share. Near copies with a similarity of 0.75 differ in at most a seventh of each, and so don't count.
LEAST_OWN = 6
FIELD = "<*>"
#: Tables of keys are broadcast up to this many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 300_000


def masked_lines(text: Column) -> Column:
    """The lines of a text with single spaces between tokens, and every token with a digit a variable field; lower case.

    What can be done to the whole text at once is done before it is split: in a function over an
    array's elements nothing is shared between its parts.
    """
    low = F.lower(text)
    loose = text.contains("  ") | text.contains("\t") | text.contains("\r") | text.contains("\x0b") | text.contains("\x0c")
    tidy = F.when(loose, F.regexp_replace(low, r"[\x09\x0B-\x0D\x20]+", " ")).otherwise(low)
    return F.transform(F.transform(F.split(tidy, "\n", -1), F.trim), lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, r"[^ ]*[0-9][^ ]*", FIELD)).otherwise(x))


def _tokens(masked: Column) -> Column:
    return F.length(masked) - F.length(F.replace(masked, F.lit(" "), F.lit(""))) + 1


def _keys(masked: Column) -> tuple[Column, Column]:
    """The leaf and the line key of a masked line; two lines are one kind if both are equal."""
    return F.xxhash64(_tokens(masked), F.substring_index(masked, " ", DEPTH)).alias("leaf"), F.xxhash64(masked).alias("line")


def places(rows: DataFrame) -> DataFrame:
    """row_id, doc_id, copy, place, chars, leaf, line of each line that has a token; copy: equal for texts with equal masked lines."""
    # an outer explode, as Spark guards a plain one by the array's size, for which it would be computed twice
    masked = rows.select("row_id", "doc_id", masked_lines(F.col("text")).alias("m"))
    one = masked.select("row_id", "doc_id", F.xxhash64("m").alias("copy"), F.posexplode_outer("m").alias("place", "masked")).filter("masked <> ''")
    return one.select("row_id", "doc_id", "copy", "place", F.length("masked").alias("chars"), *_keys(F.col("masked")))


def kinds_of(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """leaf, line, n, masked of the kinds of line in leaves that hold several; only their text is looked at."""
    several = lines.groupBy("leaf").agg(F.min("line").alias("a"), F.max("line").alias("b")).filter("a <> b").select("leaf")
    text = rows.select(F.explode_outer(masked_lines(F.col("text"))).alias("masked")).filter("masked <> ''").select(*_keys(F.col("masked")), "masked")
    return text.join(small(checkpoint(several), BROADCAST_ROWS), "leaf").groupBy("leaf", "line").agg(F.count("*").alias("n"), F.first("masked").alias("masked"))


def joins(kinds: DataFrame) -> DataFrame:
    """leaf, line, template of each kind of line that joins another; template: the line key of the one it joins."""
    after = F.size("parts") - DEPTH
    begin = lambda s: F.ceil(after * s / SEGMENTS).cast("int")
    runs = [F.when(begin(s + 1) > begin(s), F.struct(F.lit(s).alias("run"), F.xxhash64(F.slice("parts", begin(s) + DEPTH + 1, begin(s + 1) - begin(s))).alias("of"))) for s in range(SEGMENTS)]
    met = F.array_compact(F.array(F.struct(F.lit(-1).alias("run"), F.lit(0).cast("long").alias("of")), *runs))
    keyed = kinds.withColumn("parts", F.split("masked", " ")).select("leaf", "line", "n", "masked", F.explode(met).alias("at")).select("leaf", "line", "n", "masked", "at.*")
    seeds = keyed.groupBy("leaf", "run", "of").agg(F.max(F.struct("n", "masked", "line")).alias("seed"), F.count("*").alias("k")).filter("k > 1").drop("k")
    agree = F.size(F.filter(F.zip_with(F.split("masked", " "), F.split("seed.masked", " "), lambda x, y: x == y), lambda t: t))
    near = keyed.join(seeds, ["leaf", "run", "of"]).filter("line <> seed.line").filter((10 * agree >= SIMILARITY * _tokens(F.col("masked"))) & (F.struct("n", "masked") < F.struct("seed.n", "seed.masked")))
    up = checkpoint(near.groupBy("leaf", "line").agg(F.max("seed").alias("seed")).select("leaf", "line", F.col("seed.line").alias("template")))
    while True:  # a seed that joins another takes its lines along; each step halves the way up
        above = up.select("leaf", F.col("line").alias("template"), F.col("template").alias("top"))
        if up.join(above, ["leaf", "template"], "left_semi").isEmpty():
            return up
        up = checkpoint(up.join(above, ["leaf", "template"], "left").select("leaf", "line", F.coalesce("top", "template").alias("template")))


def recurring(of: DataFrame) -> DataFrame:
    """leaf, template of each template that stands in LEAST_DOCUMENTS documents of which enough is their own."""
    # one row per template and document before anything meets by template alone
    pairs = checkpoint(of.groupBy("leaf", "template", "copy").agg(F.sum("chars").alias("chars")))
    many = checkpoint(pairs.groupBy("leaf", "template").agg(F.count("*").alias("k")).filter(F.col("k") >= LEAST_DOCUMENTS).select("leaf", "template"))
    shared = checkpoint(pairs.join(small(many, BROADCAST_ROWS), ["leaf", "template"]))
    total = of.groupBy("copy").agg(F.sum("chars").alias("total"))
    own = shared.groupBy("copy").agg(F.sum("chars").alias("again")).join(total, "copy").filter((F.col("total") - F.col("again")) * LEAST_OWN >= F.col("total")).select("copy")
    seen = shared.join(own, "copy").groupBy("leaf", "template").agg(F.count("*").alias("k")).filter(F.col("k") >= LEAST_DOCUMENTS)
    return checkpoint(seen.select("leaf", "template"))


def dropped_places(rows: DataFrame) -> DataFrame:
    """row_id, doc_id and the places of the lines that go, of each of ``rows`` (row_id, doc_id, text) that loses any."""
    lines = checkpoint(places(rows))
    joined = small(checkpoint(joins(checkpoint(kinds_of(rows, lines)))), BROADCAST_ROWS)
    # a line that joins no other is a template of its own
    of = lines.join(joined, ["leaf", "line"], "left").withColumn("template", F.coalesce("template", "line")).drop("line")
    again = recurring(of)
    gone = checkpoint(of.join(small(again, BROADCAST_ROWS), ["leaf", "template"]))
    first = gone.groupBy("leaf", "template").agg(F.min(F.struct("doc_id", "copy", "place")).alias("first"))
    out = gone.join(small(first, BROADCAST_ROWS), ["leaf", "template"]).filter("copy <> first.copy OR place <> first.place")
    return out.groupBy("row_id", "doc_id").agg(F.collect_set("place").alias("drop"))


def drop_recurring_lines(docs: DataFrame, counts: bool = True) -> DataFrame:
    """All columns of ``docs`` with the recurring lines taken out of ``text``; then n_lines and n_dropped if ``counts``.

    ``n_chars``, if there, is counted anew. Null and empty texts stay as they are, and blank lines
    stay in their places. A template keeps its first occurrence, so some document always has it. A
    document that would be left without a line stays whole. Repeated rows count as one document; rows
    with equal or null doc_id but different texts are documents of their own. An input column named
    n_lines or n_dropped gives way to the count, or stays without ``counts``; other columns of any
    name stay. An empty table gives no rows.
    """
    text = F.col("text").cast("string")
    rows = docs.select(as_row(docs), "doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("row_id"))
    out = dropped_places(rows.select("row_id", "doc_id", "text")).toDF("_row_id", "_doc_id", "drop")
    full = rows.join(out, F.col("row_id").eqNullSafe(F.col("_row_id")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")), "left")
    parts = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("drop", i)), "\n")
    full = full.withColumn("kept", F.when(F.col("drop").isNotNull(), kept))
    cut = F.coalesce(F.col("kept").rlike(r"[^\x09-\x0D\x20]"), F.lit(False))
    full = full.select("row", F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), F.when(cut, F.size("drop")).otherwise(0).cast("long").alias("n_dropped"), F.when(cut, F.col("kept")).otherwise(F.col("text")).alias("text"))
    new = {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    names = without(docs.columns, "n_lines", "n_dropped") if counts else docs.columns
    return full.select(*(new.get(c, F.col("row")[c]).alias(c) for c in names), *(["n_lines", "n_dropped"] if counts else []))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_chars and kept_sha256 of every document after line dedup.

    Null and empty texts have no characters; all rows come back, repeated ones too, and other
    columns are ignored. An empty table gives no rows.
    """
    done = drop_recurring_lines(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    return done.select("doc_id", "n_lines", "n_dropped", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
