"""Documents as ordered, typed, content-addressed units with section paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

FRONTMATTER = "__FRONTMATTER__"
#: In plain text a line of at most so many characters counts as a heading; its level is its number of words, up to LEVELS.
HEADING_CHARS = 40
LEVELS = 3
PATH_CHARS = 64



def by_doc():
    """A document's units in order."""
    return Window.partitionBy("doc_id").orderBy("para_index")


def so_far():
    return by_doc().rowsBetween(Window.unboundedPreceding, 0)


def units(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, para_index, text_norm, kind (hdr or p), level of each line with text."""
    lines = docs.select("doc_id", "source", "lang", F.posexplode_outer(F.split("text", "\n", -1)).alias("para_index", "raw"))
    one = lines.select("doc_id", "source", "lang", "para_index", T.collapse_space(F.col("raw")).alias("text_norm")).filter("text_norm <> ''")
    heading = F.length("text_norm") <= HEADING_CHARS
    level = F.least(F.lit(LEVELS), T.word_count(F.col("text_norm")))
    return one.withColumn("kind", F.when(heading, "hdr").otherwise("p")).withColumn("level", F.when(heading, level))


def last_at(level: int) -> Column:
    """The place of the latest heading of a level up to here, or -1."""
    return F.coalesce(F.max(F.when(F.col("level") == level, F.col("para_index"))).over(so_far()), F.lit(-1))


def with_sections(frame: DataFrame) -> DataFrame:
    """Adds section_path: a heading closes all headings of its level or deeper, so the path holds the open ones.

    Expressed without a stack: the latest heading of a level is open if no shallower one came after it.
    """
    for k in range(1, LEVELS + 1):
        frame = frame.withColumn(f"_at{k}", last_at(k))
        frame = frame.withColumn(f"_h{k}", F.last(F.when(F.col("level") == k, F.col("text_norm")), ignorenulls=True).over(so_far()))
    open_ = []
    for k in range(1, LEVELS + 1):
        test = F.col(f"_at{k}") >= 0
        for j in range(1, k):
            test = test & (F.col(f"_at{k}") > F.col(f"_at{j}"))
        open_.append(F.when(test, F.col(f"_h{k}")))
    path = F.array_join(F.array_compact(F.array(*open_)), "/")
    drop = [f"_{x}{k}" for k in range(1, LEVELS + 1) for x in ("at", "h")]
    return frame.withColumn("section_path", F.when(path == "", FRONTMATTER).otherwise(path)).drop(*drop)


def anchor_hash(text_norm: Column, section_path: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", text_norm, F.substring(section_path, 1, PATH_CHARS)), 256), 1, 16)


def anchors(frame: DataFrame) -> DataFrame:
    """Adds ordinal (per section and kind), text_hash and anchor_id; equal ids get :v2, :v3 in document order."""
    frame = frame.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id", "section_path", "kind").orderBy("para_index")))
    frame = frame.withColumn("text_hash", F.sha2("text_norm", 256))
    frame = frame.withColumn("_base", F.concat_ws(":", F.col("doc_id").cast("string"), "kind", anchor_hash(F.col("text_norm"), F.col("section_path"))))
    n = F.row_number().over(Window.partitionBy("doc_id", "_base").orderBy("para_index"))
    frame = frame.withColumn("_n", n)
    return frame.withColumn("anchor_id", F.when(F.col("_n") > 1, F.concat("_base", F.lit(":v"), F.col("_n").cast("string"))).otherwise(F.col("_base"))).drop("_base", "_n")


def blocks(frame: DataFrame) -> DataFrame:
    """Adds block_no: every heading opens a block; what comes before the first is block 0."""
    return frame.withColumn("block_no", F.sum(F.when(F.col("kind") == "hdr", 1).otherwise(0)).over(so_far()))


def block_ends(frame: DataFrame) -> DataFrame:
    """The headings with end_index, the place of the next heading that is not deeper (null at the document's end)."""
    ahead = by_doc().rowsBetween(1, Window.unboundedFollowing)
    end = F.lit(None).cast("int")
    for level in range(1, LEVELS + 1):
        least = F.min(F.when(F.col("level") <= level, F.col("para_index"))).over(ahead)
        end = F.when(F.col("level") == level, least).otherwise(end)
    return frame.withColumn("end_index", end).filter("kind = 'hdr'")
