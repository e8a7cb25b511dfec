"""Units, sections, blocks and other ordered computation over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import units as U
from .base import ANCHOR, SECTION, UNIT, anchors, sections, units
from .registry import Registry, table

R = Registry()


@R.query("s02_section_paths", f"WITH {SECTION} SELECT doc_id, para_index, kind, section_path FROM section")
def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading stack to section paths, with the frontmatter pseudo-section."""
    return sections(spark, sf_dir).select("doc_id", "para_index", "kind", "section_path")


@R.query("w01_anchor_ids", f"WITH {ANCHOR} SELECT doc_id, para_index, kind, ordinal, text_hash, anchor_id FROM anchor")
def anchor_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals, hashes and collision suffixes."""
    return anchors(spark, sf_dir).select("doc_id", "para_index", "kind", "ordinal", "text_hash", "anchor_id")


@R.query(
    "w03_heading_blocks",
    f"""WITH {UNIT}, b AS (SELECT *, sum(CASE WHEN kind = 'hdr' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY para_index) AS block_no FROM unit)
    SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, max(CASE WHEN kind = 'hdr' THEN text_norm END) AS heading, count(*) FILTER (kind = 'p') AS paragraphs,
           CAST(sum(length(text_norm)) AS BIGINT) AS chars FROM b WHERE block_no > 0 GROUP BY doc_id, block_no""",
)
def heading_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each heading with the paragraphs that follow it."""
    b = U.blocks(units(spark, sf_dir)).filter("block_no > 0")
    return b.groupBy("doc_id", "block_no").agg(F.max(F.when(F.col("kind") == "hdr", F.col("text_norm"))).alias("heading"), F.count_if(F.col("kind") == "p").alias("paragraphs"), F.sum(F.length("text_norm")).alias("chars"))


@R.query(
    "w04_block_ends",
    f"WITH {UNIT} SELECT h.doc_id, h.para_index, h.level, (SELECT min(n.para_index) FROM unit n WHERE n.doc_id = h.doc_id AND n.para_index > h.para_index AND n.level <= h.level) AS end_index FROM unit h WHERE h.kind = 'hdr'",
)
def block_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading's block reaches to the next heading that is not deeper."""
    return U.block_ends(units(spark, sf_dir)).select("doc_id", "para_index", "level", "end_index")


@R.query(
    "w06_context_packing",
    f"""WITH {UNIT}, r AS (SELECT doc_id, para_index, sum(length(text_norm) + 2) OVER (PARTITION BY doc_id ORDER BY para_index) AS total FROM unit)
    SELECT doc_id, count(*) AS packed, CAST(max(total) AS BIGINT) AS chars FROM r WHERE total <= 600 GROUP BY doc_id""",
)
def context_packing(spark: SparkSession, sf_dir: str, limit: int = 600) -> DataFrame:
    """Units in order up to a number of characters, stopping at the first that doesn't fit."""
    total = F.sum(F.length("text_norm") + 2).over(U.so_far())
    return units(spark, sf_dir).select("doc_id", total.alias("total")).filter(F.col("total") <= limit).groupBy("doc_id").agg(F.count("*").alias("packed"), F.max("total").alias("chars"))


@R.query(
    "w08_monotone_values",
    "SELECT event_id, user_id, nxt AS next_event FROM (SELECT event_id, user_id, value, lead(value) OVER w AS nv, lead(event_id) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE nv < value",
)
def monotone_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in time whose value falls."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.lead("value").over(w).alias("nv"), F.lead("event_id").over(w).alias("next_event"))
    return rows.filter("nv < value").select("event_id", "user_id", "next_event")


@R.query(
    "w09_first_use",
    f"""WITH {UNIT}, t AS (SELECT doc_id, para_index, unnest(list_distinct(regexp_extract_all(text_norm, '[A-Z]{{2,6}}'))) AS abbr FROM unit)
    SELECT doc_id, abbr, min(para_index) AS first_use, count(*) AS uses FROM t GROUP BY doc_id, abbr""",
)
def first_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each capital abbreviation is first used in its document."""
    t = units(spark, sf_dir).select("doc_id", "para_index", F.explode(F.array_distinct(F.regexp_extract_all("text_norm", F.lit("[A-Z]{2,6}"), F.lit(0)))).alias("abbr"))
    return t.groupBy("doc_id", "abbr").agg(F.min("para_index").alias("first_use"), F.count("*").alias("uses"))


@R.query(
    "w10_following_items",
    f"""WITH {UNIT}, n AS (SELECT *, lead(kind, 1) OVER w AS k1, lead(kind, 2) OVER w AS k2, lead(kind, 3) OVER w AS k3, lead(text_norm, 1) OVER w AS t1, lead(text_norm, 2) OVER w AS t2, lead(text_norm, 3) OVER w AS t3
      FROM unit WINDOW w AS (PARTITION BY doc_id ORDER BY para_index))
    SELECT doc_id, para_index, concat_ws('|', CASE WHEN k1 = 'p' THEN t1 END, CASE WHEN k1 = 'p' AND k2 = 'p' THEN t2 END, CASE WHEN k1 = 'p' AND k2 = 'p' AND k3 = 'p' THEN t3 END) AS items
    FROM n WHERE kind = 'hdr'""",
)
def following_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three paragraphs after a heading, ending at the next heading."""
    ahead = F.collect_list(F.struct("kind", "text_norm")).over(U.by_doc().rowsBetween(1, 3))
    rows = units(spark, sf_dir).withColumn("ahead", ahead).filter("kind = 'hdr'")
    stop = F.array_position(F.transform("ahead", lambda x: x["kind"]), "hdr")
    items = F.when(stop == 0, F.col("ahead")).otherwise(F.slice("ahead", 1, (stop - 1).cast("int")))
    return rows.select("doc_id", "para_index", F.array_join(F.transform(items, lambda x: x["text_norm"]), "|").alias("items"))


@R.query(
    "w11_first_block_members",
    f"""WITH {UNIT}, b AS (SELECT *, sum(CASE WHEN kind = 'hdr' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY para_index) AS block_no FROM unit),
    f AS (SELECT doc_id, min(block_no) AS block_no FROM b WHERE kind = 'hdr' AND level >= 2 GROUP BY doc_id)
    SELECT b.doc_id, b.para_index FROM b JOIN f USING (doc_id, block_no) WHERE kind = 'p'""",
)
def first_block_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs between the first matching heading and the next heading."""
    b = U.blocks(units(spark, sf_dir))
    first = F.min(F.when((F.col("kind") == "hdr") & (F.col("level") >= 2), F.col("block_no"))).over(Window.partitionBy("doc_id"))
    return b.withColumn("first", first).filter("kind = 'p' AND block_no = first").select("doc_id", "para_index")


@R.query(
    "w12_preceding_context",
    f"""WITH {UNIT} SELECT doc_id, para_index, CAST(coalesce(len(list(text_norm) OVER w), 0) AS INT) AS n_before, CAST(coalesce(sum(length(text_norm)) OVER w, 0) AS BIGINT) AS chars_before
    FROM unit WINDOW w AS (PARTITION BY doc_id ORDER BY para_index ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""",
)
def preceding_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six units before each unit."""
    w = U.by_doc().rowsBetween(-6, -1)
    return units(spark, sf_dir).select("doc_id", "para_index", F.size(F.collect_list("text_norm").over(w)).alias("n_before"), F.coalesce(F.sum(F.length("text_norm")).over(w), F.lit(0)).alias("chars_before"))


@R.query(
    "w13_heading_preview",
    f"""WITH {UNIT} SELECT doc_id, para_index, left(coalesce(array_to_string((list(CASE WHEN kind = 'p' THEN text_norm END) OVER w)[1:2], ' '), ''), 300) AS preview
    FROM unit WINDOW w AS (PARTITION BY doc_id ORDER BY para_index ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) QUALIFY kind = 'hdr'""",
)
def heading_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs among the two units after a heading, 300 characters."""
    near = F.collect_list(F.when(F.col("kind") == "p", F.col("text_norm"))).over(U.by_doc().rowsBetween(1, 2))
    return units(spark, sf_dir).withColumn("near", near).filter("kind = 'hdr'").select("doc_id", "para_index", F.left(F.array_join("near", " "), F.lit(300)).alias("preview"))


@R.query(
    "w14_latest_run",
    "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest run of each version, by a partial maximum instead of a sort."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("r"))
    return last.select("user_id", "r.event_id", "r.event_type", "r.value")


@R.query(
    "a15_mode_first_seen",
    f"""WITH {UNIT}, c AS (SELECT doc_id, kind, coalesce(level, 0) AS level, count(*) AS n, min(para_index) AS seen FROM unit GROUP BY ALL)
    SELECT doc_id, kind, level, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, seen) AS r FROM c) WHERE r = 1""",
)
def mode_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest (kind, level) of a document, ties to the first seen."""
    c = units(spark, sf_dir).groupBy("doc_id", "kind", F.coalesce("level", F.lit(0)).alias("level")).agg(F.count("*").alias("n"), F.min("para_index").alias("seen"))
    best = c.groupBy("doc_id").agg(F.max_by(F.struct("kind", "level", "n"), F.struct("n", -F.col("seen"))).alias("m"))
    return best.select("doc_id", "m.kind", "m.level", "m.n")


@R.query(
    "j05_following_rows",
    f"""WITH {UNIT} SELECT doc_id, para_index, CAST(coalesce(len(list(para_index) OVER w), 0) AS INT) AS n_following,
           array_to_string(list(kind) OVER w, ',') AS kinds FROM unit WINDOW w AS (PARTITION BY doc_id ORDER BY para_index ROWS BETWEEN 1 FOLLOWING AND 50 FOLLOWING) QUALIFY kind = 'hdr'""",
)
def following_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows after each heading, fifty at most, gathered in order."""
    ahead = F.collect_list("kind").over(U.by_doc().rowsBetween(1, 50))
    rows = units(spark, sf_dir).withColumn("ahead", ahead).filter("kind = 'hdr'")
    return rows.select("doc_id", "para_index", F.size("ahead").alias("n_following"), F.when(F.size("ahead") > 0, F.array_join("ahead", ",")).alias("kinds"))


@R.query(
    "j06_heading_corpus",
    f"""WITH {UNIT}, ready AS (SELECT doc_id FROM labels WHERE quality = 1), h AS (SELECT u.* FROM unit u JOIN ready USING (doc_id) WHERE kind = 'hdr'),
    win AS (SELECT doc_id, para_index, count(*) OVER w AS n, CAST(coalesce(sum(length(text_norm)) OVER w, 0) AS BIGINT) AS chars FROM unit WINDOW w AS (PARTITION BY doc_id ORDER BY para_index ROWS BETWEEN 1 FOLLOWING AND 50 FOLLOWING))
    SELECT h.doc_id, h.para_index, h.text_norm AS heading, win.n AS window_rows, win.chars AS window_chars FROM h JOIN win USING (doc_id, para_index)""",
)
def heading_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready versions, their headings, and statistics of the window after each."""
    ready = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    docs = table(spark, sf_dir, "documents").join(ready, "doc_id", "left_semi")  # versions go before their units are made
    w = U.by_doc().rowsBetween(1, 50)
    rows = U.units(docs).withColumn("window_rows", F.count("*").over(w)).withColumn("window_chars", F.coalesce(F.sum(F.length("text_norm")).over(w), F.lit(0)))
    return rows.filter("kind = 'hdr'").select("doc_id", "para_index", F.col("text_norm").alias("heading"), "window_rows", "window_chars")


@R.query(
    "f09_token_estimate",
    f"""WITH {UNIT} SELECT doc_id, count(*) AS units, CAST(sum(greatest(1, CAST(floor(length(text_norm) / 4) AS INT))) AS BIGINT) AS tokens, CAST(sum(len(regexp_extract_all(lower(text_norm), '[a-z0-9]+|[^\\sa-z0-9]'))) AS BIGINT) AS marks FROM unit GROUP BY doc_id""",
)
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """estimated and counted tokens of each document."""
    t = F.col("text_norm")
    return units(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("units"), F.sum(T.token_estimate(t)).alias("tokens"), F.sum(F.size(T.tokens(t))).alias("marks"))


QUERIES, ORACLE_SQL = R.queries, R.sql
