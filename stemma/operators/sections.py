"""Section maps: the units of each document that make up each section a contract describes.

Contracts are a small dimension known to the driver, so headings are scored against all of them in one
projection. The best heading of each (document, contract) takes the block below it, up to the next
heading that isn't deeper. A unit that several sections claim stays with the surest. Maps that a user
has overridden are left alone unless a rebuild is forced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import units as U

#: Score that a heading must reach, and confidence from which a map needs no review.
LEAST_SCORE, SURE = 2, 0.7
#: The limit for a document's headings by how rich it is: many headings, few, and others (fixed values: 4, 2, 3).
RICH_HEADINGS, RICH_SCORE = 30, 4
SPARSE_HEADINGS, SPARSE_SCORE = 5, 2
USUAL_SCORE = 3
#: Confidence that a map by a heading under its document's limit can have at most.
SECOND_PASS = 0.5
MAP = "doc_id long, section string, heading string, anchor_ids array<string>, confidence double, status string, mapped_by string, notes string"


@dataclass(frozen=True)
class Contract:
    """What a section's heading must, should and should not hold, and a pattern for it; terms are matched in lower case."""

    section: str
    must: tuple[str, ...] = ()
    should: tuple[str, ...] = ()
    never: tuple[str, ...] = ()
    pattern: str | None = None
    required_facts: tuple[dict, ...] = field(default=())


def required_facts(raw: dict | list | None) -> list[dict]:
    """Required facts in one form: a list of keys, a list of objects, or either under ``facts``, each with ``required`` (true if not said)."""
    listed = raw.get("facts") if isinstance(raw, dict) else raw
    return [{"fact_key": x, "required": True} if isinstance(x, str) else {"required": True, **x} for x in listed or []]


def contract(raw: dict) -> Contract:
    """A contract out of its JSON; older ones have plain lists of terms, which are musts, or a single term."""
    listed = lambda x: tuple(str(t).lower() for t in ([x] if isinstance(x, str) else x or []))
    match = raw.get("heading_match") or {}
    match = match if isinstance(match, dict) else {"must": match}
    regex = raw.get("regex") or {}
    pattern = regex.get("heading") if isinstance(regex, dict) else regex
    return Contract(raw["section"], listed(match.get("must")), listed(match.get("should")), listed(match.get("not")), pattern, tuple(required_facts(raw.get("required_facts"))))


def heading_scores(text: Column, contracts: list[Contract]) -> Column:
    """An array of (section, score) of the contracts a heading reaches: 2 a must, 1 a should, -3 a never, 3 for the pattern."""
    low = F.lower(text)
    hits = lambda words: sum((F.when(low.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    score = lambda c: 2 * hits(c.must) + hits(c.should) - 3 * hits(c.never) + (F.when(text.rlike(c.pattern), 3).otherwise(0) if c.pattern else F.lit(0))
    return F.filter(F.array(*(F.struct(F.lit(c.section).alias("section"), score(c).alias("score")) for c in contracts)), lambda x: x["score"] >= LEAST_SCORE)


def best_headings(units: DataFrame, contracts: list[Contract]) -> DataFrame:
    """doc_id, section, para_index, end_index, heading, score, sure: the best heading of each contract a document has one for.

    A first pass asks for the limit that the document's number of headings sets (``sure``); where it
    finds none, a second one takes a heading of at least LEAST_SCORE. Headings of the first two levels
    come first, then the score, then the earlier one.
    """
    n = F.count("*").over(Window.partitionBy("doc_id"))
    limit = F.when(n >= RICH_HEADINGS, RICH_SCORE).when(n <= SPARSE_HEADINGS, SPARSE_SCORE).otherwise(USUAL_SCORE)
    h = U.block_ends(units).withColumn("limit", limit).select("doc_id", "para_index", "end_index", "level", "anchor_id", "limit", F.explode_outer(heading_scores(F.col("text_norm"), contracts)).alias("x")).filter("x IS NOT NULL")
    best = h.groupBy("doc_id", "x.section").agg(F.max(F.struct((F.col("x.score") >= F.col("limit")).alias("sure"), (F.col("level") <= 2).alias("near"), F.col("x.score").alias("score"), (-F.col("para_index")).alias("back"), "end_index", "anchor_id")).alias("b"))
    return best.select("doc_id", "section", (-F.col("b.back")).alias("para_index"), "b.end_index", F.col("b.anchor_id").alias("heading"), "b.score", "b.sure")


def map_sections(units: DataFrame, contracts: list[Contract]) -> DataFrame:
    """A map (MAP) for every document and contract, from units with anchor_id and level.

    Confidence is 0.4 and a tenth of the score, at most 1, or SECOND_PASS for a heading under its
    document's limit; a map of at least SURE is mapped, others
    need review, those without a heading with confidence 0, no units and a note. A unit in several
    blocks goes to the surest map, ties to the first section by name.
    """
    found = best_headings(units, contracts).withColumn("confidence", F.least(F.when(F.col("sure"), 1.0).otherwise(SECOND_PASS), F.round(0.4 + F.col("score") / 10, 2)))
    inside = (F.col("u.para_index") >= F.col("f.para_index")) & (F.col("f.end_index").isNull() | (F.col("u.para_index") < F.col("f.end_index")))
    claims = units.select("doc_id", "para_index", "anchor_id").alias("u").join(found.alias("f"), "doc_id").filter(inside).select("doc_id", "u.para_index", "u.anchor_id", "section", "confidence")
    first = F.row_number().over(Window.partitionBy("doc_id", "anchor_id").orderBy(F.desc("confidence"), "section"))
    held = claims.withColumn("r", first).filter("r = 1").groupBy("doc_id", "section").agg(F.array_sort(F.collect_list(F.struct("para_index", "anchor_id"))).alias("a"))
    asked = units.select("doc_id").distinct().select("doc_id", F.explode(F.array(*(F.lit(c.section) for c in contracts))).alias("section"))
    every = asked.join(found.select("doc_id", "section", "heading", "confidence"), ["doc_id", "section"], "left").join(held, ["doc_id", "section"], "left")
    none = F.col("heading").isNull()
    return every.select(
        "doc_id",
        "section",
        "heading",
        F.coalesce(F.transform("a", lambda x: x["anchor_id"]), F.array().cast("array<string>")).alias("anchor_ids"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.when(F.col("confidence") >= SURE, "mapped").otherwise("needs_review").alias("status"),
        F.lit("system").alias("mapped_by"),
        F.when(none, F.concat(F.lit("no heading match for "), "section")).alias("notes"),
    )


def override(maps: DataFrame, changes: DataFrame) -> DataFrame:
    """Maps with a user's changes (doc_id, section, anchor_ids, notes) laid over: what a change leaves null stays; new maps have confidence 1."""
    c = changes.select("doc_id", "section", F.col("anchor_ids").alias("_ids"), F.col("notes").alias("_notes"), F.lit(True).alias("_changed"))
    both = maps.join(c, ["doc_id", "section"], "full")
    changed = F.coalesce("_changed", F.lit(False))
    return both.select(
        "doc_id",
        "section",
        "heading",
        F.coalesce("_ids", "anchor_ids", F.array().cast("array<string>")).alias("anchor_ids"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        F.when(changed, "overridden").otherwise(F.col("status")).alias("status"),
        F.when(changed, "user").otherwise(F.col("mapped_by")).alias("mapped_by"),
        F.coalesce("_notes", "notes").alias("notes"),
    )


def rebuild(existing: DataFrame, mapped: DataFrame, force: bool = False) -> DataFrame:
    """Existing maps replaced by newly mapped ones; overridden ones stay unless ``force``, and so do those that weren't mapped again."""
    names = [c.split()[0] for c in MAP.split(", ")]
    rest = [n for n in names if n not in ("doc_id", "section")]
    pack = lambda d, name: d.select("doc_id", "section", F.struct(*rest).alias(name))
    both = pack(existing, "old").join(pack(mapped, "new"), ["doc_id", "section"], "full")
    stays = F.col("new").isNull() if force else F.col("new").isNull() | (F.col("old.status") == "overridden")
    return both.withColumn("m", F.when(stays, F.col("old")).otherwise(F.col("new"))).select("doc_id", "section", "m.*")
