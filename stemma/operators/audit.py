"""Audits within and across documents; every auditor gives issues of one shape."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUE = "doc_id long, auditor string, severity string, category string, location string, detail string"

#: What stands for a text that is still to come (fixed values): words, words in brackets, and others.
OPEN_WORDS = ("TBD", "TBC")
OPEN_BRACKETS = ("Insert", "Вставить", "Вставьте", "TODO", "FIXME")
#: Category and pattern of each; marks of crosses count in capitals only.
PLACEHOLDERS = {
    **{w.lower(): rf"(?iuU)\b{w}\b" for w in OPEN_WORDS},
    **{f"[{w.lower()}]": rf"(?iu)\[{w}\]" for w in OPEN_BRACKETS},
    "error!": "(?i)Error!",
    "xx": r"(?U)\bXX+\b",
    "xxx": r"(?U)\bXXX\b",
}


def _issues(df: DataFrame, auditor: str, severity: str) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(auditor).alias("auditor"), F.lit(severity).alias("severity"), "category", "location", "detail")


def placeholders(units: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """Units with placeholders, once per category."""
    found = F.array_compact(F.array(*(F.when(F.col("text_norm").rlike(p), F.struct(F.lit(k).alias("category"), F.regexp_extract("text_norm", p, 0).alias("detail"))) for k, p in (patterns or PLACEHOLDERS).items())))
    rows = units.select("doc_id", F.col("para_index").cast("string").alias("location"), F.explode_outer(found).alias("x")).filter("x IS NOT NULL")
    return _issues(rows.select("doc_id", "location", "x.category", "x.detail"), "placeholder", "major")


#: Capital words that are no abbreviations (fixed values).
NO_ABBREVIATIONS = ("II", "III", "IV", "VI", "VII", "VIII", "IX", "XI", "XII", "COVID", "SARS")


def abbreviations(units: DataFrame) -> DataFrame:
    """Abbreviations used without an expansion in brackets anywhere, expanded ones that are never used again, and those first used before their expansion.

    An abbreviation is a word of two to six Latin or Cyrillic capitals of any language; it is expanded
    where it stands in brackets. Roman numerals and a few fixed names are none.
    """
    words = F.filter(F.regexp_extract_all("text_norm", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[A-ZА-Я]{2,6}$") & ~w.isin(*NO_ABBREVIATIONS))
    used = units.select("doc_id", "para_index", F.explode_outer(words).alias("abbr")).filter("abbr IS NOT NULL").groupBy("doc_id", "abbr").agg(F.count("*").alias("uses"), F.min("para_index").alias("first_use"))
    opened = F.regexp_extract_all("text_norm", F.lit(r"\(([A-ZА-Я]{2,6})\)"), F.lit(1))
    defined = units.select("doc_id", "para_index", F.explode_outer(opened).alias("abbr")).filter("abbr IS NOT NULL").groupBy("doc_id", "abbr").agg(F.min("para_index").alias("defined_at"))
    both = used.join(defined, ["doc_id", "abbr"], "left")
    category = F.when(F.col("defined_at").isNull(), "missing").when(F.col("uses") == 1, "unused").when(F.col("first_use") < F.col("defined_at"), "unexpanded")
    rows = both.select("doc_id", category.alias("category"), F.col("first_use").cast("string").alias("location"), F.col("abbr").alias("detail")).filter("category IS NOT NULL")
    return _issues(rows, "abbreviation", "minor")


def sums(facts: DataFrame, total: str, parts: list[str], tolerance: float = 0.01) -> DataFrame:
    """Documents whose total isn't the sum of its parts, within a share of the total."""
    number = F.col("value").try_cast("double")
    w = facts.groupBy("doc_id").agg(F.max(F.when(F.col("fact_key") == total, number)).alias("t"), F.sum(F.when(F.col("fact_key").isin(*parts), number)).alias("s"))
    off = w.filter(F.abs(F.col("t") - F.col("s")) > tolerance * F.abs(F.col("t")))
    return _issues(off.select("doc_id", F.lit("sum").alias("category"), F.lit(total).alias("location"), F.concat_ws(" <> ", F.col("t").cast("string"), F.col("s").cast("string")).alias("detail")), "consistency", "major")


def cross_mentions(items: DataFrame, texts: DataFrame) -> DataFrame:
    """Items of one document (doc_id, other_doc, item) that the other's text (other_doc, text) never mentions."""
    # one row for each pair of documents, so that a text isn't repeated for every item
    asked = items.groupBy("doc_id", "other_doc").agg(F.collect_list("item").alias("items"))
    low = asked.join(texts.select("other_doc", F.lower("text").alias("low")), "other_doc")
    rows = low.select("doc_id", "other_doc", F.explode(F.filter("items", lambda x: ~F.col("low").contains(F.lower(x)))).alias("item"))
    return _issues(rows.select("doc_id", F.lit("not_mentioned").alias("category"), F.col("other_doc").cast("string").alias("location"), F.col("item").alias("detail")), "cross_mention", "major")


def mean_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Mean of word Jaccard and difflib's ratio; 1 for two empty texts."""
    from difflib import SequenceMatcher

    def one(x: str, y: str) -> float:
        p, q = set((x or "").lower().split()), set((y or "").lower().split())
        j = len(p & q) / len(p | q) if p | q else 1.0
        return (j + SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio()) / 2

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)


def objectives_differ(pairs: DataFrame, least: float = 0.9) -> DataFrame:
    """Pairs (doc_id, other_doc, a, b) whose texts are less alike than ``least``."""
    sim = F.pandas_udf(mean_similarity, "double")
    rows = pairs.withColumn("s", sim("a", "b")).filter(F.col("s") < least)
    return _issues(rows.select("doc_id", F.lit("objective").alias("category"), F.col("other_doc").cast("string").alias("location"), F.round("s", 4).cast("string").alias("detail")), "cross_objective", "critical")


def run_all(auditors: dict[str, Callable[[], DataFrame]], spark) -> tuple[DataFrame, dict[str, str]]:
    """The issues of all auditors, and the errors of those that could not be planned; one failure leaves the others."""
    out, failed = spark.createDataFrame([], ISSUE), {}
    for name, auditor in auditors.items():
        try:
            found = auditor()
            found.schema  # analysis errors show here, not in the joint job
            out = out.unionByName(found)
        except Exception as error:  # isolation is the feature
            failed[name] = str(error)[:200]
    return out, failed


#: Numbers in a text: digits with a decimal part.
_NUMBER = r"-?\d+(?:\.\d+)?"


def numbers_in(text: Column) -> Column:
    """The numbers of a text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0)), lambda x: x.cast("double"))


def _bucket(value: Column, tolerance: float) -> Column:
    """Sign and logarithmic range of a number; two numbers within the tolerance are in the same range or in neighbouring ones."""
    width = -math.log1p(-tolerance)
    return F.when(value == 0, F.lit(0)).otherwise(F.floor(F.log(F.abs(value)) / width)).cast("long")


def within(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """The rows of ``a`` (keys, value) that have a number of ``b`` (keys, value) within a share ``tolerance`` of the larger one.

    Numbers meet by key and range, the rows of ``a`` in the neighbouring ranges too, so no key is compared with all of its numbers.
    """
    x = a.select(*keys, "value", F.signum("value").alias("_sign"), F.explode(F.transform(F.array(*(F.lit(d).cast("long") for d in (-1, 0, 1))), lambda d: d + _bucket(F.col("value"), tolerance))).alias("_range"))
    y = b.select(*keys, F.col("value").alias("_other"), F.signum("value").alias("_sign"), _bucket(F.col("value"), tolerance).alias("_range")).distinct()
    close = F.abs(F.col("value") - F.col("_other")) <= tolerance * F.greatest(F.abs("value"), F.abs("_other"))
    return x.join(y, [*keys, "_sign", "_range"]).filter(close).select(*keys, "value").distinct()


def unsupported_numbers(generated: DataFrame, cited: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Section, check, value of the numbers of generated text (section, text) that no cited unit (section, text) has within the tolerance."""
    told = lambda d: d.select("section", F.explode(numbers_in(F.col("text"))).alias("value")).distinct()
    have = told(generated)
    return have.join(within(have, told(cited), ["section"], tolerance), ["section", "value"], "left_anti").select("section", F.lit("unsupported_number").alias("check"), "value")


def missing_facts(required: DataFrame, facts: DataFrame, states: tuple[str, ...] = ("extracted", "validated")) -> DataFrame:
    """Section, check, fact_key of the required facts (study, section, fact_key) that the study has in none of the states."""
    known = facts.filter(F.col("status").isin(*states)).select("study", "fact_key").distinct()
    return required.join(known, ["study", "fact_key"], "left_anti").select("study", "section", F.lit("missing_fact").alias("check"), "fact_key")


#: Units of volume in millilitres (fixed values).
MILLILITRES = {"ml": 1.0, "l": 1000.0, "cl": 10.0, "dl": 100.0}


def role_differences(facts: DataFrame, first: str, second: str, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """Study, fact_key, a, b, issue of the numeric facts that two roles of documents tell differently.

    ``facts``: study, role, fact_key, value, unit. Volumes are compared in millilitres. ``missing``:
    the second role doesn't tell it; ``differs``: none of its numbers is within the tolerance. Of
    several numbers of one role the smallest is shown.
    """
    factor = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in MILLILITRES.items() for x in kv)), F.lower("unit")), F.lit(1.0))
    f = facts.filter(F.col("fact_key").isin(*keys) & F.col("value").isNotNull()).select("study", "role", "fact_key", (F.col("value") * factor).alias("value"))
    by = ["study", "fact_key"]
    a, b = (f.filter(F.col("role") == role).select(*by, "value") for role in (first, second))
    alike = within(a, b, by, tolerance) if tolerance > 0 else a.join(b, [*by, "value"], "left_semi")
    rest = a.join(alike.select(*by).distinct(), by, "left_anti").groupBy(*by).agg(F.min("value").alias("a"))
    return rest.join(b.groupBy(*by).agg(F.min("value").alias("b")), by, "left").select(*by, "a", "b", F.when(F.col("b").isNull(), "missing").otherwise("differs").alias("issue"))


def uncited(sections: DataFrame, citations: DataFrame, anchors: DataFrame, allowed: DataFrame) -> DataFrame:
    """Checks of generated sections (section): citations of unknown units, of units outside the allowed ones, and none at all."""
    c = citations.select("section", "anchor_id")
    missing = c.join(anchors.select("anchor_id"), "anchor_id", "left_anti").select("section", F.lit("missing_anchor").alias("check"), "anchor_id")
    outside = c.join(anchors.select("anchor_id"), "anchor_id", "left_semi").join(allowed.select("anchor_id"), "anchor_id", "left_anti").select("section", F.lit("outside_source").alias("check"), "anchor_id")
    none = sections.select("section").join(c, "section", "left_anti").select("section", F.lit("uncited").alias("check"), F.lit(None).cast("string").alias("anchor_id"))
    return missing.union(outside).union(none)
