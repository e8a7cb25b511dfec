"""Scalar text functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse_space(col: Column) -> Column:
    """White space runs become one space; ends are trimmed. Null stays null."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def word_count(col: Column) -> Column:
    """Number of space-separated words of a text in single-space form; 0 if empty."""
    return F.when(col == "", 0).otherwise(F.length(col) - F.length(F.replace(col, F.lit(" "), F.lit(""))) + 1)


def normalize_match(col: Column) -> Column:
    """Case folded (by ``lower``), yo as ye, dashes and quotes as spaces, single spaces."""
    low = F.translate(F.lower(col), "ё", "е")
    return F.trim(F.regexp_replace(F.regexp_replace(low, "[\\u2010-\\u2015\\u2212\\-\"'\\u00ab\\u00bb\\u201c-\\u201f\\u2018\\u2019`]", " "), r"(?U)\s+", " "))


def normalize_regex(col: Column) -> Column:
    return F.trim(F.translate(F.lower(col), "ё", "е"))


def normalize_title(col: Column, chars: int = 120) -> Column:
    """Zero-width marks out, single spaces, no final colon, at most ``chars`` characters."""
    bare = F.regexp_replace(col, "[\\u200b-\\u200d\\ufeff]", "")
    tidy = F.regexp_replace(collapse_space(bare), r"\s*:+\s*$", "")
    return F.rtrim(F.left(tidy, F.lit(chars)))


def language_by_script(col: Column) -> Column:
    """ru, en, mixed or unknown by the share of Cyrillic among Latin and Cyrillic letters."""
    ru, en = F.regexp_count(col, F.lit("[а-яА-ЯёЁ]")), F.regexp_count(col, F.lit("[a-zA-Z]"))
    share = ru / (ru + en)
    return F.when(ru + en == 0, "unknown").when(share >= 0.7, "ru").when(share <= 0.3, "en").when((ru >= 10) & (en >= 10), "mixed").otherwise("unknown")


def short_hash(col: Column, chars: int = 16) -> Column:
    return F.substring(F.sha2(col, 256), 1, chars)


def tokens(col: Column) -> Column:
    """Lower-case ASCII letter-and-digit words, and any other mark by itself."""
    return F.regexp_extract_all(F.lower(col), F.lit(r"[a-z0-9]+|[^\sa-z0-9]"), F.lit(0))


def token_estimate(col: Column) -> Column:
    """A quarter of the characters, at least one; 0 for an empty or null text."""
    return F.when(F.coalesce(F.length(col), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(col) / 4).cast("int")))


def parse_int(col: Column) -> Column:
    """An integer from 1 to 1,000,000 with spaces, no-break spaces or commas as group marks; else null."""
    bare = F.regexp_replace(col, "[ ,\\u00a0]", "")
    value = F.when(bare.rlike(r"^[0-9]+$"), bare.try_cast("bigint"))
    return F.when(value.between(1, 1_000_000), value)


def parse_float(col: Column) -> Column:
    bare = F.replace(F.regexp_replace(col, "[ \\u00a0]", ""), F.lit(","), F.lit("."))
    return F.when(bare.rlike(r"^[0-9]+(\.[0-9]+)?$"), bare.try_cast("double"))


def parse_range(col: Column) -> Column:
    """struct(min, max) of ``a-b``, ``a to b``; null if absent or turned round."""
    pattern = r"(\d+)\s*(?:-|–|—|to|до)\s*(\d+)"
    lo, hi = F.regexp_extract(col, pattern, 1).try_cast("bigint"), F.regexp_extract(col, pattern, 2).try_cast("bigint")
    return F.when(lo <= hi, F.struct(lo.alias("min"), hi.alias("max")))


def parse_ratio(col: Column) -> Column:
    """``a:b`` from a:b, a/b, ``a to b`` and ``a к b``."""
    pattern = r"(\d+)\s*(?::|/|to|к)\s*(\d+)"
    return F.when(col.rlike(pattern), F.concat_ws(":", F.regexp_extract(col, pattern, 1), F.regexp_extract(col, pattern, 2)))


#: Units of duration by their beginnings (fixed values).
DURATION = {"day": "day|дн|ден|сут", "week": "week|недел", "month": "month|месяц", "year": "year|год|лет", "hour": "hour|час"}


def parse_duration(col: Column) -> Column:
    """struct(value, unit) of a number and a unit of time; null if absent."""
    pattern = r"(?iu)(\d+(?:[.,]\d+)?)\s*[-–]?\s*(" + "|".join(DURATION.values()) + ")"
    value = F.replace(F.regexp_extract(col, pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
    found = F.lower(F.regexp_extract(col, pattern, 2))
    unit = F.lit(None).cast("string")
    for name, starts in DURATION.items():
        unit = F.when(found.rlike(f"^(?:{starts})"), name).otherwise(unit)
    return F.when(value.isNotNull(), F.struct(value.alias("value"), unit.alias("unit")))


#: Months by their first letters (fixed values).
MONTHS = "jan|янв feb|фев mar|мар apr|апр may|мая|май jun|июн jul|июл aug|авг sep|сен oct|окт nov|ноя dec|дек".split()


def parse_date(col: Column) -> Column:
    """A date from ISO, D.M.Y, D/M/Y, or day, month name (English or Russian) and year; null otherwise."""
    t = F.trim(col)
    named = r"(?iu)^(\d{1,2})\s+([\p{L}]{3})[\p{L}]*\.?,?\s+(\d{4})$"
    month = F.lit(None).cast("int")
    for i, starts in enumerate(MONTHS, 1):
        month = F.when(F.lower(F.regexp_extract(t, named, 2)).rlike(f"^(?:{starts})"), i).otherwise(month)
    parts = F.concat_ws("-", F.regexp_extract(t, named, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(t, named, 1), 2, "0"))
    return F.coalesce(F.try_to_date(t, "yyyy-MM-dd"), F.try_to_date(t, "d.M.yyyy"), F.try_to_date(t, "d/M/yyyy"), F.try_to_date(F.when(month.isNotNull(), parts), "yyyy-MM-dd"))


def is_uncertain(col: Column) -> Column:
    """Whether a value is hedged (about, approximately, ...)."""
    return F.coalesce(F.lower(col).rlike(r"(?u)примерно|около|приблизительно|approximately|about|around|circa|~|≈"), F.lit(False))


def path_prefix_ratio(a: Column, b: Column, separator: str = "/") -> Column:
    """Length of the common beginning of two paths over the longer depth; 0 if either is empty."""
    x, y = F.split(a, separator, -1), F.split(b, separator, -1)
    same = F.zip_with(F.slice(x, 1, F.least(F.size(x), F.size(y))), F.slice(y, 1, F.least(F.size(x), F.size(y))), lambda p, q: p == q)
    first_off = F.array_position(same, False)
    common = F.when(first_off == 0, F.size(same)).otherwise(first_off - 1)
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).otherwise(common / F.greatest(F.size(x), F.size(y)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where lengths differ or a norm is 0."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))
    size = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x))) * F.sqrt(total(F.transform(b, lambda x: x.cast("double") * x)))
    return F.when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot / size)


def heading_level(style: Column, path: Column, text: Column) -> Column:
    """Level from a heading style's number, else the depth of the path, else the numbering; 1 if nothing tells."""
    styled = F.regexp_extract(style, r"(?i)heading\s*(\d)", 1).try_cast("int")
    depth = F.when(F.coalesce(path, F.lit("")) != "", F.size(F.split(path, "/")))
    number = F.regexp_extract(text, r"^(\d+(?:\.\d+)*)", 1)
    numbered = F.when(number != "", F.size(F.split(number, r"\.")))
    return F.coalesce(styled, depth, numbered, F.lit(1))


def visit_number(col: Column) -> Column:
    return F.regexp_extract(col, r"(?iu)(?:visit|визит)\s*№?\s*(\d+)", 1).try_cast("int")


def day_value(col: Column) -> Column:
    return F.regexp_extract(col, r"(?iu)(?:day|день)\s*(-?\d+)", 1).try_cast("int")


def day_window(col: Column) -> Column:
    """struct(before, after) of ``±n``, ``+/- n`` or ``-a/+b`` days."""
    even = F.regexp_extract(col, r"(?:±|\+/-)\s*(\d+)", 1).try_cast("int")
    lo, hi = F.regexp_extract(col, r"-(\d+)\s*/\s*\+(\d+)", 1).try_cast("int"), F.regexp_extract(col, r"-(\d+)\s*/\s*\+(\d+)", 2).try_cast("int")
    return F.when(even.isNotNull(), F.struct(even.alias("before"), even.alias("after"))).when(lo.isNotNull(), F.struct(lo.alias("before"), hi.alias("after")))


def first_sentences(col: Column, n: int = 2) -> Column:
    """The first ``n`` sentences; a sentence ends at . ! or ? before white space."""
    parts = F.split(collapse_space(col), r"(?<=[.!?])\s+", -1)
    return F.array_join(F.slice(parts, 1, n), " ")


def keyword_score(text: Column, words: Column) -> Column:
    """Share of the keywords that occur, times 0.8 and capped there."""
    hits = F.size(F.filter(words, lambda w: text.contains(w)))
    return F.when(F.size(words) == 0, 0.0).otherwise(F.least(F.lit(0.8), 0.8 * hits / F.size(words)))


def excluded(text: Column, patterns: Column) -> Column:
    return F.exists(patterns, lambda p: text.contains(p))
