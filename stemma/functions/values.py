"""Functions over values, names and templates."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell_text(table: Column, row: Column, column: Column, value: Column) -> Column:
    """How a table cell reads as text: its row and column headers and its value."""
    return F.concat_ws("; ", F.concat(F.lit("table "), table.cast("string")), F.concat(F.lit("row: "), row), F.concat(F.lit("column: "), column), F.concat(F.lit("value: "), value))


def first_listed(text: Column, names: dict[str, str], default: str | None = None) -> Column:
    """The first name, in order, whose pattern occurs in the text."""
    out = F.lit(default).cast("string")
    for name, pattern in reversed(list(names.items())):
        out = F.when(text.rlike(f"(?iu){pattern}"), name).otherwise(out)
    return out


def substitute(template: Column, values: Column) -> Column:
    """``{{fact:key}}`` replaced by the map's values; unknown keys stay as they are."""
    keys = F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{\{fact:([\w.]+)\}\}"), F.lit(1)))
    return F.aggregate(keys, template, lambda s, k: F.when(F.try_element_at(values, k).isNull(), s).otherwise(F.replace(s, F.concat(F.lit("{{fact:"), k, F.lit("}}")), F.try_element_at(values, k))))


def title_tokens(title: Column, least: int = 3) -> Column:
    """Distinct lower-case words of a title with at least ``least`` letters, in order."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "), " "), lambda w: F.length(w) >= least))


def equal_values(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Whether two values are equal as numbers within a tolerance, or else as folded text; two nulls are."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= tolerance).otherwise(F.lower(F.trim(a)) == F.lower(F.trim(b)))


def is_complex(text: Column, chars: int = 100, commas: int = 2) -> Column:
    """Whether a value is long, listed, or has several numbers."""
    return (F.length(text) > chars) | (F.regexp_count(text, F.lit("[,;]")) > commas) | (F.regexp_count(text, F.lit(r"\d+")) > commas)


def outside(listed: Column, allowed: tuple[str, ...]) -> Column:
    """The listed values that are not allowed, in order."""
    return F.array_except(listed, F.array(*map(F.lit, allowed)))


def fingerprint(config: dict) -> str:
    """SHA-256 of a configuration as JSON with sorted keys (a driver-side helper)."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str).encode()).hexdigest()
