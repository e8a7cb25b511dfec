"""Filters that are built from optional or listed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equals_where_given(df: DataFrame, **values) -> DataFrame:
    """Keeps rows equal to every value given; None means no filter on that column."""
    for name, value in values.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def applies_to(applicable: Column, value: Column | str) -> Column:
    """Whether a list of applicable values admits one; an empty or null list admits all."""
    return (F.coalesce(F.size(applicable), F.lit(0)) <= 0) | F.coalesce(F.array_contains(applicable, value), F.lit(False))


def mentions(titles: Column, needle: str) -> Column:
    """Whether any title holds the text, whatever its case."""
    return F.lower(F.array_join(titles, "\n")).contains(needle.lower())
