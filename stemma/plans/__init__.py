"""Named queries over the driver's tables and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of this package; each has QUERIES and ORACLE_SQL.
MODULES: tuple[str, ...] = ("profile", "ordered", "relational", "aggregates", "versions", "composites", "domain", "scalars", "mapping", "ingest")


def _gather(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"{__name__}.{name}"), what)
        assert not found.keys() & part.keys(), found.keys() & part.keys()
        found |= part
    return found


def queries() -> dict[str, Query]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE_SQL")
