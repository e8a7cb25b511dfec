"""Profiles of text units by zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .registry import Registry, table

R = Registry()


@R.query(
    "a05_zone_profile",
    r"""
    WITH unit AS (
      SELECT source, lang, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) AS t FROM documents
    ), sized AS (SELECT source, lang, length(t) AS n FROM unit WHERE t <> '')
    SELECT source, lang, count(*) AS units, count(*) FILTER (n < 10) AS short_units,
           quantile_cont(n, 0.5) AS p50_chars,
           CAST(list_sort(list(n))[least(CAST(floor(count(*) * 95 / 100.0) AS BIGINT), count(*) - 1) + 1] AS BIGINT) AS p95_chars
    FROM sized GROUP BY source, lang
    """,
)
def zone_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, short units and length percentiles by (source, lang)."""
    units = table(spark, sf_dir, "documents").select("source", "lang", F.explode(F.split("text", "\n")).alias("raw"))
    sized = units.select("source", "lang", T.collapse_space(F.col("raw")).alias("t")).filter("t <> ''").select("source", "lang", F.length("t").alias("n"))
    # a histogram first: what meets in one task is a row per distinct length, not per unit
    counts = sized.groupBy("source", "lang", "n").agg(F.count("*").alias("c"))
    ranked = counts.groupBy("source", "lang").agg(
        F.sum("c").alias("units"),
        F.sum(F.when(F.col("n") < 10, F.col("c")).otherwise(0)).alias("short_units"),
        F.percentile("n", F.lit(0.5), F.col("c")).alias("p50_chars"),
        F.array_sort(F.collect_list(F.struct("n", "c"))).alias("h"),
    )
    at = F.least(F.floor(F.col("units") * 95 / 100).cast("long"), F.col("units") - 1)
    walk = F.aggregate("h", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("v")), lambda s, x: F.struct((s["seen"] + x["c"]).alias("seen"), F.coalesce(s["v"], F.when(s["seen"] + x["c"] > at, x["n"].cast("long"))).alias("v")))
    return ranked.select("source", "lang", "units", "short_units", "p50_chars", walk["v"].alias("p95_chars"))


QUERIES, ORACLE_SQL = R.queries, R.sql
