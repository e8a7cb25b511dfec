"""Metrics over units, runs and mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sorted(values: Column) -> Column:
    return F.sort_array(F.collect_list(values))


def p_floor_index(values: Column, percent: int) -> Column:
    """Aggregate: the element at floor(n * percent / 100) of the sorted values (the last at most)."""
    s = _sorted(values)
    return F.get(s, F.least(F.floor(F.size(s) * percent / 100), F.size(s) - 1).cast("int"))


def p_nearest_rank(values: Column, percent: int) -> Column:
    """Aggregate: the element at ceil(n * percent / 100) - 1 of the sorted values; 0 of none.

    Both percentiles gather a group's values; group by something that bounds them, or count values first.
    """
    s = _sorted(values)
    at = F.greatest(F.lit(0), F.ceil(F.size(s) * percent / 100) - 1).cast("int")
    return F.coalesce(F.get(s, at).cast("double"), F.lit(0.0))


#: Quality gate: flag and the condition under which it is raised, over the metrics' names (fixed values).
GATE = {
    "high_unknown_rate": "unknown_rate > 0.25",
    "soa_missing": "soa_found = false",
    "low_density": "density < 0.02",
    "few_visits": "visits < 4",
    "few_procedures": "procedures < 5",
    "low_coverage": "coverage < 0.75",
    "missing_facts": "missing_facts > 0",
    "conflicts": "conflicts >= 1",
    "few_anchors": "anchors < 100",
    "few_headings": "headings < 20",
}


def quality_gate(metrics: DataFrame) -> DataFrame:
    """Adds flags, the names of all conditions that hold, and status; conditions on absent columns are left out."""
    present = set(metrics.columns)
    rules = [(k, v) for k, v in GATE.items() if v.split()[0] in present]
    flags = F.array_compact(F.array(*(F.when(F.expr(v), F.lit(k)) for k, v in rules)))
    return metrics.withColumn("flags", flags).withColumn("status", F.when(F.size("flags") > 0, "needs_review").otherwise("ready"))


def set_scores(predicted: Column, gold: Column) -> Column:
    """struct(precision, recall, f1, jaccard, exact) of two arrays as sets; empty against empty is perfect."""
    p, g = F.size(F.array_distinct(predicted)), F.size(F.array_distinct(gold))
    both = F.size(F.array_intersect(predicted, gold))
    share = lambda n: F.when((p == 0) & (g == 0), 1.0).when(n == 0, 0.0).otherwise(both / n)
    return F.struct(share(p).alias("precision"), share(g).alias("recall"), F.when((p == 0) & (g == 0), 1.0).otherwise(2 * both / (p + g)).alias("f1"), share(p + g - both).alias("jaccard"), ((both == p) & (both == g)).alias("exact"))


def evaluation_report(rows: DataFrame, by: str = "section") -> DataFrame:
    """Mapped against right units: per ``by`` the number, exact and empty maps, means, and percentiles of the Jaccard similarity.

    ``rows``: ``by``, predicted and gold (arrays). Similarities are rounded to four places, so a
    group's percentiles count at most 10,001 values.
    """
    s = rows.select(by, F.size("predicted").alias("n"), set_scores(F.col("predicted"), F.col("gold")).alias("s"))
    j = F.round("s.jaccard", 4)
    rank = lambda p: F.percentile_disc(p).within_group(j) if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY round(s.jaccard, 4))")
    mean = lambda k: F.round(F.avg(f"s.{k}"), 6).alias(k)
    return s.groupBy(by).agg(F.count("*").alias("maps"), F.count_if("s.exact").alias("exact"), F.count_if(F.col("n") == 0).alias("empty"), mean("precision"), mean("recall"), mean("f1"), mean("jaccard"), *(rank(p / 100).alias(f"p{p}") for p in (10, 50, 90)))
