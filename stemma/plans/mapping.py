"""Section maps, their overrides and rebuilds, evaluation, topic maps and contract drafts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import clusters as K
from ..operators import metrics as M
from ..operators import sections as S
from ..operators import topics as W
from ..operators import units as U
from .base import ANCHOR, UNIT, anchors, units
from .domain import TOPIC_WALK, assigned_topics
from .registry import Registry, table

R = Registry()

#: Contracts for the driver's prose, one in each form that contracts come in.
CONTRACTS = [
    S.contract({"section": "opening", "heading_match": {"must": ["The"], "should": ["of", "and"], "not": ["ing"]}, "required_facts": ["phase"]}),
    S.contract({"section": "closing", "heading_match": ["ung"], "regex": {"heading": "^[A-Z].*er"}, "required_facts": {"facts": ["alpha"]}}),
    S.contract({"section": "middle", "heading_match": {"must": "que", "should": ["de"], "not": ["los"]}, "required_facts": [{"fact_key": "n", "required": False}]}),
]


def _score_sql(c: S.Contract) -> str:
    count = lambda words: " + ".join(["0", *(f"CAST(contains(lower(text_norm), '{w}') AS INT)" for w in words)])
    pattern = f" + 3 * CAST(regexp_matches(text_norm, '{c.pattern}') AS INT)" if c.pattern else ""
    return f"SELECT doc_id, para_index, level, anchor_id, CASE WHEN count(*) OVER (PARTITION BY doc_id) >= 30 THEN 4 WHEN count(*) OVER (PARTITION BY doc_id) <= 5 THEN 2 ELSE 3 END AS lim, '{c.section}' AS section, 2 * ({count(c.must)}) + ({count(c.should)}) - 3 * ({count(c.never)}){pattern} AS score FROM anchor WHERE kind = 'hdr'"


_MAPS = f"""{ANCHOR}, scored AS ({' UNION ALL '.join(map(_score_sql, CONTRACTS))}),
best AS (SELECT doc_id, section, para_index, level, anchor_id, score, lim FROM scored WHERE score >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id, section ORDER BY score >= lim DESC, level <= 2 DESC, score DESC, para_index) = 1),
ended AS (SELECT b.*, least(CASE WHEN score >= lim THEN 1.0 ELSE 0.5 END, round(0.4 + score / 10.0, 2)) AS confidence, (SELECT min(h.para_index) FROM anchor h WHERE h.doc_id = b.doc_id AND h.kind = 'hdr' AND h.level <= b.level AND h.para_index > b.para_index) AS stop FROM best b),
held AS (SELECT e.doc_id, e.section, a.para_index, a.anchor_id FROM ended e JOIN anchor a ON a.doc_id = e.doc_id AND a.para_index >= e.para_index AND (stop IS NULL OR a.para_index < stop) QUALIFY row_number() OVER (PARTITION BY e.doc_id, a.anchor_id ORDER BY confidence DESC, section) = 1),
maps AS (SELECT d.doc_id, c.section, e.anchor_id AS heading, coalesce((SELECT array_to_string(list(h.anchor_id ORDER BY h.para_index), ',') FROM held h WHERE h.doc_id = d.doc_id AND h.section = c.section), '') AS anchors,
    CAST(coalesce(confidence, 0) AS DOUBLE) AS confidence, CASE WHEN confidence >= 0.7 THEN 'mapped' ELSE 'needs_review' END AS status, 'system' AS mapped_by, CASE WHEN e.doc_id IS NULL THEN 'no heading match for ' || c.section END AS notes
  FROM (SELECT DISTINCT doc_id FROM anchor) d CROSS JOIN (VALUES {', '.join(f"('{c.section}')" for c in CONTRACTS)}) c(section) LEFT JOIN ended e ON e.doc_id = d.doc_id AND e.section = c.section)"""

#: A user's changes: labelled documents get their first unit for an opening, or a note alone.
_CHANGES = """changes AS (SELECT a.doc_id, 'opening' AS section, CASE WHEN quality = 1 THEN anchor_id END AS ids, CASE WHEN toxic = 1 THEN 'checked' END AS note FROM labels l JOIN (SELECT doc_id, min_by(anchor_id, para_index) AS anchor_id FROM anchor GROUP BY doc_id) a USING (doc_id))"""
_LAID = """laid AS (SELECT doc_id, section, heading, coalesce(ids, anchors) AS anchors, confidence, CASE WHEN c.doc_id IS NOT NULL THEN 'overridden' ELSE status END AS status, CASE WHEN c.doc_id IS NOT NULL THEN 'user' ELSE mapped_by END AS mapped_by, coalesce(note, notes) AS notes FROM maps LEFT JOIN changes c USING (doc_id, section))"""


def _flat(maps: DataFrame) -> DataFrame:
    return maps.withColumn("anchors", F.array_join("anchor_ids", ",")).drop("anchor_ids")


def _changes(a: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    first = a.groupBy("doc_id").agg(F.min_by("anchor_id", "para_index").alias("anchor_id"))
    labels = table(spark, sf_dir, "labels").join(first, "doc_id")
    return labels.select("doc_id", F.lit("opening").alias("section"), F.when(F.col("quality") == 1, F.array("anchor_id")).alias("anchor_ids"), F.when(F.col("toxic") == 1, "checked").alias("notes"))


@R.query("d18_section_maps", f"WITH {_MAPS} SELECT * FROM maps")
def section_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document mapped to every contract, with blocks, confidence and status."""
    return _flat(S.map_sections(anchors(spark, sf_dir), CONTRACTS))


@R.query("t19_override", f"WITH {_MAPS}, {_CHANGES}, {_LAID} SELECT * FROM laid")
def overridden_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's changes laid over the maps."""
    a = anchors(spark, sf_dir)
    return _flat(S.override(S.map_sections(a, CONTRACTS), _changes(a, spark, sf_dir)))


@R.query(
    "t20_rebuild",
    f"""WITH {_MAPS}, {_CHANGES}, {_LAID} SELECT false AS forced, l.doc_id, l.section, CASE WHEN l.status = 'overridden' THEN l.anchors ELSE m.anchors END AS anchors, CASE WHEN l.status = 'overridden' THEN l.status ELSE m.status END AS status FROM laid l JOIN maps m USING (doc_id, section)
    UNION ALL SELECT true, doc_id, section, anchors, status FROM maps""",
)
def rebuilt_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overridden maps outlive a rebuild, but not a forced one."""
    a = anchors(spark, sf_dir)
    mapped = S.map_sections(a, CONTRACTS)
    laid = S.override(mapped, _changes(a, spark, sf_dir))
    return _flat(S.rebuild(laid, mapped).select(F.lit(False).alias("forced"), "doc_id", "section", "anchor_ids", "status").union(S.rebuild(laid, mapped, force=True).select(F.lit(True), "doc_id", "section", "anchor_ids", "status")))


@R.query(
    "a28_evaluation_report",
    """WITH s AS (SELECT l_orderkey, list(DISTINCT l_partkey) FILTER (l_returnflag <> 'N') AS p, list(DISTINCT l_partkey) FILTER (l_quantity > 20) AS g FROM lineitem GROUP BY 1),
    n AS (SELECT o_orderpriority AS section, coalesce(len(p), 0) AS p, coalesce(len(g), 0) AS g, coalesce(len(list_intersect(p, g)), 0) AS b FROM s JOIN orders ON o_orderkey = l_orderkey),
    r AS (SELECT section, p, p = g AND b = p AS same, CASE WHEN p + g = 0 THEN 1.0 WHEN p = 0 THEN 0.0 ELSE b / CAST(p AS DOUBLE) END AS pr, CASE WHEN p + g = 0 THEN 1.0 WHEN g = 0 THEN 0.0 ELSE b / CAST(g AS DOUBLE) END AS re,
      CASE WHEN p + g = 0 THEN 1.0 ELSE 2 * b / CAST(p + g AS DOUBLE) END AS f, CASE WHEN p + g = 0 THEN 1.0 ELSE b / CAST(p + g - b AS DOUBLE) END AS j FROM n)
    SELECT section, count(*) AS maps, count(*) FILTER (same) AS exact, count(*) FILTER (p = 0) AS empty, round(avg(pr), 6) AS precision, round(avg(re), 6) AS recall, round(avg(f), 6) AS f1, round(avg(j), 6) AS jaccard,
      quantile_disc(round(j, 4), 0.1) AS p10, quantile_disc(round(j, 4), 0.5) AS p50, quantile_disc(round(j, 4), 0.9) AS p90 FROM r GROUP BY section""",
)
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped against right units, by section: here an order's returned parts against its large ones, by priority."""
    nothing = F.array().cast("array<bigint>")
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") != "N", F.col("l_partkey"))).alias("predicted"), F.collect_set(F.when(F.col("l_quantity") > 20, F.col("l_partkey"))).alias("gold"))
    rows = sets.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("section")), "l_orderkey")
    return M.evaluation_report(rows.select("section", F.coalesce("predicted", nothing).alias("predicted"), F.coalesce("gold", nothing).alias("gold")))


@R.query(
    "d19_topic_maps",
    f"""{TOPIC_WALK}, {ANCHOR[len(UNIT) + 2 :]},
    a AS (SELECT doc_id, anchor_id, para_index, count(*) FILTER (kind = 'hdr') OVER (PARTITION BY doc_id ORDER BY para_index) AS block_no FROM anchor),
    e AS (SELECT doc_id, topic, list(anchor_id ORDER BY para_index) AS anchor_ids FROM assigned JOIN a USING (doc_id, block_no) WHERE topic IS NOT NULL GROUP BY ALL)
    SELECT doc_id, topic, list(block_no ORDER BY block_no) AS blocks, any_value(anchor_ids) AS anchor_ids, round(avg(score), 6) AS confidence FROM assigned JOIN e USING (doc_id, topic) GROUP BY ALL""",
)
def topic_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of blocks, and the units of each topic as its evidence."""
    members = U.blocks(anchors(spark, sf_dir)).filter("block_no > 0").select("doc_id", "block_no", "para_index", "anchor_id")
    return W.topic_maps(assigned_topics(spark, sf_dir), members)


@R.query(
    "f32_contract_drafts",
    f"""WITH {UNIT}, h AS (SELECT lang AS grp, text_norm AS title, lower(string_split(text_norm, ' ')[1]) AS cluster_id, count(*) AS n FROM unit WHERE kind = 'hdr' GROUP BY ALL),
    t AS (SELECT grp, cluster_id, list(title ORDER BY n DESC, title)[1:20] AS titles FROM h GROUP BY ALL HAVING count(*) >= 3),
    w AS (SELECT grp, cluster_id, list_transform(titles, lambda x: list_filter(list_distinct(string_split(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')), lambda y: length(y) >= 3)) AS ws FROM t),
    k AS (SELECT grp, cluster_id, len(ws) AS n, unnest(flatten(ws)) AS word FROM w), c AS (SELECT grp, cluster_id, word, count(*) / CAST(any_value(n) AS DOUBLE) AS share FROM k GROUP BY ALL)
    SELECT grp, cluster_id, coalesce((SELECT string_agg(word, ',' ORDER BY word) FROM c WHERE c.grp = w.grp AND c.cluster_id = w.cluster_id AND share >= 0.8), '') AS must,
      coalesce((SELECT string_agg(word, ',' ORDER BY word) FROM c WHERE c.grp = w.grp AND c.cluster_id = w.cluster_id AND share >= 0.4 AND share < 0.8), '') AS should FROM w""",
)
def contract_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of contracts from groups of headings, here those of a language that begin alike."""
    h = units(spark, sf_dir).filter("kind = 'hdr'").groupBy(F.col("lang").alias("grp"), F.col("text_norm").alias("title")).agg(F.count("*").alias("n"))
    h = h.withColumn("cluster_id", F.lower(F.get(F.split("title", " "), F.lit(0))))
    r = F.row_number().over(Window.partitionBy("grp", "cluster_id").orderBy(F.desc("n"), "title"))
    some = h.withColumn("r", r).groupBy("grp", "cluster_id").agg(F.count("*").alias("k"), F.array_sort(F.collect_list(F.when(F.col("r") <= 20, F.struct("r", "title")))).alias("t")).filter("k >= 3")
    d = K.contract_drafts(some.select("grp", "cluster_id", F.transform("t", lambda x: x["title"]).alias("top_titles")))
    return d.select("grp", "cluster_id", F.array_join("must", ",").alias("must"), F.array_join("should", ",").alias("should"))


QUERIES, ORACLE_SQL = R.queries, R.sql
