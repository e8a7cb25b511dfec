"""Facts, conflicts, audits, clusters and topics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as Q
from ..operators import clusters as K
from ..operators import facts as X
from ..operators import topics as W
from ..operators import units as U
from .base import ANCHOR, PAIR, SECTION, UNIT, anchors, units
from .registry import Registry, table
from .versions import pairs_of

R = Registry()
_K = "CAST(json_extract(props, '$.k') AS DOUBLE)"


@R.query("d02_extracted_facts")
def extracted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule registry and two rules for the driver's prose over all units, then one value per document and fact."""
    more = [X.Rule("license", "version", 100, 0.9, "text", r"\blicen[cs]e,?\s+version\s+(\d+(?:\.\d+)?)"), X.Rule("contact", "address", 100, 0.7, "text", r"\b(\d{1,3}(?:\.\d{1,3}){3})\b")]
    return X.arbitrate(X.extract(anchors(spark, sf_dir), X.rules() + more)).select("doc_id", "fact_type", "fact_key", "value", "votes", "confidence")


def _event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.variant_get(F.try_parse_json("props"), "$.k", "double"))
    return e.select("user_id", F.col("event_type").alias("fact_key"), F.round("value").cast("long").cast("string").alias("value"), (F.col("k") / 100).alias("confidence"), F.when(F.col("k") % 2 == 0, "design").otherwise("safety").alias("source_zone"), "event_id")


_FACTS = f"fact AS (SELECT user_id, event_type AS fact_key, CAST(CAST(round(value) AS BIGINT) AS VARCHAR) AS value, {_K} / 100 AS confidence, event_id FROM events)"


@R.query(
    "d04_fact_upsert",
    f"""WITH {_FACTS}, old AS (SELECT user_id, fact_key, min_by(value, event_id) AS value, min_by(confidence, event_id) AS confidence FROM fact WHERE confidence < 0.5 GROUP BY ALL),
    o AS (SELECT *, CASE WHEN confidence >= 0.25 THEN 'validated' ELSE 'extracted' END AS status FROM old),
    n AS (SELECT user_id, fact_key, min_by(value, event_id) AS nv, min_by(confidence, event_id) AS nc FROM fact WHERE confidence >= 0.5 GROUP BY ALL)
    SELECT user_id, fact_key, CASE WHEN status = 'validated' OR nv IS NULL THEN value ELSE nv END AS value,
    CASE WHEN status IS NULL THEN CASE WHEN nc >= 0.8 THEN 'extracted' ELSE 'needs_review' END WHEN status = 'validated' OR nv IS NULL OR nv = value THEN status ELSE 'needs_review' END AS status
    FROM o FULL JOIN n USING (user_id, fact_key)""",
)
def fact_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confident facts over the others as old ones, with their states."""
    f = _event_facts(spark, sf_dir).withColumn("fact_type", F.lit("event"))
    pick = lambda d: d.groupBy("user_id", "fact_type", "fact_key").agg(F.min_by("value", "event_id").alias("value"), F.min_by("confidence", "event_id").alias("confidence"))
    old = pick(f.filter("confidence < 0.5")).withColumn("status", F.when(F.col("confidence") >= 0.25, "validated").otherwise("extracted"))
    return X.upsert(old, pick(f.filter("confidence >= 0.5")), "user_id").select("user_id", "fact_key", "value", "status")


@R.query(
    "d05_replace_evidence",
    """WITH o AS (SELECT DISTINCT user_id, event_type, event_id AS anchor_id FROM events WHERE event_id % 3 <> 0), n AS (SELECT DISTINCT user_id, event_type, event_id AS anchor_id FROM events WHERE event_id % 3 = 0 AND value > 50)
    SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = o.user_id AND n.event_type = o.event_type) UNION ALL SELECT * FROM n WHERE anchor_id IN (SELECT event_id FROM events WHERE event_id % 7 <> 0)""",
)
def replace_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New evidence replaces that of its facts, as far as its units are known; other facts keep theirs."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("anchor_id"), "value")
    known = e.filter("anchor_id % 7 <> 0").select("anchor_id")
    return X.replace_evidence(e.filter("anchor_id % 3 <> 0").drop("value"), e.filter("anchor_id % 3 = 0 AND value > 50").drop("value"), known, ["user_id", "event_type"])


@R.query(
    "d06_consistency",
    """WITH w AS (SELECT o_custkey AS doc_id, min(o_totalprice) AS lo, max(o_totalprice) / 4 AS hi, count(*) / 100.0 AS alpha, count(*) / 20.0 AS power FROM orders GROUP BY 1)
    SELECT doc_id, 'age_order' AS rule FROM w WHERE lo > hi UNION ALL SELECT doc_id, 'alpha_high' FROM w WHERE alpha >= 0.1 UNION ALL SELECT doc_id, 'power_low' FROM w WHERE power <= 0.7""",
)
def fact_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between the facts of a document."""
    w = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.min("o_totalprice").alias("age_min"), (F.max("o_totalprice") / 4).alias("age_max"), (F.count("*") / 100).alias("alpha"), (F.count("*") / 20).alias("power"))
    long = w.select("doc_id", F.explode(F.create_map(*[x for k in ("age_min", "age_max", "alpha", "power") for x in (F.lit(k), F.col(k).cast("string"))])).alias("fact_key", "value"))
    return X.consistency(long)


@R.query(
    "d07_conflicts",
    f"""WITH {_FACTS}, g AS (SELECT user_id, fact_key, value, max(confidence) AS c FROM fact GROUP BY ALL)
    SELECT user_id, fact_key, count(*) AS "values", CASE WHEN count(*) FILTER (c >= 0.8) >= 2 THEN 'block' ELSE 'warn' END AS severity,
    count(*) FILTER (c >= 0.8) < 2 AND count(*) FILTER (c >= 0.8) = 1 AND count(*) FILTER (c < 0.5) = count(*) - 1 AS auto_resolve FROM g GROUP BY ALL HAVING count(*) > 1""",
)
def fact_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unequal values of one fact."""
    return X.conflicts(_event_facts(spark, sf_dir), key="user_id").select("user_id", "fact_key", "values", "severity", "auto_resolve")


@R.query(
    "j20_facts_across_versions",
    f"""WITH {PAIR}, f AS (SELECT doc_id, 'units' AS fact_key, CAST(count(*) AS VARCHAR) AS value FROM anchor GROUP BY doc_id UNION ALL SELECT doc_id, 'headings', CAST(count(*) FILTER (kind = 'hdr') AS VARCHAR) FROM anchor GROUP BY doc_id)
    SELECT from_doc, to_doc, a.fact_key, a.value AS from_value, b.value AS to_value FROM pair JOIN f a ON a.doc_id = from_doc JOIN f b ON b.doc_id = to_doc AND a.fact_key = b.fact_key WHERE a.value <> b.value""",
)
def facts_across_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that differ between successive versions."""
    a = anchors(spark, sf_dir)
    n = a.groupBy("doc_id").agg(F.count("*").cast("string").alias("units"), F.count_if(F.col("kind") == "hdr").cast("string").alias("headings"))
    facts = n.select("doc_id", F.lit("count").alias("fact_type"), F.explode(F.create_map(F.lit("units"), F.col("units"), F.lit("headings"), F.col("headings"))).alias("fact_key", "value"))
    return X.across_versions(facts, pairs_of(a)).drop("fact_type")


_OPEN = {
    **{w.lower(): rf"(?i)(^|[^\p{{L}}\p{{N}}_]){w}($|[^\p{{L}}\p{{N}}_])" for w in Q.OPEN_WORDS},
    **{f"[{w.lower()}]": rf"(?i)\[{w}\]" for w in Q.OPEN_BRACKETS},
    "error!": "(?i)Error!",
    "xx": r"(^|[^\p{L}\p{N}_])XX+($|[^\p{L}\p{N}_])",
    "xxx": r"(^|[^\p{L}\p{N}_])XXX($|[^\p{L}\p{N}_])",
}
#: Left-open texts planted into units by place, so that every category has rows.
_PLANTED = ["see TBD now", "tbc", "XX days", "XXX", "[Insert]", "[ВСТАВИТЬ] имя", "[вставьте]", "Error! no source", "[todo]", "[FIXME]", "x XXXX y", "NoTBDhere"]
_PLANT = "CASE para_index % 40 " + " ".join(f"WHEN {i} THEN '{t} '" for i, t in enumerate(_PLANTED)) + " ELSE '' END || text_norm"


@R.query(
    "d08_placeholders",
    f"WITH {UNIT}, u AS (SELECT doc_id, para_index, {_PLANT} AS t FROM unit) " + " UNION ALL ".join(f"SELECT doc_id, CAST(para_index AS VARCHAR) AS location, '{k}' AS category FROM u WHERE regexp_matches(t, '{p}')" for k, p in _OPEN.items()),
)
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with text that should have been filled in, by the table of placeholders."""
    planted = F.get(F.array(*(F.lit(f"{t} ") for t in _PLANTED)), F.col("para_index") % 40)
    u = units(spark, sf_dir).withColumn("text_norm", F.concat(F.coalesce(planted, F.lit("")), "text_norm"))
    return Q.placeholders(u).select("doc_id", "location", "category")


@R.query(
    "d09_abbreviations",
    rf"""WITH {UNIT}, w AS (SELECT doc_id, para_index, unnest(regexp_extract_all(text_norm, '[\p{{L}}\p{{N}}_]+')) AS abbr FROM unit),
    u AS (SELECT doc_id, abbr, count(*) AS uses, min(para_index) AS first_use FROM w WHERE regexp_full_match(abbr, '[A-ZА-Я]{{2,6}}') AND abbr NOT IN {Q.NO_ABBREVIATIONS} GROUP BY ALL),
    d AS (SELECT doc_id, abbr, min(para_index) AS defined_at FROM (SELECT doc_id, para_index, unnest(regexp_extract_all(text_norm, '\(([A-ZА-Я]{{2,6}})\)', 1)) AS abbr FROM unit) GROUP BY ALL),
    c AS (SELECT doc_id, CASE WHEN defined_at IS NULL THEN 'missing' WHEN uses = 1 THEN 'unused' WHEN first_use < defined_at THEN 'unexpanded' END AS category, CAST(first_use AS VARCHAR) AS location, abbr AS detail FROM u LEFT JOIN d USING (doc_id, abbr))
    SELECT * FROM c WHERE category IS NOT NULL""",
)
def abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abbreviations without expansion, expanded but unused ones, and those used before it, of all documents."""
    return Q.abbreviations(units(spark, sf_dir)).select("doc_id", "category", "location", "detail")


@R.query(
    "d10_sums",
    """WITH s AS (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem WHERE l_linenumber IN (1, 2, 3) GROUP BY 1) SELECT o_orderkey AS doc_id, 'sum' AS category, 'total' AS location FROM orders JOIN s ON l_orderkey = o_orderkey WHERE abs(o_totalprice - s) > 0.01 * abs(o_totalprice)""",
)
def total_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals that are not the sums of their parts."""
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber IN (1, 2, 3)").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("part"), F.col("l_linenumber").cast("string")).alias("fact_key"), F.col("l_extendedprice").cast("string").alias("value"))
    totals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("total").alias("fact_key"), F.col("o_totalprice").cast("string").alias("value"))
    return Q.sums(lines.union(totals), "total", ["part1", "part2", "part3"]).select("doc_id", "category", "location")


@R.query(
    "d11_not_mentioned",
    f"""WITH {PAIR} SELECT from_doc AS doc_id, CAST(to_doc AS VARCHAR) AS location, a.text_norm AS detail FROM pair JOIN anchor a ON a.doc_id = from_doc AND a.kind = 'hdr' JOIN documents d ON d.doc_id = to_doc WHERE NOT contains(lower(d.text), lower(a.text_norm))""",
)
def not_mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of a version that its successor's text doesn't mention."""
    a = anchors(spark, sf_dir)
    p = pairs_of(a)
    items = p.join(a.filter("kind = 'hdr'").select(F.col("doc_id").alias("from_doc"), F.col("text_norm").alias("item")), "from_doc").select(F.col("from_doc").alias("doc_id"), F.col("to_doc").alias("other_doc"), "item")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("other_doc"), "text")
    return Q.cross_mentions(items, texts).select("doc_id", "location", "detail")


@R.query("d12_objectives")
def objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive versions whose opening sentences differ."""
    a = units(spark, sf_dir).withColumn("text_hash", F.sha2("text_norm", 256))
    p = pairs_of(a)
    opening = a.filter("kind = 'p'").groupBy("doc_id").agg(F.min_by("text_norm", "para_index").alias("t")).select("doc_id", T.first_sentences(F.col("t")).alias("t"))
    both = p.join(opening.toDF("from_doc", "a"), "from_doc").join(opening.toDF("to_doc", "b"), "to_doc")
    return Q.objectives_differ(both.select(F.col("from_doc").alias("doc_id"), F.col("to_doc").alias("other_doc"), "a", "b")).select("doc_id", "location", "detail")


@R.query(
    "d13_all_audits",
    R.sql["d09_abbreviations"].rsplit("SELECT * FROM c", 1)[0].rstrip() + """, p AS (""" + " UNION ALL ".join(f"SELECT '{k}' AS category FROM unit WHERE regexp_matches(text_norm, '{p}')" for k, p in _OPEN.items()) + """)
    SELECT 'placeholder' AS auditor, 'major' AS severity, category, count(*) AS issues FROM p GROUP BY category UNION ALL SELECT 'abbreviation', 'minor', category, count(*) FROM c WHERE category IS NOT NULL GROUP BY category""",
)
def all_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All auditors of a collection, counted; one that cannot be planned leaves the others."""
    u = units(spark, sf_dir)
    found, _ = Q.run_all({"placeholder": lambda: Q.placeholders(u), "abbreviation": lambda: Q.abbreviations(u), "broken": lambda: u.select("no_such_column")}, spark)
    return found.groupBy("auditor", "severity", "category").agg(F.count("*").alias("issues"))


@R.query(
    "d14_core_facts",
    "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), CASE WHEN d.n_chars > 1000 THEN 'long' END, 'unknown') AS profile, CASE WHEN l.quality IS NOT NULL THEN 'label' WHEN d.n_chars > 1000 THEN 'anchor' ELSE 'default' END AS origin FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def core_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value of each core fact by the order of its sources, with where it came from: labels, then lengths, then a default."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    source = lambda rows, value: rows.select("doc_id", F.lit("profile").alias("fact_key"), value.alias("value"), F.lit(1.0).alias("confidence"), F.col("doc_id").cast("string").alias("anchor_id"))
    labels = source(table(spark, sf_dir, "labels").join(d, "doc_id", "left_semi"), F.col("quality").cast("string"))
    found = X.core_facts({"label": labels, "anchor": source(d, F.when(F.col("n_chars") > 1000, "long")), "default": source(d, F.lit("unknown"))})
    return found.select("doc_id", F.col("value").alias("profile"), "origin")


@R.query(
    "d15_context",
    f"""WITH {SECTION}, ok AS (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0), c AS (SELECT doc_id, para_index, kind, text_norm FROM section JOIN ok USING (doc_id) WHERE lang IN ('en', 'de')),
    r AS (SELECT doc_id, para_index, sum(length(text_norm) + 2) OVER (PARTITION BY doc_id ORDER BY CASE kind WHEN 'hdr' THEN 0 ELSE 1 END, para_index) AS total FROM c)
    SELECT doc_id, array_to_string(list(para_index ORDER BY para_index), ',') AS units, CAST(max(total) AS BIGINT) AS chars FROM r WHERE total <= 800 GROUP BY doc_id""",
)
def context(spark: SparkSession, sf_dir: str, limit: int = 800) -> DataFrame:
    """Admitted sources, headings first, packed until the first that doesn't fit."""
    ok = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    c = U.units(table(spark, sf_dir, "documents").filter("lang IN ('en', 'de')").join(ok, "doc_id", "left_semi"))
    w = Window.partitionBy("doc_id").orderBy(F.when(F.col("kind") == "hdr", 0).otherwise(1), "para_index").rowsBetween(Window.unboundedPreceding, 0)
    r = c.select("doc_id", "para_index", F.sum(F.length("text_norm") + 2).over(w).alias("total")).filter(F.col("total") <= limit)
    return r.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("para_index")), ",").alias("units"), F.max("total").alias("chars"))


@R.query(
    "d16_generated_checks",
    """WITH s AS (SELECT c_custkey AS section FROM customer), c AS (SELECT o_custkey AS section, o_orderkey AS a FROM orders WHERE o_orderstatus = 'P'),
    known AS (SELECT DISTINCT l_orderkey AS a FROM lineitem), ok AS (SELECT DISTINCT l_orderkey AS a FROM lineitem WHERE l_quantity > 25)
    SELECT section, 'missing_anchor' AS "check", CAST(a AS VARCHAR) AS anchor_id FROM c WHERE a NOT IN (SELECT a FROM known) UNION ALL SELECT section, 'outside_source', CAST(a AS VARCHAR) FROM c WHERE a IN (SELECT a FROM known) AND a NOT IN (SELECT a FROM ok)
    UNION ALL SELECT section, 'uncited', NULL FROM s WHERE section NOT IN (SELECT section FROM c)""",
)
def generated_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations that point nowhere or outside the sources, and sections without any."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("section"), F.col("o_orderkey").cast("string").alias("anchor_id"))
    lines = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey").cast("string").alias("anchor_id")
    return Q.uncited(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("section")), o, lines.select(key).distinct(), lines.filter("l_quantity > 25").select(key).distinct())


@R.query(
    "d16_numbers",
    """WITH g AS (SELECT o_orderkey AS section, CAST(unnest(regexp_extract_all('total ' || printf('%.2f', o_totalprice) || ' for ' || o_custkey, '-?\\d+(?:\\.\\d+)?')) AS DOUBLE) AS value FROM orders),
    c AS (SELECT DISTINCT l_orderkey AS section, CAST(printf('%.2f', l_extendedprice) AS DOUBLE) AS value FROM lineitem)
    SELECT DISTINCT section, 'unsupported_number' AS "check", value FROM g WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.section = g.section AND abs(c.value - g.value) <= 0.1 * greatest(abs(c.value), abs(g.value)))""",
)
def generated_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers told of an order that none of its lines supports within a tenth."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("section"), F.concat(F.lit("total "), F.format_string("%.2f", F.col("o_totalprice").cast("double")), F.lit(" for "), F.col("o_custkey").cast("string")).alias("text"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("section"), F.format_string("%.2f", F.col("l_extendedprice").cast("double")).alias("text"))
    return Q.unsupported_numbers(o, lines, 0.1)


#: Facts that each section of a study requires.
REQUIRED_FACTS = {"opening": ["click", "purchase", "signup"], "closing": ["purchase", "refund"]}


@R.query(
    "d16_missing_facts",
    f"""WITH {_FACTS}, had AS (SELECT DISTINCT user_id, fact_key FROM fact WHERE confidence >= 0.5),
    asked AS (SELECT user_id, section, fact_key FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (VALUES {', '.join(str((s, k)) for s, ks in REQUIRED_FACTS.items() for k in ks)}) r(section, fact_key))
    SELECT user_id AS study, section, 'missing_fact' AS "check", fact_key FROM asked WHERE NOT EXISTS (SELECT 1 FROM had WHERE had.user_id = asked.user_id AND had.fact_key = asked.fact_key)""",
)
def missing_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that a section requires and a study has in no accepted state; here a user's events that are never sure."""
    f = _event_facts(spark, sf_dir).select(F.col("user_id").alias("study"), "fact_key", F.when(F.col("confidence") >= 0.5, "extracted").otherwise("needs_review").alias("status"))
    asked = F.array(*(F.struct(F.lit(s).alias("section"), F.lit(k).alias("fact_key")) for s, ks in REQUIRED_FACTS.items() for k in ks))
    required = f.select("study").distinct().select("study", F.explode(asked).alias("x")).select("study", "x.section", "x.fact_key")
    return Q.missing_facts(required, f)


@R.query(
    "d11_role_numbers",
    """WITH f AS (SELECT o_custkey AS study, o_orderstatus AS role, 'visits' AS fact_key, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY ALL
      UNION ALL SELECT o_custkey, o_orderstatus, 'total_blood_volume', round(CAST(sum(o_totalprice) AS DOUBLE), 2) FROM orders GROUP BY ALL),
    a AS (SELECT study, fact_key, value AS a FROM f WHERE role = 'F'), b AS (SELECT study, fact_key, value AS b FROM f WHERE role = 'O')
    SELECT study, fact_key, a, b, CASE WHEN b IS NULL THEN 'missing' ELSE 'differs' END AS issue FROM a LEFT JOIN b USING (study, fact_key) WHERE b IS NULL OR abs(a - b) > 0.05 * greatest(abs(a), abs(b))""",
)
def role_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits and blood volume of two roles of documents compared; here a customer's finished orders against the open ones, the volume in litres there."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("study"), F.col("o_orderstatus").alias("role")).agg(F.count("*").cast("double").alias("n"), F.round(F.sum("o_totalprice").cast("double"), 2).alias("volume"))
    visits = o.select("study", "role", F.lit("visits").alias("fact_key"), F.col("n").alias("value"), F.lit(None).cast("string").alias("unit"))
    litres = F.col("role") == "O"
    volume = o.select("study", "role", F.lit("total_blood_volume").alias("fact_key"), F.when(litres, F.col("volume") / 1000).otherwise(F.col("volume")).alias("value"), F.when(litres, "L").otherwise("ml").alias("unit"))
    found = Q.role_differences(visits.union(volume), "F", "O", ["visits", "total_blood_volume"], 0.05)
    return found.withColumn("b", F.round("b", 2))


@R.query(
    "d03_preferred_zones",
    f"""WITH {ANCHOR}, c AS (SELECT doc_id, anchor_id, kind, regexp_extract(text_norm, '\\b(\\d{{1,3}}(?:\\.\\d{{1,3}}){{3}})\\b', 1) AS value FROM anchor),
    n AS (SELECT *, bool_or(kind = 'hdr') OVER (PARTITION BY doc_id) AS near FROM c WHERE value <> '')
    SELECT doc_id, anchor_id, value, CAST(CASE WHEN kind = 'hdr' THEN 0.95 ELSE 0.7 END AS DOUBLE) AS confidence FROM n WHERE kind = 'hdr' OR NOT near""",
)
def preferred_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: addresses extracted from headings where a document has some there, else from anywhere."""
    a = anchors(spark, sf_dir)
    found = X.extract(a, [X.Rule("contact", "address", 100, 0.7, "text", r"\b(\d{1,3}(?:\.\d{1,3}){3})\b")])
    zones = a.select("anchor_id", F.when(F.col("kind") == "hdr", "title").otherwise("body").alias("source_zone"))
    return X.prefer_zones(found, zones, {"contact": ["title"]}).select("doc_id", "anchor_id", "value", "confidence")


@R.query("a34_corpus_clusters")
def corpus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all headings of the corpus in one group, with their titles."""
    h = units(spark, sf_dir).filter("kind = 'hdr'").select(F.lit("corpus").alias("grp"), "text_norm")
    return K.summaries(K.cluster_headings(h)).drop("embedding")


@R.query("a30_heading_clusters")
def heading_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF, average linkage and centroid merges of distinct headings by language."""
    h = units(spark, sf_dir).filter("kind = 'hdr'").select(F.col("lang").alias("grp"), "text_norm")
    return K.cluster_headings(h)


@R.query("a33_cluster_summaries")
def cluster_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters' titles and examples."""
    h = units(spark, sf_dir).filter("kind = 'hdr'").select(F.col("lang").alias("grp"), "text_norm")
    return K.summaries(K.cluster_headings(h))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading blocks with the first two sentences of their first paragraph; the language stands for the zone."""
    b = U.blocks(units(spark, sf_dir)).filter("block_no > 0")
    blocks = b.groupBy("doc_id", "block_no").agg(F.max(F.when(F.col("kind") == "hdr", F.col("text_norm"))).alias("heading"), F.min_by(F.when(F.col("kind") == "p", F.col("text_norm")), F.when(F.col("kind") == "p", F.col("para_index"))).alias("t"), F.max("lang").alias("zone"))
    return blocks.select("doc_id", "block_no", "heading", T.first_sentences(F.coalesce("t", F.lit(""))).alias("text"), "zone")


#: Topics of the driver's prose, by keywords, priors of languages and prototypes.
BLOCK_TOPICS = [
    {"key": "english", "keywords": ["the", "of", "and"], "priors": {"en": 0.8, "de": 0.1}, "prototype": "the of and to in is that for it as with on by this be are from at or an"},
    {"key": "german", "keywords": ["der", "und", "die"], "priors": {"de": 0.8}, "prototype": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als"},
    {"key": "romance", "keywords": ["de", "la", "que"], "priors": {"fr": 0.7, "es": 0.7}, "exclude": ["the "], "prototype": "de la que el en les et le des los un une"},
]
_PRIORS = [(k, z, w) for k, t in enumerate(BLOCK_TOPICS, 1) for z, w in t["priors"].items()]
_NEVER = [(k, x) for k, t in enumerate(BLOCK_TOPICS, 1) for x in t.get("exclude", ())]

#: Cosines of hashed counts, scores with and without the bonus, and the walk along each document.
TOPIC_WALK = rf"""WITH RECURSIVE {UNIT}, nb AS (SELECT *, count(*) FILTER (kind = 'hdr') OVER (PARTITION BY doc_id ORDER BY para_index) AS block_no FROM unit),
  blk AS (SELECT doc_id, block_no, max(text_norm) FILTER (kind = 'hdr') AS heading, coalesce(min_by(text_norm, para_index) FILTER (kind = 'p'), '') AS t, max(lang) AS zone FROM nb WHERE block_no > 0 GROUP BY ALL),
  b AS (SELECT doc_id, block_no, heading, zone, heading || ' ' || CASE WHEN regexp_matches(t, '^(?:.*?[.!?] ){{2}}') THEN rtrim(regexp_extract(t, '^(?:.*?[.!?] ){{2}}')) ELSE t END AS s FROM blk),
  topic(k, key, words, s) AS (VALUES {', '.join(f"({k}, '{t['key']}', {t['keywords']}, '{t['prototype']}')" for k, t in enumerate(BLOCK_TOPICS, 1))}),
  prior(k, zone, w) AS (VALUES {', '.join(map(str, _PRIORS))}), never(k, pattern) AS (VALUES {', '.join(map(str, _NEVER))}),
  src AS (SELECT 'b' AS side, doc_id AS i, block_no AS j, s FROM b UNION ALL SELECT 't', k, 0, s FROM topic),
  tok AS (SELECT side, i, j, sha256(lower(unnest(regexp_extract_all(s, '[A-Za-z0-9]+|[^\s0-9A-Za-z]')))) AS h FROM src),
  vec AS (SELECT side, i, j, CAST('0x' || substr(h, 1, 16) AS UBIGINT) % 1536 AS at, sum(CASE WHEN contains('13579bdf', substr(h, 18, 1)) THEN -1 ELSE 1 END) AS v FROM tok GROUP BY ALL),
  len AS (SELECT side, i, j, sqrt(CAST(sum(v * v) AS DOUBLE)) AS n FROM vec GROUP BY ALL),
  dot AS (SELECT b.i, b.j, t.i AS k, CAST(sum(b.v * t.v) AS DOUBLE) AS d FROM vec b JOIN vec t ON b.side = 'b' AND t.side = 't' AND b.at = t.at GROUP BY ALL),
  f AS (SELECT b.doc_id, b.block_no, topic.k, coalesce(greatest(d, 0) / (lb.n * lt.n), 0.0) AS e, least(0.8, 0.8 * len(list_filter(words, lambda w: contains(lower(b.s), w))) / len(words)) AS kw, CAST(coalesce(w, 0.5) AS DOUBLE) AS pr
    FROM b CROSS JOIN topic LEFT JOIN dot ON dot.i = doc_id AND dot.j = block_no AND dot.k = topic.k LEFT JOIN len lb ON lb.side = 'b' AND lb.i = doc_id AND lb.j = block_no LEFT JOIN len lt ON lt.side = 't' AND lt.i = topic.k
    LEFT JOIN prior ON prior.k = topic.k AND prior.zone = b.zone WHERE NOT EXISTS (SELECT 1 FROM never WHERE never.k = topic.k AND contains(lower(heading), pattern))),
  g AS (SELECT doc_id, block_no, k, pr, kw, CASE WHEN e > 0 THEN 0.5 * e + 0.3 * (0.7 * kw) + 0.2 * pr ELSE 0.5 * (0.7 * kw) + 0.3 * pr END AS s FROM f),
  p AS (SELECT doc_id, block_no, k, least(1.0, s) * CASE WHEN pr < 0.2 THEN 0.2 ELSE 1.0 END AS plain, least(1.0, s + CASE WHEN kw < 0.4 THEN 0.2 ELSE 0.0 END) * CASE WHEN pr < 0.2 THEN 0.2 ELSE 1.0 END AS after, CASE WHEN pr >= 0.7 THEN 0.45 ELSE 0.55 END AS least FROM g
    UNION ALL SELECT doc_id, block_no, 0, 0.0, 0.0, 1.0 FROM b),
  walk(doc_id, block_no, k, score) AS (SELECT doc_id, CAST(0 AS BIGINT), 0, CAST(0 AS DOUBLE) FROM b WHERE block_no = 1
    UNION ALL SELECT doc_id, block_no, CASE WHEN x.s >= x.least THEN -x.k ELSE 0 END, x.s FROM (SELECT p.doc_id, p.block_no, max(struct_pack(s := CASE WHEN p.k = walk.k THEN p.after ELSE p.plain END, k := -p.k, least := p.least)) AS x FROM walk JOIN p ON p.doc_id = walk.doc_id AND p.block_no = walk.block_no + 1 GROUP BY ALL)),
  assigned AS (SELECT walk.doc_id, block_no, key AS topic, CASE WHEN walk.k > 0 THEN score END AS score FROM walk LEFT JOIN topic ON topic.k = walk.k WHERE block_no > 0)"""


def assigned_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.assign(_blocks(spark, sf_dir), BLOCK_TOPICS)


@R.query("w07_topic_assignment", f"{TOPIC_WALK} SELECT doc_id, block_no, topic, round(score, 6) AS score FROM assigned")
def topic_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of blocks by embedding, keywords and prior, each block seeing its predecessor's."""
    return assigned_topics(spark, sf_dir).withColumn("score", F.round("score", 6))


@R.query("f22_fuzzy_headings")
def fuzzy_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topics by difflib's likeness of headings to aliases."""
    topics = [{"key": "en", "aliases": ["of the", "that and"], "priors": {"en": 0.8}}, {"key": "de", "aliases": ["der und", "nicht"], "priors": {"de": 0.8}}, {"key": "other", "aliases": ["de la", "que el"], "exclude": ["the"]}]
    return W.assign(_blocks(spark, sf_dir), topics)


@R.query(
    "f13_dates",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders",
)
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dates written in four ways, read back."""
    d = F.col("o_orderdate").cast("timestamp")
    way = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format(d, "dd.MM.yyyy")).when(F.col("o_orderkey") % 4 == 2, F.date_format(d, "d/M/yyyy")).otherwise(F.date_format(d, "d MMM yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.parse_date(way).alias("d"))


@R.query(
    "f11_numbers",
    "SELECT p_partkey, CASE WHEN p_partkey BETWEEN 1 AND 1000000 THEN p_partkey END AS whole, p_retailprice AS price, least(p_size, p_size + 5) AS lo, p_size + 5 AS hi, p_size || ':' || (p_size + 1) AS ratio, CAST(p_size AS DOUBLE) AS days FROM part",
)
def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, ranges, ratios and durations out of text."""
    s = F.col("p_size")
    r = T.parse_range(F.concat(F.lit("from "), s.cast("string"), F.lit(" to "), (s + 5).cast("string"), F.lit(" years")))
    ratio = T.parse_ratio(F.concat(s.cast("string"), F.lit(" к "), (s + 1).cast("string")))
    days = T.parse_duration(F.concat(F.lit("for "), s.cast("string"), F.lit(" days")))
    return table(spark, sf_dir, "part").select("p_partkey", T.parse_int(F.format_number("p_partkey", 0)).alias("whole"), T.parse_float(F.replace(F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(","))).alias("price"), r["min"].alias("lo"), r["max"].alias("hi"), ratio.alias("ratio"), days["value"].alias("days"))


@R.query(
    "f20_paths",
    f"""WITH {ANCHOR}, n AS (SELECT doc_id, para_index, string_split(section_path, '/') AS x, string_split(lead(section_path) OVER (PARTITION BY doc_id ORDER BY para_index), '/') AS y FROM anchor),
    c AS (SELECT doc_id, para_index, len(x) AS lx, len(y) AS ly, len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[1:i] = y[1:i])) AS same FROM n WHERE y IS NOT NULL)
    SELECT doc_id, para_index, same / CAST(greatest(lx, ly) AS DOUBLE) AS ratio FROM c""",
)
def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20, J12d: common path prefixes of neighbours, of any depth."""
    a = anchors(spark, sf_dir)
    n = a.select("doc_id", "para_index", F.col("section_path").alias("a"), F.lead("section_path").over(U.by_doc()).alias("b")).filter("b IS NOT NULL")
    return n.select("doc_id", "para_index", T.path_prefix_ratio(F.col("a"), F.col("b")).alias("ratio"))


@R.query(
    "f30_visits",
    "SELECT event_id, CAST(user_id AS INT) AS visit, CAST(event_id % 400 AS INT) - 20 AS day, CAST(event_id % 5 AS INT) AS before, CAST(event_id % 7 AS INT) AS after FROM events",
)
def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visit numbers, days and windows out of text."""
    t = F.format_string("Visit %d, Day %d (-%d/+%d days)", F.col("user_id"), F.col("event_id") % 400 - 20, F.col("event_id") % 5, F.col("event_id") % 7)
    w = T.day_window(t)
    return table(spark, sf_dir, "events").select("event_id", T.visit_number(t).alias("visit"), T.day_value(t).alias("day"), w["before"].alias("before"), w["after"].alias("after"))


QUERIES, ORACLE_SQL = R.queries, R.sql
