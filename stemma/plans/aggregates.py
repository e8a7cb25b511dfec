"""Aggregations: counts, percentiles, coverage, JSON metrics, rollups and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from ..streaming import metrics as S
from .base import PAIR, SECTION, UNIT, sections, units
from .registry import Registry, table

R = Registry()
_K = "CAST(json_extract(props, '$.k') AS DOUBLE)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.variant_get(F.try_parse_json("props"), "$.k", "double"))


@R.query(
    "a01_filter_counts",
    f"WITH {UNIT} SELECT count(*) AS total, count(*) FILTER (kind = 'hdr') AS headings, count(*) FILTER (length(text_norm) < 10) AS short_units, count(*) FILTER (lang = 'en') AS english FROM unit",
)
def filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("kind") == "hdr").alias("headings"), F.count_if(F.length("text_norm") < 10).alias("short_units"), F.count_if(F.col("lang") == "en").alias("english"))


@R.query(
    "a02_one_key_counts",
    f"WITH {UNIT} SELECT 'kind' AS dimension, kind AS value, count(*) AS n FROM unit GROUP BY kind UNION ALL SELECT 'lang', lang, count(*) FROM unit GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM unit GROUP BY source",
)
def one_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: counts by each of several keys from one pass: the rows are counted by all keys first."""
    small = units(spark, sf_dir).groupBy("kind", "lang", "source").agg(F.count("*").alias("n"))
    long = small.select(F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), F.col(k).alias("value")) for k in ("kind", "lang", "source")))).alias("x"), "n")
    return long.groupBy("x.dimension", "x.value").agg(F.sum("n").alias("n"))


@R.query("a03_two_key_counts", "SELECT lang || '/' || source AS key, count(*) AS n FROM documents GROUP BY lang, source")
def two_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")).select(F.concat_ws("/", "lang", "source").alias("key"), "n")


@R.query("a04_top_groups", f"WITH {SECTION} SELECT section_path, count(*) AS n FROM section GROUP BY section_path ORDER BY n DESC, section_path LIMIT 10")
def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(spark, sf_dir).groupBy("section_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "section_path").limit(10)


@R.query("a06_nearest_rank", "SELECT user_id, quantile_disc(value, 0.1) AS p10, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90 FROM events GROUP BY user_id")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(*(M.p_nearest_rank(v, p).alias(f"p{p}") for p in (10, 50, 90)))


@R.query(
    "a07_array_length_percentile",
    "WITH b AS (SELECT l_orderkey, len(list(l_partkey)) AS n FROM lineitem GROUP BY l_orderkey) SELECT quantile_cont(n, 0.5) AS p50, CAST(quantile_disc(n, 0.95) AS BIGINT) AS p95, round(avg(n), 6) AS mean FROM b",
)
def array_length_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of list lengths over a histogram of lengths."""
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("l_partkey").alias("n")).groupBy("n").agg(F.count("*").alias("c"))
    return sizes.agg(
        F.percentile("n", F.lit(0.5), F.col("c")).alias("p50"),
        F.array_sort(F.collect_list(F.struct("n", "c"))).alias("h"),
        F.sum("c").alias("total"),
        F.round(F.sum(F.col("n") * F.col("c")) / F.sum("c"), 6).alias("mean"),
    ).select("p50", F.aggregate("h", F.struct(F.lit(0).cast("long").alias("s"), F.lit(None).cast("long").alias("v")), lambda a, x: F.struct((a["s"] + x["c"]).alias("s"), F.coalesce(a["v"], F.when(a["s"] + x["c"] >= F.ceil(F.col("total") * 0.95), x["n"])).alias("v")))["v"].alias("p95"), "mean")


@R.query("a08_conditional_count", "SELECT event_type, count(*) FILTER (event_type IN ('click', 'view') OR value >= 0.7) AS strong, count(*) AS n FROM events GROUP BY event_type")
def conditional_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("event_type").isin("click", "view") | (F.col("value") >= 0.7)).alias("strong"), F.count("*").alias("n"))


@R.query("a09_distinct", "SELECT source, count(DISTINCT lang) AS langs, count(DISTINCT n_chars) AS lengths FROM documents GROUP BY source")
def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_distinct("lang").alias("langs"), F.count_distinct("n_chars").alias("lengths"))


_CORE = ("en", "de", "fr", "es", "it", "ru")


@R.query(
    "a10_coverage",
    "WITH core AS (SELECT unnest(['en', 'de', 'fr', 'es', 'it', 'ru']) AS k), got AS (SELECT DISTINCT source, lang FROM documents), s AS (SELECT DISTINCT source FROM documents) "
    "SELECT s.source, count(g.lang) / 6.0 AS coverage, array_to_string(list(k ORDER BY k) FILTER (g.lang IS NULL), ',') AS missing FROM s CROSS JOIN core LEFT JOIN got g ON g.source = s.source AND g.lang = k GROUP BY s.source",
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of expected keys present, and those missing, without a cross join."""
    core = F.array(*map(F.lit, sorted(_CORE)))
    got = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("g"))
    return got.select("source", (F.size(F.array_intersect(core, "g")) / F.size(core)).alias("coverage"), F.array_join(F.array_except(core, "g"), ",").alias("missing"))


@R.query("a12_allowed_counts", "SELECT CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'unknown' END AS zone, count(*) AS n FROM documents GROUP BY 1")
def allowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts where values outside the allowed set are unknown."""
    zone = F.when(F.col("lang").isin("en", "de"), F.col("lang")).otherwise("unknown")
    return table(spark, sf_dir, "documents").groupBy(zone.alias("zone")).agg(F.count("*").alias("n"))


@R.query("a13_topic_coverage", "SELECT lang, count(DISTINCT source) AS topics, count(DISTINCT source) / CAST(greatest(15, count(DISTINCT source)) AS DOUBLE) AS coverage FROM documents GROUP BY lang")
def topic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count_distinct("source")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(n.alias("topics")).withColumn("coverage", F.col("topics") / F.greatest(F.lit(15), "topics"))


@R.query("a14_next_version", "SELECT user_id, event_type, coalesce(max(CAST(value AS BIGINT)), 0) + 1 AS next_version FROM (SELECT user_id, event_type, floor(value) AS value FROM events) GROUP BY user_id, event_type")
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg((F.coalesce(F.max(F.floor("value")), F.lit(0)) + 1).alias("next_version"))


@R.query(
    "a16_majority",
    "WITH v AS (SELECT l_partkey, l_returnflag, count(*) AS votes, max(l_discount) AS best FROM lineitem GROUP BY ALL) SELECT l_partkey, l_returnflag, votes FROM v QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY votes DESC, best DESC, l_returnflag) = 1",
)
def majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value with most votes, ties by confidence, then by value."""
    v = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("votes"), F.max("l_discount").alias("best"))
    first = F.row_number().over(Window.partitionBy("l_partkey").orderBy(F.desc("votes"), F.desc("best"), "l_returnflag"))
    return v.withColumn("r", first).filter("r = 1").select("l_partkey", "l_returnflag", "votes")


@R.query(
    "a17_evidence_groups",
    "SELECT user_id, round(value) AS fact, count(*) AS n, round(avg(value), 6) AS confidence, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS zones FROM events GROUP BY user_id, round(value)",
)
def evidence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("user_id", F.round("value").alias("fact"))
    return g.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("confidence"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("zones"))


@R.query(
    "a18_conflict_severity",
    """WITH g AS (SELECT l_partkey, l_returnflag, count(*) AS n, max(l_discount) AS c FROM lineitem GROUP BY ALL)
    SELECT l_partkey, count(*) AS kinds, CASE WHEN count(*) FILTER (c >= 0.09) >= 2 THEN 'block' ELSE 'warn' END AS severity FROM g GROUP BY l_partkey HAVING count(*) >= 2""",
)
def conflict_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differing values of one key; two confident ones block."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.max("l_discount").alias("c"))
    k = g.groupBy("l_partkey").agg(F.count("*").alias("kinds"), F.count_if(F.col("c") >= 0.09).alias("sure"))
    return k.filter("kinds >= 2").select("l_partkey", "kinds", F.when(F.col("sure") >= 2, "block").otherwise("warn").alias("severity"))


@R.query(
    "a19_set_aggregation",
    f"WITH {SECTION} SELECT section_path, source, lang, count(DISTINCT doc_id) AS docs, max(length(text_norm)) AS longest, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM section GROUP BY section_path, source, lang",
)
def set_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sections(spark, sf_dir).groupBy("section_path", "source", "lang")
    return g.agg(F.count_distinct("doc_id").alias("docs"), F.max(F.length("text_norm")).alias("longest"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


@R.query(
    "a20_mapping_metrics",
    "SELECT round(count(l.doc_id) / CAST(count(*) AS DOUBLE), 6) AS mapped_rate, count(*) FILTER (l.quality = 0) AS low_confidence, count(*) AS total FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def mapping_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(1).alias("m")), "doc_id", "left")
    return d.agg(F.round(F.count("m") / F.count("*"), 6).alias("mapped_rate"), F.count_if(F.col("quality") == 0).alias("low_confidence"), F.count("*").alias("total"))


@R.query(
    "a21_campaign_rollup",
    f"""WITH r AS (SELECT event_type, {_K} AS k, value FROM events)
    SELECT 'rate' AS part, event_type AS name, round(avg(CASE WHEN k >= 50 THEN 1.0 ELSE 0.0 END), 6) AS v FROM r GROUP BY event_type
    UNION ALL SELECT * FROM (SELECT 'message', left('k=' || CAST(CAST(k AS BIGINT) AS VARCHAR), 100), CAST(count(*) AS DOUBLE) FROM r GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 20)""",
)
def campaign_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by status and the twenty commonest messages."""
    r = _events(spark, sf_dir)
    rates = r.groupBy("event_type").agg(F.round(F.avg(F.when(F.col("k") >= 50, 1.0).otherwise(0.0)), 6).alias("v")).select(F.lit("rate").alias("part"), F.col("event_type").alias("name"), "v")
    message = F.left(F.concat(F.lit("k="), F.col("k").cast("long").cast("string")), F.lit(100))
    top = r.groupBy(message.alias("name")).agg(F.count("*").cast("double").alias("v")).orderBy(F.desc("v"), "name").limit(20)
    return rates.union(top.select(F.lit("message"), "name", "v"))


@R.query("a22_json_average", f"SELECT user_id % 10 AS config, round(avg({_K}), 6) AS mean_k, sum(CASE WHEN {_K} > 80 THEN 1 ELSE 0 END)::BIGINT AS high FROM events GROUP BY 1")
def json_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("config")).agg(F.round(F.avg("k"), 6).alias("mean_k"), F.sum(F.when(F.col("k") > 80, 1).otherwise(0)).alias("high"))


@R.query("a23_histogram", f"SELECT CASE WHEN {_K} < 25 THEN 'low' WHEN {_K} < 50 THEN 'mid' WHEN {_K} < 75 THEN 'high' ELSE 'top' END AS bucket, count(*) AS n FROM events GROUP BY 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.when(F.col("k") < 25, "low").when(F.col("k") < 50, "mid").when(F.col("k") < 75, "high").otherwise("top")
    return _events(spark, sf_dir).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@R.query("a24_json_condition", f"SELECT event_type, round(avg(CASE WHEN CAST({_K} AS BIGINT) % 2 = 0 THEN value ELSE 0 END), 6) AS v FROM events GROUP BY event_type")
def json_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(F.round(F.avg(F.when(F.col("k").cast("long") % 2 == 0, F.col("value")).otherwise(0)), 6).alias("v"))


@R.query("a25_json_unnest", "SELECT event_id, key, CAST(json_extract(props, '$.' || key) AS DOUBLE) AS v FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) ORDER BY v DESC, event_id LIMIT 50")
def json_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of semi-structured values as rows, then the largest."""
    e = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "x"))
    return e.select("event_id", "key", F.col("x").cast("double").alias("v")).orderBy(F.desc("v"), "event_id").limit(50)


@R.query(
    "a26_evidence_health",
    f"""WITH {UNIT}, d AS (SELECT doc_id, lang, count(*) AS n, count(*) FILTER (kind = 'hdr') AS h FROM unit GROUP BY doc_id, lang)
    SELECT lang, round(avg(n), 6) AS mean_size, round(avg(h / CAST(n AS DOUBLE)), 6) AS mean_heading_share FROM d GROUP BY lang""",
)
def evidence_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = units(spark, sf_dir).groupBy("doc_id", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "hdr").alias("h"))
    return d.groupBy("lang").agg(F.round(F.avg("n"), 6).alias("mean_size"), F.round(F.avg(F.col("h") / F.col("n")), 6).alias("mean_heading_share"))


@R.query(
    "a27_version_stability",
    f"""WITH {PAIR}, s AS (SELECT doc_id, list(DISTINCT text_hash) AS h, max_by(section_path, para_index) AS path FROM anchor GROUP BY doc_id),
    j AS (SELECT len(list_intersect(a.h, b.h)) / CAST(len(list_distinct(list_concat(a.h, b.h))) AS DOUBLE) AS jac FROM pair JOIN s a ON a.doc_id = from_doc JOIN s b ON b.doc_id = to_doc)
    SELECT count(*) AS pairs, round(avg(jac), 6) AS mean_jaccard, round(quantile_disc(jac, 0.1), 6) AS p10_jaccard FROM j""",
)
def version_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much successive versions share; hashes of units, not texts, are compared."""
    from .versions import pairs_of

    a = sections(spark, sf_dir).withColumn("text_hash", F.sha2("text_norm", 256))
    s = a.groupBy("doc_id").agg(F.collect_set("text_hash").alias("h"))
    p = pairs_of(a).join(s.select(F.col("doc_id").alias("from_doc"), F.col("h").alias("fh")), "from_doc").join(s.select(F.col("doc_id").alias("to_doc"), F.col("h").alias("th")), "to_doc")
    j = p.select(T.jaccard(F.col("fh"), F.col("th")).alias("jac"))
    return j.agg(F.count("*").alias("pairs"), F.round(F.avg("jac"), 6).alias("mean_jaccard"), F.round(F.expr("percentile_disc(0.1) WITHIN GROUP (ORDER BY jac)"), 6).alias("p10_jaccard"))


@R.query(
    "a35_language_split",
    f"WITH {UNIT}, h AS (SELECT text_norm, lang, count(*) AS n FROM unit WHERE kind = 'hdr' GROUP BY text_norm, lang) SELECT text_norm, CASE WHEN coalesce(max(n) FILTER (lang = 'de'), 0) >= coalesce(max(n) FILTER (lang = 'en'), 0) THEN 'de' ELSE 'en' END AS side, CAST(sum(n) AS BIGINT) AS uses FROM h GROUP BY text_norm HAVING sum(n) >= 3",
)
def language_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles go to the language that has more of them, ties to the first."""
    h = units(spark, sf_dir).filter("kind = 'hdr'").groupBy("text_norm").agg(F.count_if(F.col("lang") == "de").alias("de"), F.count_if(F.col("lang") == "en").alias("en"), F.count("*").alias("uses"))
    return h.filter("uses >= 3").select("text_norm", F.when(F.col("de") >= F.col("en"), "de").otherwise("en").alias("side"), "uses")


@R.query("a36_concatenation", "SELECT conv_id, sha256(string_agg(text, ' ' ORDER BY turn, role, text)) AS joined FROM conversations GROUP BY conv_id")
def concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's parts in order, as one searchable text."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return c.select("conv_id", F.sha2(F.array_join(F.transform("t", lambda x: x["text"]), " "), 256).alias("joined"))


@R.query(
    "a37_script_share",
    "SELECT doc_id, CAST(len(regexp_extract_all(text, '[a-zA-Z]')) AS BIGINT) AS latin, CAST(len(regexp_extract_all(text, '[а-яА-ЯёЁ]')) AS BIGINT) AS cyrillic, CASE WHEN len(regexp_extract_all(text, '[a-zA-Z]')) = 0 THEN 'unknown' ELSE 'en' END AS language FROM documents",
)
def script_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters by script and the language they tell."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(t, F.lit("[a-zA-Z]")).cast("long").alias("latin"), F.regexp_count(t, F.lit("[а-яА-ЯёЁ]")).cast("long").alias("cyrillic"), T.language_by_script(t).alias("language"))


@R.query(
    "a38_unknown_paths",
    f"WITH {SECTION} SELECT section_path, count(*) AS n FROM section JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY section_path ORDER BY n DESC, section_path LIMIT 20",
)
def unknown_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import units as U

    bad = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id")
    docs = table(spark, sf_dir, "documents").join(bad, "doc_id", "left_semi")
    return U.with_sections(U.units(docs)).groupBy("section_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "section_path").limit(20)


@R.query("a40_scalar_count", "SELECT count(*) AS n FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND d.text IS NOT NULL")
def scalar_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id")
    return d.join(table(spark, sf_dir, "labels").filter("quality IS NOT NULL").select("doc_id"), "doc_id").agg(F.count("*").alias("n"))


@R.query(
    "d17_quality_gate",
    f"""WITH {UNIT}, m AS (SELECT source, count(*) AS anchors, count(*) FILTER (kind = 'hdr') AS headings, count(*) FILTER (length(text_norm) < 10) / CAST(count(*) AS DOUBLE) AS unknown_rate FROM unit GROUP BY source)
    SELECT source, anchors, headings, concat_ws(',', CASE WHEN unknown_rate > 0.25 THEN 'high_unknown_rate' END, CASE WHEN anchors < 100 THEN 'few_anchors' END, CASE WHEN headings < 20 THEN 'few_headings' END) AS flags,
    CASE WHEN unknown_rate > 0.25 OR anchors < 100 OR headings < 20 THEN 'needs_review' ELSE 'ready' END AS status FROM m""",
)
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality gate over one row of metrics per version."""
    m = units(spark, sf_dir).groupBy("source").agg(F.count("*").alias("anchors"), F.count_if(F.col("kind") == "hdr").alias("headings"), (F.count_if(F.length("text_norm") < 10) / F.count("*")).alias("unknown_rate"))
    return M.quality_gate(m).select("source", "anchors", "headings", F.array_join("flags", ",").alias("flags"), "status")


@R.query("x01_windowed_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: hourly counts of events, by the function that runs on a stream as well."""
    w = S.windowed_counts(table(spark, sf_dir, "events").select("ts", "event_type", "value"))
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


QUERIES, ORACLE_SQL = R.queries, R.sql
