"""Filters, joins, sets and top-k over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import filters as P
from ..operators.ordering import numbered
from .base import UNIT, units
from .registry import Registry, table

R = Registry()


@R.query("p01_optional_filters", "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'de'")
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality filters that may be absent."""
    return P.equals_where_given(table(spark, sf_dir, "documents"), lang="de", source=None).select("doc_id", "lang", "source", "n_chars")


@R.query("p02_in_list", "SELECT doc_id, lang FROM documents WHERE lang IN ('fr', 'es')")
def in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(F.col("lang").isin("fr", "es")).select("doc_id", "lang")


@R.query("p03_not_equal", "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic IS DISTINCT FROM 1")
def not_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unequal, where an unknown value counts as unequal."""
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return d.filter(~F.col("toxic").eqNullSafe(1))


@R.query(
    "p04_previous_version",
    """SELECT d.doc_id, prev.doc_id AS previous FROM (SELECT o_orderkey AS doc_id, o_custkey, o_orderdate FROM orders) d
    JOIN LATERAL (SELECT o_orderkey AS doc_id FROM orders p WHERE p.o_custkey = d.o_custkey AND p.o_orderdate IS NOT NULL AND p.o_orderdate < d.o_orderdate ORDER BY p.o_orderdate DESC, p.o_orderkey DESC LIMIT 1) prev ON true""",
)
def previous_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest strictly earlier version with a date; one sort, not a self join.

    Versions of one date share their predecessor: the last one of the date before.
    """
    o = table(spark, sf_dir, "orders").filter("o_orderdate IS NOT NULL").select("o_custkey", "o_orderdate", "o_orderkey")

    first = Window.partitionBy("o_custkey").orderBy(F.unix_micros(F.col("o_orderdate").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    return o.select(F.col("o_orderkey").alias("doc_id"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).over(first).alias("previous")).filter("previous IS NOT NULL")


@R.query(
    "p05_array_overlap",
    "SELECT doc_id FROM documents WHERE list_has_any(string_split(lower(text), ' '), ['whom', 'der', 'les', 'las'])",
)
def array_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: documents whose words overlap a list."""
    words = F.split(F.lower("text"), " ")
    return table(spark, sf_dir, "documents").filter(F.arrays_overlap(words, F.array(*map(F.lit, ("whom", "der", "les", "las"))))).select("doc_id")


@R.query("p06_array_contains", "SELECT p_partkey FROM part WHERE list_contains(string_split(p_type, ' '), split_part(p_type, ' ', 1)) AND list_contains(string_split(p_name, ' '), split_part(p_name, ' ', 2))")
def array_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment of one value in an array column."""
    kinds, names = F.split("p_type", " "), F.split("p_name", " ")
    return table(spark, sf_dir, "part").filter(F.array_contains(kinds, F.get(kinds, F.lit(0))) & F.array_contains(names, F.coalesce(F.get(names, F.lit(1)), F.lit("")))).select("p_partkey")


@R.query("p08_json_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 50")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed paths of semi-structured values."""
    e = table(spark, sf_dir, "events").select("event_id", F.variant_get(F.try_parse_json("props"), "$.k", "double").alias("k"))
    return e.filter("k >= 50")


@R.query("p09_title_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(array_to_string([p_name, p_type], chr(10))), '12') OR contains(lower(array_to_string([p_name, p_type], chr(10))), 'promo')")
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = F.array("p_name", "p_type")
    return table(spark, sf_dir, "part").filter(P.mentions(titles, "12") | P.mentions(titles, "Promo")).select("p_partkey", "p_name")


@R.query(
    "p10_applicability",
    """WITH a AS (SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN CAST([] AS INT[]) ELSE [r_regionkey * 5, r_regionkey * 5 + 1] END AS admits FROM region)
    SELECT r_regionkey, n_nationkey FROM a, nation WHERE len(admits) = 0 OR list_contains(admits, n_nationkey)""",
)
def applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: an empty list admits every value. Both sides are dimensions of fixed size."""
    admits = F.when(F.col("r_regionkey") % 2 == 0, F.array().cast("array<int>")).otherwise(F.array((F.col("r_regionkey") * 5).cast("int"), (F.col("r_regionkey") * 5 + 1).cast("int")))
    a = table(spark, sf_dir, "region").select("r_regionkey", admits.alias("admits"))
    return a.crossJoin(table(spark, sf_dir, "nation").select("n_nationkey")).filter(P.applies_to(F.col("admits"), F.col("n_nationkey"))).select("r_regionkey", "n_nationkey")


@R.query("p11_source_gate", "SELECT doc_id, source FROM documents d WHERE lang IN ('en', 'de') AND n_chars > 0 AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1 AND toxic = 0)")
def source_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admitted sources: a semi join and predicates."""
    good = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")
    return table(spark, sf_dir, "documents").filter("lang IN ('en', 'de') AND n_chars > 0").select("doc_id", "source").join(good, "doc_id", "left_semi")


@R.query(
    "p12_mode_partition",
    """SELECT doc_id, mode, mode = 'needs_split' AS optional FROM (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'single' WHEN quality = 1 THEN 'needs_split' WHEN toxic = 1 THEN 'ambiguous' ELSE 'skip' END AS mode FROM labels) WHERE mode IN ('single', 'needs_split')""",
)
def mode_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "single").when(F.col("quality") == 1, "needs_split").when(F.col("toxic") == 1, "ambiguous").otherwise("skip")
    return table(spark, sf_dir, "labels").select("doc_id", mode.alias("mode")).filter(F.col("mode").isin("single", "needs_split")).withColumn("optional", F.col("mode") == "needs_split")


@R.query("p13_preview", "SELECT doc_id, left(text, 100) AS preview FROM documents")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(100)).alias("preview"))


@R.query(
    "p14_mapped_unmapped",
    "SELECT doc_id, 'mapped' AS state FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unmapped' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
)
def mapped_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, m = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return d.join(m, "doc_id", "left_semi").withColumn("state", F.lit("mapped")).union(d.join(m, "doc_id", "left_anti").withColumn("state", F.lit("unmapped")))


@R.query("j01_inner", "SELECT o_orderkey, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY o_orderkey")
def inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner equi join; the aggregate goes below it, so a row per order is joined."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "lines", "revenue")


@R.query("j02_dimension", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact with its dimensions of fixed size."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@R.query("j03_left_count", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@R.query(
    "j04_three_tables",
    "SELECT event_id, c_name, n_name FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE CAST(json_extract(props, '$.k') AS DOUBLE) > 90",
)
def three_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.variant_get(F.try_parse_json("props"), "$.k", "double") > 90).select("event_id", "user_id")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return e.join(c, F.col("user_id") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("event_id", "c_name", "n_name")


@R.query("j07_as_of", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS previous FROM events")
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.lag("event_id").over(w).alias("previous"))


@R.query("j08_default", "SELECT d.doc_id, coalesce(CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END, 'unknown') AS zone FROM documents d LEFT JOIN labels l USING (doc_id)")
def with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("z"))
    return table(spark, sf_dir, "documents").select("doc_id").join(z, "doc_id", "left").select("doc_id", F.coalesce("z", F.lit("unknown")).alias("zone"))


_CHUNKS = "chunk AS (SELECT l_orderkey AS chunk_id, list(DISTINCT l_partkey) AS parts, max(l_quantity) AS confidence FROM lineitem GROUP BY l_orderkey)"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chunk_id")).agg(F.collect_set("l_partkey").alias("parts"), F.max("l_quantity").alias("confidence"))


@R.query(
    "j09_unnest_join",
    f"WITH {_CHUNKS}, e AS (SELECT unnest(parts) AS part, chunk_id, confidence FROM chunk) SELECT p_partkey, chunk_id, confidence FROM part LEFT JOIN (SELECT part, chunk_id, confidence FROM e QUALIFY row_number() OVER (PARTITION BY part ORDER BY confidence DESC, chunk_id) = 1) ON p_partkey = part",
)
def unnest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What several lists claim goes to the most confident, smallest id first."""
    e = _chunks(spark, sf_dir).select(F.explode("parts").alias("part"), "chunk_id", "confidence")
    best = e.groupBy("part").agg(F.max(F.struct("confidence", -F.col("chunk_id"))).alias("b"))
    return table(spark, sf_dir, "part").select("p_partkey").join(best, F.col("p_partkey") == F.col("part"), "left").select("p_partkey", (-F.col("b.col2")).alias("chunk_id"), "b.confidence")


@R.query("j10_first_chunk", f"WITH {_CHUNKS}, e AS (SELECT unnest(parts) AS part, chunk_id FROM chunk) SELECT part, min(chunk_id) AS chunk_id FROM e GROUP BY part")
def first_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select(F.explode("parts").alias("part"), "chunk_id").groupBy("part").agg(F.min("chunk_id").alias("chunk_id"))


@R.query("j16_semi_overlap", f"WITH {_CHUNKS}, hit AS (SELECT DISTINCT p_partkey FROM part WHERE p_size = 1) SELECT chunk_id FROM chunk WHERE EXISTS (SELECT 1 FROM hit WHERE list_contains(parts, p_partkey))")
def semi_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that meet a set, by exploding and a semi join."""
    hit = table(spark, sf_dir, "part").filter("p_size = 1").select(F.col("p_partkey").alias("part"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("part")).join(hit, "part", "left_semi").select("chunk_id").distinct()


@R.query("j17_two_hops", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50 AND l_returnflag = 'R'))")
def two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50 AND l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(lines, "o_orderkey", "left_semi")
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@R.query(
    "j19_citation_union",
    "SELECT event_id, array_to_string(list_sort(list_distinct([CAST(json_extract(props, '$.k') AS VARCHAR), event_type, CAST(user_id AS VARCHAR)])), ',') AS cited FROM events",
)
def citation_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from several shapes of one semi-structured value, as a set."""
    k = F.variant_get(F.try_parse_json("props"), "$.k", "string")
    cited = F.array_union(F.array_union(F.array_compact(F.array(k)), F.array("event_type")), F.array(F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(cited), ",").alias("cited"))


@R.query(
    "j21_interval_overlap",
    """WITH v AS (SELECT event_id, user_id, epoch_us(ts) AS a, epoch_us(ts) + CAST(round(value * 60000000) AS BIGINT) AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
    SELECT x.event_id, y.event_id AS next_event, x.b - y.a AS overlap_us FROM v x JOIN v y ON x.user_id = y.user_id AND y.n = x.n + 1 WHERE y.a < x.b""",
)
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring windows that overlap, from one ordered pass."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    a = F.unix_micros(F.col("ts").cast("timestamp"))
    v = table(spark, sf_dir, "events").select("event_id", (a + F.round(F.col("value") * 60_000_000).cast("long")).alias("b"), F.lead("event_id").over(w).alias("next_event"), F.lead(a).over(w).alias("next_a"))
    return v.filter("next_a < b").select("event_id", "next_event", (F.col("b") - F.col("next_a")).alias("overlap_us"))


@R.query(
    "j22_crosswalk_top",
    """WITH x AS (SELECT n_regionkey, s_nationkey, count(*) AS weight FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
    SELECT n_regionkey, s_nationkey, weight FROM x QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY weight DESC, s_nationkey) <= 3""",
)
def crosswalk_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "s_nationkey").agg(F.count("*").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.desc("weight"), "s_nationkey"))
    return x.withColumn("r", rank).filter("r <= 3").select("n_regionkey", "s_nationkey", "weight")


@R.query("j25_with_evidence", "SELECT o_custkey, count(*) AS orders, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS keys FROM orders GROUP BY o_custkey")
def with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item with its evidence in one join instead of a lookup per item."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    return o.select("o_custkey", F.size("k").cast("long").alias("orders"), F.array_join("k", ",").alias("keys"))


@R.query("j26_delete_repeats", "SELECT min(doc_id) AS doc_id, sha256(text) AS text_hash FROM documents GROUP BY text")
def delete_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per key; texts are shuffled as hashes."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash")).groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"))


@R.query(
    "t04_rank_map_sort",
    "SELECT doc_id, lang, CASE lang WHEN 'es' THEN 1 WHEN 'de' THEN 2 ELSE 10000 END AS rank, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'es' THEN 1 WHEN 'de' THEN 2 ELSE 10000 END, doc_id) AS place FROM documents",
)
def rank_map_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4, T5: ordering by a listed preference, everything else last."""
    at = F.array_position(F.array(F.lit("es"), F.lit("de")), F.col("lang"))
    rank = F.when(at > 0, at).otherwise(10000).cast("int")
    ranked = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", rank.alias("rank"))
    return numbered(ranked, "source", ["rank", "doc_id"], "doc_id").select("doc_id", "lang", "rank", F.col("no").alias("place"))


@R.query("t06_pagination", "SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page in a total order, and the number of all rows."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return o.orderBy("o_orderdate", "o_orderkey").offset(100).limit(50).select("o_orderkey").crossJoin(o.agg(F.count("*").alias("total")))


@R.query("t07_stable_dedup", f"WITH {UNIT} SELECT doc_id, para_index, CAST(len(list_distinct(string_split(lower(text_norm), ' '))) AS INT) AS distinct_words FROM unit")
def stable_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).select("doc_id", "para_index", F.size(F.array_distinct(F.split(F.lower("text_norm"), " "))).alias("distinct_words"))


@R.query(
    "t09_prefer_fallback",
    "SELECT doc_id, CASE WHEN lang = 'en' THEN 0 WHEN lang IN ('de', 'fr') THEN 1 ELSE 2 END AS tier FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'en' THEN 0 WHEN lang IN ('de', 'fr') THEN 1 ELSE 2 END, doc_id) <= 5",
)
def prefer_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("lang") == "en", 0).when(F.col("lang").isin("de", "fr"), 1).otherwise(2)
    r = F.row_number().over(Window.partitionBy("source").orderBy("tier", "doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", tier.alias("tier")).withColumn("r", r).filter("r <= 5").select("doc_id", "tier")


@R.query(
    "t10_set_difference",
    """SELECT o_custkey AS id, 'added' AS change FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
    UNION ALL SELECT o_custkey, 'removed' FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""",
)
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What only one side has, from one aggregate over both instead of two differences."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus IN ('O', 'F')")
    sides = o.groupBy(F.col("o_custkey").alias("id")).agg(F.bool_or(F.col("o_orderstatus") == "O").alias("now"), F.bool_or(F.col("o_orderstatus") == "F").alias("was"))
    return sides.filter("now <> was").select("id", F.when(F.col("now"), "added").otherwise("removed").alias("change"))


@R.query("t11_intersection_test", f"WITH {_CHUNKS} SELECT chunk_id, CAST(len(list_intersect(parts, [1, 2, 3, 5, 8, 13, 21, 34, 55, 89])) AS INT) AS shared FROM chunk WHERE list_has_any(parts, [1, 2, 3, 5, 8, 13, 21, 34, 55, 89])")
def intersection_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(*(F.lit(x).cast("long") for x in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)))
    return _chunks(spark, sf_dir).filter(F.arrays_overlap("parts", wanted)).select("chunk_id", F.size(F.array_intersect("parts", wanted)).alias("shared"))


@R.query(
    "t13_prefer_validated",
    "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END DESC, o_orderdate DESC, o_orderkey DESC) = 1",
)
def prefer_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "P", 1).otherwise(0)
    best = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct(status, "o_orderdate", "o_orderkey")).alias("b"))
    return best.select("o_custkey", "b.o_orderkey", "b.o_orderstatus")


@R.query(
    "t14_order_by_prior",
    "WITH prior AS (SELECT s_nationkey AS k, count(*) AS prior FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) SELECT n_nationkey, row_number() OVER (ORDER BY coalesce(prior, 0) DESC, n_nationkey) AS place FROM nation LEFT JOIN prior ON k = n_nationkey",
)
def order_by_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension of fixed size by its priors, ties in the original order."""
    prior = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("prior"))
    n = table(spark, sf_dir, "nation").select("n_nationkey").join(prior, "n_nationkey", "left")
    return n.select("n_nationkey", F.row_number().over(Window.orderBy(F.desc(F.coalesce("prior", F.lit(0))), "n_nationkey")).cast("long").alias("place"))


@R.query(
    "t16_upsert",
    """SELECT c_custkey AS k, c_acctbal AS v, 'kept' AS how FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
    UNION ALL SELECT o_custkey, round(sum(o_totalprice), 2), CASE WHEN o_custkey IN (SELECT c_custkey FROM customer) THEN 'updated' ELSE 'inserted' END FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey""",
)
def upsert_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows over old ones by key, from one full join."""
    new = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("nv"))
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("ov"), F.lit(True).alias("was"))
    how = F.when(F.col("nv").isNull(), "kept").when(F.col("was"), "updated").otherwise("inserted")
    return old.join(new, "k", "full").select("k", F.coalesce("nv", "ov").alias("v"), how.alias("how"))


@R.query("t18_last_failed", "SELECT event_id, user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY ts DESC, event_id DESC LIMIT 20")
def last_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    least = e.agg(F.min("event_type").alias("event_type"))
    return e.join(F.broadcast(least), "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id")


QUERIES, ORACLE_SQL = R.queries, R.sql
