"""The queries of this subpackage, as ``__spark_entry__.py`` registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, divergence, fingerprints, langid, licenses, linededup, neardup, pii, quality, tokenalign, toxicity, warc
from .common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    """Byte-level BPE of all documents: doc_id, n_tokens and the digests of ids and of the decoded bytes."""
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through WARC archives and their merged index: what was read back of each, and its place in its URL's history."""
    done = warc.archive_pages(table(spark, sf_dir, "pages"))
    return done.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "history_no", "previous_page_id")


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents after line dedup: lines, dropped lines, and length and digest of what stays."""
    return linededup.line_report(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from ``labels`` outside the held-out fold."""
    return toxicity.toxicity_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds an item of ``benchmark``, with that item and how much of it."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_id")


def op7_packed_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and their likeness."""
    return fingerprints.likeness_of_edits(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in all documents."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op9_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from ``labels`` outside the held-out fold."""
    return quality.quality_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned outside the held-out fold."""
    return langid.language_of(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of all sources of ``documents`` from each other and from their language, with their leading terms."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str, byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    """Tokens of two tokenizers over all documents: their numbers, groups and links, and how common the links' id pairs are."""
    import public_tokenizers

    return tokenalign.align_documents(table(spark, sf_dir, "documents"), byte_level or public_tokenizers.path("byte_bpe_50k.json"), pieces or public_tokenizers.path("piece_bpe_32k.model"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: patterned kinds counted, and all spans."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_warc_archives, op3_line_templates, op4_minhash_near_dedup, op5_toxicity_cnn, op6_template_decontamination, op7_packed_fingerprints, op8_license_scan, op9_quality_nbsvm, op10_language_id, op11_source_divergence, op12_token_alignment, op13_personal_data)}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_warc_archives": r"""
    WITH p AS (
      SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
             regexp_replace(regexp_replace(lower(trim(coalesce(url, ''))), '(?s)#.*$', ''), '^[a-z][a-z0-9+.-]*://([^/@]*@)?', '') AS bare FROM pages
    ), k AS (
      SELECT *, regexp_replace(regexp_extract(bare, '^[^/?]*'), '^www\d*\.|:\d+$', '', 'g') AS host, regexp_extract(bare, '(?s)^[^/?]*(.*)$', 1) AS rest,
             max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p
    ), c AS (
      SELECT page_id, payload_bytes, payload_digest,
             CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
             CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to,
             regexp_replace(CASE WHEN bare = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END END, '\s', '%20', 'g') AS urlkey FROM k
    )
    SELECT *, row_number() OVER h AS history_no, lag(page_id) OVER h AS previous_page_id FROM c WINDOW h AS (PARTITION BY urlkey ORDER BY page_id)
    """,
    "op3_line_templates": r"""
    WITH RECURSIVE line AS (SELECT doc_id, CAST(i - 1 AS INT) AS place, raw FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
    tidy AS (SELECT doc_id, place, trim(regexp_replace(lower(raw), '[\x09-\x0D\x20]+', ' ', 'g')) AS t FROM line),
    m AS (SELECT doc_id, place, CASE WHEN regexp_matches(t, '[0-9]') THEN regexp_replace(t, '[^ ]*[0-9][^ ]*', '<*>', 'g') ELSE t END AS masked FROM tidy),
    same AS (SELECT doc_id, md5(string_agg(masked, chr(10) ORDER BY place)) AS copy FROM m GROUP BY doc_id),
    u AS (SELECT m.doc_id, copy, place, masked FROM m JOIN same USING (doc_id) WHERE masked <> ''),
    kind AS (SELECT masked, n, string_split(masked, ' ') AS tk, len(string_split(masked, ' ')) AS c, array_to_string(string_split(masked, ' ')[1:3], ' ') AS head FROM (SELECT masked, count(*) AS n FROM u GROUP BY masked)),
    met AS (SELECT kind.*, s, CASE WHEN s < 0 THEN '' ELSE array_to_string(tk[4 + CAST(ceil(s * (c - 3) / 4.0) AS INT) : 3 + CAST(ceil((s + 1) * (c - 3) / 4.0) AS INT)], ' ') END AS run
            FROM kind, (SELECT unnest(range(-1, 4)) AS s) WHERE s < 0 OR ceil((s + 1) * (c - 3) / 4.0) > ceil(s * (c - 3) / 4.0)),
    seed AS (SELECT c, head, s, run, max(struct_pack(n := n, masked := masked)) AS seed FROM met GROUP BY c, head, s, run HAVING count(*) > 1),
    near AS (SELECT masked, max(seed) AS seed FROM met JOIN seed USING (c, head, s, run) WHERE struct_pack(n := n, masked := masked) < seed
             AND 10 * len(list_filter(list_zip(tk, string_split(seed.masked, ' ')), lambda x: x[1] = x[2])) >= 7 * c GROUP BY masked),
    up(masked, top) AS (SELECT masked, seed.masked FROM near UNION ALL SELECT up.masked, near.seed.masked FROM up JOIN near ON up.top = near.masked),
    tmpl AS (SELECT masked, top AS template FROM up WHERE top NOT IN (SELECT masked FROM near)),
    placed AS (SELECT doc_id, copy, place, coalesce(template, masked) AS template, length(masked) AS chars FROM u LEFT JOIN tmpl USING (masked)),
    pairs AS (SELECT template, copy, sum(chars) AS chars FROM placed GROUP BY template, copy),
    many AS (SELECT template FROM pairs GROUP BY template HAVING count(*) >= 3),
    own AS (SELECT copy FROM (SELECT copy, sum(p.chars) AS total, coalesce(sum(p.chars) FILTER (many.template IS NOT NULL), 0) AS again FROM pairs p LEFT JOIN many USING (template) GROUP BY copy) WHERE 6 * (total - again) >= total),
    often AS (SELECT template FROM pairs JOIN many USING (template) JOIN own USING (copy) GROUP BY template HAVING count(*) >= 3),
    spread AS (SELECT template, min(struct_pack(d := doc_id, k := copy, p := place)) AS first FROM placed JOIN often USING (template) GROUP BY template),
    drops AS (SELECT DISTINCT doc_id, place FROM placed JOIN spread USING (template) WHERE copy <> first.k OR place <> first.p),
    kept AS (SELECT line.doc_id, count(*) AS n_lines, count(drops.place) AS n_dropped, coalesce(string_agg(raw, chr(10) ORDER BY line.place) FILTER (drops.place IS NULL), '') AS k FROM line LEFT JOIN drops USING (doc_id, place) GROUP BY line.doc_id),
    done AS (SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE n_lines END AS n_lines, CASE WHEN regexp_matches(k, '[^\x09-\x0D\x20]') THEN n_dropped ELSE 0 END AS n_dropped, CASE WHEN n_dropped > 0 AND regexp_matches(k, '[^\x09-\x0D\x20]') THEN k ELSE coalesce(text, '') END AS t FROM documents JOIN kept USING (doc_id))
    SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, CAST(length(t) AS BIGINT) AS kept_chars, sha256(t) AS kept_sha256 FROM done
    """,
    "op4_minhash_near_dedup": f"""
    WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
                              WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
    x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d WHERE r.c < e.b),
    m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
    SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.c AS component_id, m.c = s.doc_id AS kept FROM s JOIN m ON m.d = s.doc_id
    """,
    "op11_source_divergence": r"""
    WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT row_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    own AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n, count(DISTINCT row_id) AS docs FROM w GROUP BY ALL),
    whole AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM own GROUP BY ALL HAVING sum(docs) >= 3),
    size AS (SELECT lang, count(*) AS v, CAST(sum(n) AS HUGEINT) AS n FROM whole GROUP BY lang),
    part AS (SELECT lang, source, CAST(sum(own.n) AS HUGEINT) AS n FROM own JOIN whole USING (lang, term) GROUP BY ALL),
    grp AS (SELECT g.lang, g.source, coalesce(part.n, 0) + coalesce(v, 0) AS den, coalesce(size.n, 0) + coalesce(v, 0) AS lang_den FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN part USING (lang, source) LEFT JOIN size ON size.lang = g.lang),
    p AS (SELECT grp.lang, grp.source, whole.term, coalesce(own.n, 0) AS n, 1 + (1000000000 * (coalesce(own.n, 0) + 1)) // den AS p, 1 + (1000000000 * (whole.n + 1)) // lang_den AS q
          FROM grp JOIN whole USING (lang) LEFT JOIN own ON own.lang = grp.lang AND own.source = grp.source AND own.term = whole.term),
    apart AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source),
    term AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
}
