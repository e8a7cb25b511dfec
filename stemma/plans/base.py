"""SQL pieces that several queries are held against, and the frames they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import units as U
from .registry import table

#: Lines of documents as units.
UNIT = r"""unit AS (
  SELECT doc_id, source, lang, para_index, text_norm,
         CASE WHEN length(text_norm) <= 40 THEN 'hdr' ELSE 'p' END AS kind,
         CASE WHEN length(text_norm) <= 40 THEN CAST(least(3, length(text_norm) - length(replace(text_norm, ' ', '')) + 1) AS INT) END AS level
  FROM (SELECT doc_id, source, lang, CAST(i - 1 AS INT) AS para_index, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS text_norm
        FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
  WHERE text_norm <> ''
)"""

_LAST = "coalesce(max(CASE WHEN level = {k} THEN para_index END) OVER w, -1) AS at{k}, last_value(CASE WHEN level = {k} THEN text_norm END IGNORE NULLS) OVER w AS h{k}"

#: Units with section paths.
SECTION = (
    UNIT
    + ", stacked AS (SELECT *, "
    + ", ".join(_LAST.format(k=k) for k in (1, 2, 3))
    + r""" FROM unit WINDOW w AS (PARTITION BY doc_id ORDER BY para_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), section AS (
  SELECT doc_id, source, lang, para_index, text_norm, kind, level,
         coalesce(nullif(concat_ws('/', CASE WHEN at1 >= 0 THEN h1 END, CASE WHEN at2 >= 0 AND at2 > at1 THEN h2 END, CASE WHEN at3 >= 0 AND at3 > at1 AND at3 > at2 THEN h3 END), ''), '__FRONTMATTER__') AS section_path
  FROM stacked
)"""
)

#: Units with ordinals, hashes and ids.
ANCHOR = (
    SECTION
    + r""", based AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, section_path, kind ORDER BY para_index) AS INT) AS ordinal, sha256(text_norm) AS text_hash,
         doc_id || ':' || kind || ':' || substr(sha256(text_norm || ':' || substr(section_path, 1, 64)), 1, 16) AS base
  FROM section
), anchor AS (
  SELECT doc_id, source, lang, para_index, text_norm, kind, level, section_path, ordinal, text_hash,
         CASE WHEN n > 1 THEN base || ':v' || n ELSE base END AS anchor_id
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY para_index) AS n FROM based)
)"""
)

#: Successive versions: documents with the same first unit, in order of doc_id.
PAIR = (
    ANCHOR
    + r""", family AS (
  SELECT doc_id, min_by(text_hash, para_index) AS first_hash FROM anchor GROUP BY doc_id
), pair AS (
  SELECT from_doc, doc_id AS to_doc FROM (SELECT doc_id, lag(doc_id) OVER (PARTITION BY first_hash ORDER BY doc_id) AS from_doc FROM family) WHERE from_doc IS NOT NULL
)"""
)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.units(table(spark, sf_dir, "documents"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.with_sections(units(spark, sf_dir))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.anchors(sections(spark, sf_dir))
