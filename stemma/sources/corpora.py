"""Corpora as JSON lines, rules as JSON or YAML, and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

HEADINGS = "doc_version_id string, hdr_anchor_id string, heading_text_raw string, heading_text_norm string"


def read_jsonl(spark: SparkSession, path: str, schema: str = HEADINGS) -> DataFrame:
    """Records of a fixed schema; lines that aren't records are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A report as JSON lines or as CSV with a header."""
    if kind == "csv":
        df.write.mode("overwrite").option("header", "true").csv(path)
    else:
        df.write.mode("overwrite").json(path)


def read_rules(spark: SparkSession, path: str) -> dict:
    """A rule file (JSON, or YAML where a parser is installed), read through Spark so that any store will do."""
    text = spark.read.text(path, wholetext=True).first().value
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def overwrite_versions(df: DataFrame, path: str, key: str = "doc_version_id") -> None:
    """Rewrites the partitions of the versions in ``df`` and leaves all others (delete and insert in one)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
