"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from stemma import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (int, float)):
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{round(float(v), 6):.6f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    sql = plans.oracle_sql().get(name)
    if sql:
        found = duck.sql(sql)
        assert sorted(found.columns) == cols
        order = [found.columns.index(c) for c in cols]
        assert rows == sorted(tuple(norm(r[i]) for i in order) for r in found.fetchall())


def test_every_query_has_sql_or_is_a_kernel():
    kernels = {"f08_hash_embedding", "j12_aligned_versions", "j14_alignment_stats", "j18_impact", "d02_extracted_facts", "d12_objectives", "a30_heading_clusters", "a33_cluster_summaries", "a34_corpus_clusters", "f22_fuzzy_headings"}
    assert plans.queries().keys() - plans.oracle_sql().keys() == kernels
