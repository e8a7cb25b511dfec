"""Queries against their SQL on small tables that hold what the driver's smallest don't."""

import duckdb
import pytest
from test_queries import SF, TABLES, norm

from stemma import plans
from stemma.operators import clusters, headings, schedule
from stemma.plans import composites
from stemma.sources import docx


@pytest.fixture
def same_as_sql(spark, tmp_path):
    """Compares a query with its SQL, with the given tables (name: rows, schema) in place of the driver's."""

    def compare(name, **tables):
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{t}.parquet"))
        c = duckdb.connect()
        for t in TABLES:
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'" if t in tables else f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        df = plans.queries()[name](spark, str(tmp_path))
        cols = sorted(df.columns)
        got = sorted(tuple(norm(r[x]) for x in cols) for r in df.collect())
        found = c.sql(plans.oracle_sql()[name])
        order = [found.columns.index(x) for x in cols]
        assert sorted(found.columns) == cols
        assert got == sorted(tuple(norm(r[i]) for i in order) for r in found.fetchall())
        return got

    return compare


@pytest.mark.parametrize("name", ["s04_word_headings", "s06_visual_headings"])
def test_lines_with_numbers_of_their_own(same_as_sql, name):
    lines = "92.19.73.54 Thorea ntin inreed to threingwh and onther eren\nHeading here\n1.2 Short one\nSome more prose that is long enough to be a paragraph\n" * 2 + "prose\n" * 9
    prose = "and this is a paragraph of prose, as there are many of them\n" * 12
    assert same_as_sql(name, documents=([(i, lines + prose, "en", "web", len(lines + prose)) for i in range(8)], "doc_id long, text string, lang string, source string, n_chars long"))


def test_table_context_in_one_pass(spark, tmp_path):
    """Tables side by side, blank paragraphs and fewer than six of them; no join, and rows are counted with the context."""
    p = lambda t, style="": f'<w:p><w:pPr>{style}</w:pPr><w:r><w:t xml:space="preserve">{t}</w:t></w:r></w:p>'
    head = lambda t, k: p(t, f'<w:pStyle w:val="Heading{k}"/>')
    grid = docx.table_xml([["a", "b"], ["c", "d"], ["e", "f"]])
    body = p("one") + grid + grid + head("A", 1) + head("B", 2) + "".join(p(str(i)) + p(" ") for i in range(7)) + grid + head("C", 1) + docx.table_xml([["x"]])
    (tmp_path / "t.docx").write_bytes(docx.package(body))
    b = docx.blocks(docx.files(spark, str(tmp_path)))
    found = schedule.table_context(b, headings.detect(b, visual=False))
    got = {r.table_no: (r.context, r.n_rows) for r in found.collect()}
    assert got == {0: ("one", 3), 1: ("one", 3), 2: ("A B 1 2 3 4 5 6", 3), 3: ("C 2 3 4 5 6 C", 1)}
    plain = schedule.table_context(b, b.filter("kind = 'p' AND trim(text_raw) <> ''").withColumn("level", b.outline))
    assert "Join" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_headings_with_one_vector_stand_for_each_other(spark):
    """Copies in other letters and marks are no pairs, and weigh as many as they are."""
    texts = [f"{'Study'[:1 + i % 5].upper()}{'study'[1 + i % 5:]} design{'.' * (i // 5)}" for i in range(20)] + ["safety data", "safety data set"]
    rows = clusters.vectors(spark.createDataFrame([("g", t) for t in texts], "grp string, heading string"))
    same = clusters.alike(rows)
    assert same.select("same").distinct().count() == 2  # "set" and "data set" are in one heading only
    ones = rows.join(same.filter("heading = same").select("grp", "heading"), ["grp", "heading"], "left_semi")
    assert clusters.near_pairs(ones, "heading", 0.78).count() == 0
    x = clusters.tfidf(["a1 b1 c1", "a1 b1 d1", "a1 c1 e1 d1"] + ["a1 b1 c1"] * 5)
    want = clusters.average_linkage(x, 0.7)
    got = clusters.average_linkage(x[:3], 0.7, sizes=[6, 1, 1])
    assert got == want[:3]


def test_order_schedules_move_once(spark):
    """Orders and lines are dealt by order, in both branches alike, and their cells never."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plans.queries()["s13_schedule_unpivot"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len(dealt) == 2


def test_exact_matches_are_written_once(spark, monkeypatch):
    """The alignment reads exact matches more than once; they aren't computed anew each time."""
    seen = {}
    monkeypatch.setattr(composites.A, "align", lambda units, pairs, exact, chunks: seen.setdefault("exact", exact))
    composites._aligned(spark, SF)
    assert "Window" not in seen["exact"]._jdf.queryExecution().executedPlan().toString()
