"""Schedules of activities: choosing the table, telling its orientation, and unpivoting it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Context that speaks for or against a schedule, words of visits, and marks (fixed values).
FOR = "schedule of activities|schedule of assessments|schedule of procedures|table of activities|time and events schedule|assessment schedule|flow chart|time and events table|study procedures|расписание процедур|график процедур|расписание мероприятий|график мероприятий|график проведения|план обследований|процедуры исследования|график обследований|схема визитов|план визитов|перечень процедур"
AGAINST = "appendix|приложение|scale|шкала|questionnaire|опросник|анкета|form|форма"
VISITS = ("visit", "day", "week", "screening", "baseline", "визит", "день", "неделя", "цикл")
MARKS = ("X", "✓", "NA", "—", "-", "YES", "NO")
LEAST = 2.0
_KEYS = ("path", "table_no")


def context_score(text: Column) -> Column:
    """-8 if anything speaks against a schedule, whatever else; else 6 if anything speaks for it."""
    low = F.lower(text)
    return F.when(low.rlike(AGAINST), -8.0).when(low.rlike(FOR), 6.0).otherwise(0.0)


def canonical_cell(text: Column) -> Column:
    """X for crosses, ticks and yes; empty for dashes and NA; other text as it is."""
    t = F.upper(F.translate(T.collapse_space(text), "Хх", "Xx"))
    return F.when(t.isin("X", "✓", "✔", "YES", "ДА"), "X").when(t.isin("-", "—", "–", "NA", "N/A", "NO", "НЕТ"), "").otherwise(T.collapse_space(text))


def _visit(t: Column) -> Column:
    """The first visit word in a text."""
    found = F.lit(None).cast("string")
    for w in reversed(VISITS):
        found = F.when(F.lower(t).contains(w), w).otherwise(found)
    return found


def score_tables(cells: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """path, table_no, score of each table from its cells (path, table_no, row_no, col_no, text_raw) and its context (path, table_no, context).

    Without ``context`` the cells bring their table's as a column.

    3 per visit word in the first three rows or the first column's first five cells, 3 for more than
    five marks, 2 for three by three or more, 2 for over 30 % empty or marked cells, -5 for more than
    ten cells of numbers with decimals or units.
    """
    t = T.collapse_space(F.col("text_raw"))
    up = F.translate(F.upper(t), "Х", "X")
    near = ((F.col("row_no") < 3) & (F.col("col_no") < 10)) | ((F.col("col_no") == 0) & (F.col("row_no") < 5))
    g = cells.groupBy(*_KEYS).agg(
        F.size(F.collect_set(F.when(near, _visit(t)))).alias("visits"),
        F.count_if(up.isin(*MARKS)).alias("marks"),
        F.count_if((t == "") | up.isin(*MARKS)).alias("bare"),
        F.count("*").alias("n"),
        (F.max("row_no") + 1).alias("rows"),
        (F.max(F.when(F.col("row_no") == 0, F.col("col_no"))) + 1).alias("cols"),
        F.count_if(t.rlike(r"(?i)\d+\.\d+|\d+\s*(?:mg|ml|g|kg|mmol|μmol)")).alias("numbers"),
        *([F.max("context").alias("context")] if context is None else []),
    )
    score = 3.0 * F.col("visits") + F.when(F.col("marks") > 5, 3.0).otherwise(0.0) + F.when((F.col("rows") >= 3) & (F.col("cols") >= 3), 2.0).otherwise(0.0) + F.when(F.col("bare") > 0.3 * F.col("n"), 2.0).otherwise(0.0) - F.when(F.col("numbers") > 10, 5.0).otherwise(0.0)
    both = g if context is None else g.join(context, list(_KEYS), "left")
    return both.select(*_KEYS, (score + F.coalesce(context_score(F.col("context")), F.lit(0.0))).alias("score"), "rows", "cols")


def table_context(blocks: DataFrame, headings: DataFrame, before: int = 6) -> DataFrame:
    """path, table_no, context, n_rows of each table: the six paragraphs before it and the headings open there, as one text.

    ``headings`` are the paragraphs of ``blocks`` with their levels, as ``headings.detect`` gives them.
    """
    p = headings.select("path", "para_index", T.collapse_space(F.col("text_raw")).alias("t"), "level", F.lit(None).cast("int").alias("table_no"), F.lit(None).cast("long").alias("n_rows"))
    # rows are told apart as a set, so that a table's cells shrink to a row before they move
    g = blocks.filter("kind = 'cell'").groupBy("path", "table_no").agg(F.min("para_index").alias("para_index"), F.size(F.collect_set("row_no")).cast("long").alias("n_rows"))
    tables = g.select("path", "para_index", F.lit(None).cast("string").alias("t"), F.lit(None).cast("int").alias("level"), "table_no", "n_rows")
    by = Window.partitionBy("path").orderBy("para_index")
    ahead = by.rowsBetween(Window.unboundedPreceding, -1)
    # paragraphs alone are counted, so that a table between two of them takes no place
    out = p.union(tables).select("*", *(F.expr(f"lag(t, {k}) IGNORE NULLS OVER (PARTITION BY path ORDER BY para_index)").alias(f"_t{k}") for k in range(1, before + 1)))
    for k in range(1, 5):
        out = out.withColumn(f"_at{k}", F.coalesce(F.max(F.when(F.col("level") == k, F.col("para_index"))).over(ahead), F.lit(-1))).withColumn(f"_h{k}", F.last(F.when(F.col("level") == k, F.col("t")), ignorenulls=True).over(ahead))
    open_ = [F.when(_open(k), F.col(f"_h{k}")) for k in range(1, 5)]
    seen = [F.col(f"_t{k}") for k in range(before, 0, -1)]
    return out.filter("table_no IS NOT NULL").select("path", "table_no", F.concat_ws(" ", *open_, F.array_join(F.array(*seen), " ")).alias("context"), "n_rows")


def _open(k: int) -> Column:
    test = F.col(f"_at{k}") >= 0
    for j in range(1, k):
        test = test & (F.col(f"_at{k}") > F.col(f"_at{j}"))
    return test


def choose(scored: DataFrame) -> DataFrame:
    """The best table of each document, if it reaches LEAST; the first of equal ones."""
    best = scored.groupBy("path").agg(F.max_by(F.struct("table_no", "score"), F.struct("score", -F.col("table_no"))).alias("b"))
    return best.select("path", "b.table_no", "b.score").filter(F.col("score") >= LEAST)


def unpivot(cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """path, visit_no, visit, procedure_no, procedure, value, marked: a row per body cell of the chosen tables.

    Visits are columns if the first row has at least as many visit words as the first column; ties
    go to whichever has more distinct texts.
    """
    # by document alone, and so everything after: cells that are dealt by document move no more
    c = cells.join(chosen.select("path", F.col("table_no").alias("_best")), "path").filter("table_no >= _best AND table_no <= _best")
    c = c.select("path", "row_no", "col_no", T.collapse_space(F.col("text_raw")).alias("t"), F.col("text_raw"))
    doc = Window.partitionBy("path")
    top, side = (F.col("row_no") == 0) & (F.col("col_no") > 0), (F.col("col_no") == 0) & (F.col("row_no") > 0)
    words = lambda at: F.count_if(at & _visit(F.col("t")).isNotNull()).over(doc)
    kinds = lambda at: F.size(F.collect_set(F.when(at, F.col("t"))).over(doc))
    c = c.withColumn("by_column", F.when(words(top) != words(side), words(top) > words(side)).otherwise(kinds(top) >= kinds(side)))
    visit = F.when(F.col("by_column"), F.col("col_no")).otherwise(F.col("row_no"))
    proc = F.when(F.col("by_column"), F.col("row_no")).otherwise(F.col("col_no"))
    c = c.withColumn("v", visit).withColumn("p", proc)
    column, row = Window.partitionBy("path", "v"), Window.partitionBy("path", "p")
    c = c.withColumn("visit", F.max(F.when(F.col("p") == 0, F.col("t"))).over(column)).withColumn("_headed", F.max(F.col("p") == 0).over(column))
    c = c.withColumn("procedure", F.max(F.when(F.col("v") == 0, F.col("t"))).over(row)).withColumn("_named", F.max(F.col("v") == 0).over(row))
    body = c.filter("p > 0 AND v > 0 AND _headed AND _named").withColumn("value", canonical_cell(F.col("text_raw")))
    return body.select("path", F.col("v").alias("visit_no"), "visit", F.col("p").alias("procedure_no"), "procedure", "value", (F.col("value") != "").alias("marked"))


def density(matrix: DataFrame) -> DataFrame:
    """path, visits, procedures, marked, density (marked over visits times procedures)."""
    g = matrix.groupBy("path").agg(F.count_distinct("visit_no").alias("visits"), F.count_distinct("procedure_no").alias("procedures"), F.count_if("marked").alias("marked"))
    return g.withColumn("density", F.col("marked") / (F.col("visits") * F.col("procedures")))
