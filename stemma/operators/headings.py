"""Heading detection over document blocks: style, outline level, numbering, then looks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Words that make a first-level numbered line a heading (fixed values).
CANONICAL = ("план", "цель", "цели", "популяция", "препарат", "препараты", "безопасность", "статистика", "процедур", "процедуры")
VISUAL_LEAST = 0.6
LARGER = 2.0


def detect(blocks: DataFrame, visual: bool = True, key: str = "path") -> DataFrame:
    """Adds mode (style, outline, numbering, visual or none), level and confidence to the paragraphs.

    Looks are asked only where a document shows no headings otherwise, or fewer than three in more
    than fifty paragraphs; its median font size counts over all runs.
    """
    t = F.trim(F.col("text_raw"))
    doc = Window.partitionBy(key)
    p = blocks.filter("kind = 'p'").withColumn("text", t).filter("text <> ''")
    sizes = blocks.filter("kind = 'p'").select(key, F.explode("font_sizes").alias("s")).groupBy(key).agg(F.median("s").alias("median_font"))
    p = p.join(sizes, key, "left")

    styled = F.regexp_extract("style", r"(?i)^heading\s*(\d)$", 1).try_cast("int")
    outlined = F.when(F.col("outline").between(0, 8), F.col("outline") + 1)
    number = F.regexp_extract("text", r"^(\d+(?:\.\d+)*)[).]?\s+[A-ZА-ЯЁ]", 1)
    depth = F.when(number != "", F.size(F.split(number, r"\.")))
    after = F.regexp_replace("text", r"^\d+(?:\.\d+)*[).]?\s+\S", "")
    upper, letters = F.regexp_count(after, F.lit(r"\p{Lu}")), F.regexp_count(after, F.lit(r"\p{L}"))
    large = F.coalesce(F.col("max_font") > F.col("median_font") + LARGER, F.lit(False))
    bold = F.coalesce(F.col("bold_ratio") >= 0.8, F.lit(False))
    centred = F.coalesce(F.col("centered"), F.lit(False))
    signal = ((letters > 0) & (upper >= 0.8 * letters)) | bold | centred | large | F.lower(after).rlike("|".join(CANONICAL))
    short = (F.length("text") <= 120) & (T.word_count(T.collapse_space(F.col("text"))) <= 14)
    sentence = F.col("text").endswith(".") | (F.size(F.split("text", r"\. ")) - 1 >= 2)
    # what most paragraphs fail comes first
    numbered = (number != "") & (depth <= 9) & short & ~sentence & ~F.col("text").rlike(r"\t\d+$") & ~F.coalesce(F.col("is_list"), F.lit(False)) & ~F.coalesce(F.col("style").startswith("List"), F.lit(False)) & ((depth > 1) | signal)
    score = F.when(bold, 0.25).otherwise(0.0) + F.when(centred, 0.20).otherwise(0.0) + F.when(large, 0.25).otherwise(0.0) + F.when(F.length("text") <= 80, 0.10).when(F.length("text") > 160, -0.30).otherwise(0.0) - F.when(F.col("text").endswith("."), 0.30).otherwise(0.0)

    p = p.withColumn("mode", F.when(styled.isNotNull(), "style").when(outlined.isNotNull(), "outline").when(F.coalesce(numbered, F.lit(False)), "numbering").otherwise("none"))
    found, n = F.count_if(F.col("mode") != "none").over(doc), F.count("*").over(doc)
    p = p.withColumn("rescan", F.lit(visual) & ((found == 0) | ((n > 50) & (found < 3)))).withColumn("score", F.round(score, 2))
    p = p.withColumn("mode", F.when((F.col("mode") == "none") & F.col("rescan") & (F.col("score") >= VISUAL_LEAST), "visual").otherwise(F.col("mode")))
    level = F.when(F.col("mode") == "style", styled).when(F.col("mode") == "outline", outlined).when(F.col("mode") == "numbering", depth).when(F.col("mode") == "visual", F.lit(1))
    confidence = F.when(F.col("mode") == "style", 1.0).when(F.col("mode") == "outline", 0.9).when(F.col("mode") == "numbering", 0.7).when(F.col("mode") == "visual", F.col("score")).otherwise(0.0)
    return p.withColumn("level", level).withColumn("confidence", confidence).withColumn("title", T.normalize_title(F.col("text"))).drop("rescan", "score", "median_font")
