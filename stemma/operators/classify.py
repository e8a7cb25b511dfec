"""Zones by rules over section paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Zones of a protocol in rule order, with their heading patterns (fixed values).
PROTOCOL_RULES = {
    "overview": "^общая информация|^обоснование|^цели и задачи|^синопсис|^введение|^резюме|^general information|^background|^objectives|^synopsis|^introduction",
    "design": "^дизайн(а)? исследовани(я|й)|^методология|^рандомизация|^ослепление|^trial design|^study design|^methodology|^randomi[sz]ation|^blinding",
    "population": "^отбор.*субъектов|^критерии включения|^популяци(я|и)|^критерии исключения|^selection.*subjects|^inclusion criteria|^population|^exclusion criteria",
    "ip": "^лечение субъектов|^исследуемый препарат|^дозиров(ка|ание)|^сопутствующая терапия|^treatment of subjects|^investigational product|^dosing|^concomitant (medication|therapy)",
    "endpoints": "^конечные точки|^переменные эффективности|^критерии эффективности|^фармакокинетические параметры|^endpoints|^efficacy variables|^efficacy criteria|^pharmacokinetic parameters",
    "procedures": "^оценка эффективности|^график.*(визитов|процедур)|^процедуры|^лабораторные (анализы|тесты)|^assessment of efficacy|^schedule of (events|assessments)|^procedures|^laboratory",
    "safety": "^оценка безопасности|^нежелательные (явления|реакции)|^фармаконадзор|^безопасность|^assessment of safety|^adverse (events|reactions)|^pharmacovigilance|^safety",
    "statistics": "^статистик(а)|^статистические методы|^размер выборки|^statistics|^statistical methods|^sample size",
    "data_management": "^работа с данными|^сбор данных|^хранение записей|^управление данными|^data handling|^record keeping|^data management",
    "ethics": "^этика|^этические (вопросы|аспекты)|^информированное согласие|^ethics|^ethical|^informed consent",
    "admin": "^прямой доступ|^контроль качества|^финансирование|^страхование|^публикаци(я|и)|^direct access|^quality control|^financing|^insurance|^publication",
    "appendix": "^приложени(е|я)|^дополнения|^appendix|^appendices|^supplements",
}

#: Zones that each type of document may have (fixed values).
ALLOWED = {"protocol": tuple(PROTOCOL_RULES), "csr": ("overview", "design", "statistics", "safety", "population", "admin", "appendix")}
SURE = 0.9


def normalize_zone(zone: Column, allowed: tuple[str, ...]) -> Column:
    return F.when(zone.isin(*allowed), zone).otherwise("unknown")


def zone_of(path: Column, rules: dict[str, str] | None = None, allowed: tuple[str, ...] | None = None) -> Column:
    """struct(zone, confidence): the first rule that reaches SURE, else the best, the earlier of equal ones.

    A rule's confidence is the share of path segments it matches, and 0.3 of their mean strength: 1
    for a whole segment, 0.7 for four fifths of it, 0.4 for less. Paths without segments, and the
    pseudo-sections, are unknown with confidence 0.
    """
    rules = rules or PROTOCOL_RULES
    allowed = allowed or tuple(rules)
    segments = F.filter(F.transform(F.split(F.coalesce(path, F.lit("")), "/"), F.trim), lambda s: s != "")
    pseudo = path.isNull() | path.isin("", "ROOT", "__FRONTMATTER__", "FOOTNOTES")
    found = []
    for zone, pattern in rules.items():

        def strength(s: Column, pattern: str = pattern) -> Column:
            hit = F.length(F.regexp_extract(s, f"(?iu)(?:{pattern})", 0))
            return F.when(hit == 0, 0.0).when(hit == F.length(s), 1.0).when(hit >= 0.8 * F.length(s), 0.7).otherwise(0.4)

        s = F.transform(segments, _bound(strength))
        total = F.aggregate(s, F.lit(0.0), lambda a, b: a + b)
        hits = F.size(F.filter(s, lambda v: v > 0))
        found.append(F.struct(F.lit(zone).alias("zone"), F.least(F.lit(1.0), hits / F.size(segments) + 0.3 * total / F.size(segments)).alias("confidence")))
    each = F.array(*found)
    sure = F.get(F.filter(each, lambda r: r["confidence"] >= SURE), F.lit(0))
    most = F.array_max(F.transform(each, lambda r: r["confidence"]))
    best = F.get(F.filter(each, lambda r: (r["confidence"] == most) & (most > 0)), F.lit(0))
    chosen = F.coalesce(sure, best)
    none = F.struct(F.lit("unknown").alias("zone"), F.lit(0.0).alias("confidence"))
    return F.when(pseudo | (F.size(segments) == 0) | chosen.isNull(), none).otherwise(F.struct(normalize_zone(chosen["zone"], allowed).alias("zone"), chosen["confidence"].alias("confidence")))


def _bound(f):
    return lambda x: f(x)


def classify(units: DataFrame, rules: dict[str, str] | None = None, allowed: tuple[str, ...] | None = None) -> DataFrame:
    """Adds source_zone and zone_confidence by section_path; each distinct path is classified once."""
    paths = units.select("section_path").distinct().withColumn("z", zone_of(F.col("section_path"), rules, allowed))
    return units.join(paths.select("section_path", F.col("z.zone").alias("source_zone"), F.col("z.confidence").alias("zone_confidence")), "section_path")
