"""Text functions on example tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from stemma.functions import text as T


def one(spark, column, *values):
    names = [f"v{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} {'string' if not isinstance(v, list) else 'array<string>'}" for n, v in zip(names, values)))
    return df.select(column(*map(F.col, names)).alias("x")).first().x


@pytest.mark.parametrize("text, want", [("1 200", 1200), ("1,200", 1200), ("0", None), ("1000001", None), ("12.5", None), ("abc", None), (None, None)])
def test_int(spark, text, want):
    assert one(spark, T.parse_int, text) == want


@pytest.mark.parametrize("text, want", [("12,5", 12.5), ("3.25", 3.25), ("x", None)])
def test_float(spark, text, want):
    assert one(spark, T.parse_float, text) == want


@pytest.mark.parametrize("text, want", [("18-65", (18, 65)), ("65-18", None), ("18 to 65", (18, 65)), ("от 18 до 65", (18, 65)), ("none", None)])
def test_range(spark, text, want):
    got = one(spark, T.parse_range, text)
    assert (got and tuple(got)) == want


@pytest.mark.parametrize("text", ["2:1", "2/1", "2 к 1", "2 to 1"])
def test_ratio(spark, text):
    assert one(spark, T.parse_ratio, text) == "2:1"


@pytest.mark.parametrize("text, want", [("12 weeks", (12.0, "week")), ("6 месяцев", (6.0, "month")), ("5 дней", (5.0, "day")), ("soon", None)])
def test_duration(spark, text, want):
    got = one(spark, T.parse_duration, text)
    assert (got and tuple(got)) == want


@pytest.mark.parametrize("text", ["05.03.2021", "05/03/2021", "5 Mar 2021", "5 марта 2021", "2021-03-05"])
def test_date(spark, text):
    assert one(spark, T.parse_date, text) == datetime.date(2021, 3, 5)


def test_bad_date(spark):
    assert one(spark, T.parse_date, "32.13.2021") is None


def test_normalisation(spark):
    assert one(spark, T.collapse_space, "  a\u00a0\n b ") == "a b"
    assert one(spark, T.normalize_match, "Ёлка — «Тест»") == "елка тест"
    assert one(spark, T.normalize_title, "\u200bTitle :") == "Title"
    assert len(one(spark, T.normalize_title, "x" * 300)) == 120
    assert one(spark, T.language_by_script, "это русский текст") == "ru"
    assert one(spark, T.language_by_script, "plain english") == "en"
    assert one(spark, T.language_by_script, "русский текст здесь and english text here") == "mixed"
    assert one(spark, T.language_by_script, "123") == "unknown"


@pytest.mark.parametrize("a, b, want", [("1/2/3", "1/2/4", 2 / 3), ("a/b/c", "a/b/c", 1.0), ("a/b", "a/b/c", 2 / 3), ("", "a", 0.0), ("x", "y", 0.0)])
def test_path_prefix(spark, a, b, want):
    assert one(spark, T.path_prefix_ratio, a, b) == pytest.approx(want)


@pytest.mark.parametrize("a, b, want", [(["a"], ["a"], 1.0), (["a"], ["b"], 0.0), (["a", "b"], ["b", "c"], 1 / 3), ([], [], 1.0), ([], ["a"], 0.0)])
def test_jaccard(spark, a, b, want):
    assert one(spark, T.jaccard, a, b) == pytest.approx(want)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r.x for r in df.select(T.cosine(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == pytest.approx([2**-0.5, 0.0, 0.0])


def test_visits(spark):
    assert one(spark, T.visit_number, "Визит № 3") == 3
    assert one(spark, T.day_value, "Day -7") == -7
    assert tuple(one(spark, T.day_window, "Day 5 ± 2")) == (2, 2)
    assert tuple(one(spark, T.day_window, "-1/+3 days")) == (1, 3)
    assert one(spark, T.first_sentences, "One. Two! Three?") == "One. Two!"
