import pytest
from pyspark.sql import functions as F

from vellum.functions import text as X


def value(spark, expression, **columns):
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))
    return row.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("a<b>c</b>d", "acd"), ("1 < 2 > 3", "1  3"), ("x<y", "x"), ("a>b", "ab"), ("", "")],
)
def test_strip_tags(spark, raw, want):
    assert value(spark, X.strip_tags("a"), a=raw) == want


def test_excerpt_and_time(spark):
    assert value(spark, X.excerpt("a"), a=" a\n\tb c ") == "a b c"
    assert value(spark, X.excerpt("a"), a="é" * 201) == "é" * 200 + "…"
    assert value(spark, X.read_time("a"), a="w " * 399) == 1
    assert value(spark, X.read_time("a"), a="w " * 400) == 2
    assert value(spark, X.read_time("a"), a="") == 1


def test_titles(spark):
    assert value(spark, X.clean_title("a"), a="a\x01b\n c") == "a b c"
    assert value(spark, X.clean_title("a"), a="a�b") is None
    assert len(value(spark, X.clean_title("a"), a="x" * 999)) == 300
    assert value(spark, X.page_title("a"), a="<p>") == "Untitled"
    assert value(spark, X.tag_text("a", "title"), a="<title class=x> A\nB </title><title>C</title>") == "A\nB"


def test_case_folding(spark):
    assert not value(spark, X.contains_ascii_ci("a", "é"), a="É")
    assert value(spark, X.contains_unicode_ci("a", "é"), a="É")
    assert value(spark, X.contains_ascii_ci("a", "50% C"), a="at 50% capacity")
    assert not value(spark, X.contains_ascii_ci("a", "50_c"), a="at 50% capacity")


def test_sync_order(spark):
    rows = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00.5+00:00",), ("2024-01-01T00:00:00.500000001Z",), ("2024-01-01T01:00:00+02:00",), ("later",)], "t string")
    got = [r[0] for r in rows.orderBy(X.sync_order("t")).collect()]
    assert got == ["later", "2024-01-01T01:00:00+02:00", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00.5+00:00", "2024-01-01T00:00:00.500000001Z"]


@pytest.mark.parametrize(
    ("at", "words", "short"),
    [
        ("2024-01-01T11:59:50Z", "just now", "now"),
        ("2024-01-01T11:30:00Z", "30 min ago", "30m ago"),
        ("2024-01-01T11:00:00Z", "1 hour ago", "1h ago"),
        ("2023-12-30T12:00:00Z", "2 days ago", "2d ago"),
        ("2023-12-01T12:00:00Z", "31 days ago", "Dec 1"),
        ("nonsense", "never", ""),
        ("2024-01-01T13:00:00Z", "just now", "now"),
    ],
)
def test_relative_times(spark, at, words, short):
    now = F.to_timestamp(F.lit("2024-01-01 12:00:00"))
    assert value(spark, X.relative_time("a", now), a=at) == words
    assert value(spark, X.compact_time("a", now), a=at) == short


def test_tags(spark):
    assert value(spark, X.parse_tags("a"), a='["x","y"]') == ["x", "y"]
    assert value(spark, X.parse_tags("a"), a="{bad") == []
    assert value(spark, X.normalize_tags(X.split_tags("a")), a=" Rust, ÉCOLE,,rust , ") == ["rust", "école"]
    assert value(spark, X.rename_in_tags(X.split_tags("a"), "b", "a"), a="a,b,c") == ["a", "c"]
