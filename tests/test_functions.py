"""Vectors of the scalar functions, by hand."""

import pytest
from pyspark.sql import functions as F

from groundq.functions import html as H
from groundq.functions import numbers as N
from groundq.functions import refs as R
from groundq.functions import text as T


def one(spark, make, *values):
    kinds = [{str: "string", int: "bigint", float: "double", type(None): "string"}[type(v)] for v in values]
    df = spark.createDataFrame([values], ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
    return df.select(make(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first().x


@pytest.mark.parametrize("value,want", [("XIV", 14), ("XVII", 17), ("MCMXC", 1990), ("IIII", 4), ("ABC", None), ("", None), (" xiv ", 14), (None, None)])
def test_roman(spark, value, want):
    assert one(spark, T.roman, value) == want


@pytest.mark.parametrize("value,want", [("##T", "## T"), ("## T", "# # T"), ("# T", "# T"), ("### Sec", "## # Sec"), ("a\r\nb \n\n  # T", "a\nb\n# T"), ("﻿x", "x")])
def test_markdown_in_its_known_form(spark, value, want):
    assert one(spark, T.canonical_markdown, value) == want


def test_markdown_with_spaced_headers_kept(spark):
    assert one(spark, lambda c: T.canonical_markdown(c, strict=False), "## T\n###S") == "## T\n### S"


@pytest.mark.parametrize("name,strict,loose", [("b_ch_07_title.txt", (None, None), (7, None)), ("b_ch_123_x_s01_y.txt", (12, 1), (12, 1)), ("B_CH_1_x_S2_y", (1, 2), (1, 2)), (None, (None, None), (None, None)), ("", (None, None), (None, None))])
def test_file_coordinates(spark, name, strict, loose):
    assert tuple(one(spark, R.file_coordinates, name)) == strict
    assert tuple(one(spark, R.file_coordinates_or_chapter, name)) == loose


def test_refs(spark):
    assert tuple(one(spark, R.ref_coordinates, "L, Ch. 13 — T,  §5 — U")) == (13, 5)
    assert tuple(one(spark, R.ref_coordinates, "L, Ch. 13 — T,\n §5 — U")) == (None, None)
    assert one(spark, lambda c: R.readable_ref(c, "L"), "x_ch_13_of_the_state_s05_no_title.txt") == "L, Ch. 13 — Of The State, §5 — No Title"
    assert one(spark, lambda c: R.readable_ref(c, "L"), "x_ch_03_of_common-wealth.txt") == "L, Ch. 3 — Of Common-wealth"
    assert one(spark, lambda c: R.readable_ref(c, "L"), " notes.txt ") == "notes.txt"
    assert one(spark, R.answer_items, "q1\nr1\n\n\n\nq2")[0].ref == "r1"


@pytest.mark.parametrize("value,want", [('"He" Label, Ch. 13, §5', "He"), ("'x' book_x.txt, Ch. 1, §2", "x"), ('"', '"'), (None, ""), ("plain", "plain")])
def test_clean_quote(spark, value, want):
    assert one(spark, T.clean_quote, value) == want


def test_slugs(spark):
    assert one(spark, T.slug_keep_hyphen, "OF THE CAUSES, OF A COMMON-WEALTH") == "of_the_causes_of_a_common-wealth"
    assert one(spark, T.slug_keep_hyphen, "***") == "no_title"
    assert one(spark, T.safe_slug, "a b/c") == "a_b_c"
    assert one(spark, T.slug, " Été, 2! ") == "t_2"
    assert one(spark, T.short_slug, "a" * 80) == "a" * 80
    short = one(spark, T.short_slug, "a" * 81)
    assert len(short) == 80 and short[:74] == "a" * 73 + "_"


def test_matching(spark):
    assert one(spark, T.for_match, "‘A’ \t\x1c“B”\r\n ") == "'a' \"b\""
    assert one(spark, T.fold_space, None) == ""


@pytest.mark.parametrize("value,want", [("[1]", None), ('x {"a":1} y', '{"a":1}'), ("nope", None), ('{"a":{"b":2}}', '{"a":{"b":2}}'), ("null", None), ("", None), (None, None), ("{a", None)])
def test_json_object(spark, value, want):
    assert one(spark, lambda c: F.to_json(T.json_object(c)), value) == want


def test_html(spark):
    assert one(spark, H.one_line, " a&amp;b\r\n&eacute; ") == "a&b é"
    assert one(spark, H.paragraph, "a \t b \n c") == "a b c"
    assert tuple(one(spark, lambda c: H.heading(H.one_line(c)), "CHAPTER XVII. OF X")) == (17, "OF X")
    assert tuple(one(spark, lambda c: H.heading(c), "Introduction")) == (None, "Introduction")
    assert one(spark, T.html_escape_quotes, "<a b='\"'>&") == "&lt;a b=&#x27;&quot;&#x27;&gt;&amp;"


@pytest.mark.parametrize("value,kind,want", [(0.25, "f1", "0,2"), (0.15, "f1", "0,1"), (2.675, "f2", "2,67"), (0.125, "pct0", "12%"), (0.135, "pct0", "14%"), (float("nan"), "f1", ""), (-0.5, "f1", "-0,5")])
def test_display(spark, value, kind, want):
    assert one(spark, lambda c: N.display(c, kind), value) == want


@pytest.mark.parametrize("before,now,better,want", [(3.0, 2.0, "down", "good"), (1.0, 1.0, "up", "neutral"), (2.0, 1.0, "up", "bad"), (float("nan"), 1.0, "up", "neutral"), (1.0, 2.0, "other", "bad")])
def test_change(spark, before, now, better, want):
    assert one(spark, lambda a, b: N.change(a, b, "f1", better), before, now) == want


@pytest.mark.parametrize("k,want", [(0, 1), (20, 20), (99, 50)])
def test_clamp(spark, k, want):
    assert one(spark, lambda c: N.clamp(c, 1, 50), k) == want
