"""HTML entities and chapter headings. Spark has no unescape, so that one function runs in Python over Arrow batches."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from groundq.functions.text import fold_space, line_feeds, roman


def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


unescaped = F.pandas_udf(_unescape, StringType())


def plain(c: Column) -> Column:
    return unescaped(F.translate(F.regexp_replace(line_feeds(c), r"^\x{FEFF}+", ""), "\u2028\u2029", "\n\n"))


def one_line(c: Column) -> Column:
    return fold_space(plain(c))


def paragraph(c: Column) -> Column:
    """Lines of a paragraph joined by single spaces, each trimmed; blank ones go."""
    lines = F.transform(F.split(F.regexp_replace(plain(c), "[ \t]+", " "), r"\s*\n\s*"), F.trim)
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def heading(c: Column) -> Column:
    """struct(number, title) of "CHAPTER XVII. TITLE"; null for what is missing. c is one line."""
    number = roman(F.regexp_extract(c, r"(?i)\bCHAPTER\s+([IVXLCDM]+)\b\.?", 1))
    title = F.nullif(F.trim(F.regexp_replace(c, r"(?i)^\s*CHAPTER\s+[IVXLCDM]+\s*\.?\s*", "")), F.lit(""))
    return F.struct(number.alias("number"), title.alias("title"))
