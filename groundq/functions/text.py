"""White space, quotation marks, slugs, markdown and numerals as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundq.config import REFERENCE_CHAPTER, REFERENCE_FILE, REFERENCE_LABEL, SLUG_CHARS

#: White space in the sense of Unicode, with the four ASCII separators that Java leaves out.
SPACE = r"[\s\x1c-\x1f]"
# Fixed values.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def fold_space(c: Column) -> Column:
    """White space runs to single spaces, none at the ends; null to empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?U){SPACE}+", " "))


def for_match(c: Column) -> Column:
    """What two texts are compared by: folded space, straight quotation marks, lower case."""
    return F.lower(fold_space(F.translate(c, "’‘“”", "''\"\"")))


def line_feeds(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def without_reference(c: Column, before: str) -> Column:
    """c up to a chapter reference that `before` introduces, if it has one."""
    return strip(F.regexp_replace(c, rf"(?idU)\s+{before}{REFERENCE_CHAPTER}", ""))


def clean_quote(c: Column) -> Column:
    """The quotation alone: a reference at its end, by file or by label, and one pair of marks around it are taken off."""
    q = strip(F.coalesce(c, F.lit("")))
    for before in (REFERENCE_FILE, f"(?:{REFERENCE_LABEL})?"):
        q = without_reference(q, before)
    wrapped = q.rlike(r"(?s)^(['\"]).*\1\z")
    return F.when(wrapped, strip(F.substring(q, F.lit(2), F.char_length(q) - 2))).otherwise(q)


def safe_slug(c: Column) -> Column:
    """For folder names: what is not a letter, digit, dot, underscore or hyphen becomes one underscore; cut."""
    return F.substring(F.regexp_replace(c, r"[^a-zA-Z0-9._-]+", "_"), 1, SLUG_CHARS)


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(strip(c)), r"[^a-z0-9]+", "_"), F.lit("_"))


def slug_keep_hyphen(c: Column) -> Column:
    """Runs of spaces and underscores become one underscore, hyphens stay, the rest goes; no_title if nothing is left."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower(fold_space(c)), r"[^a-z0-9\-\s]", ""), F.lit(r"[^\s_]+"), F.lit(0))
    return F.coalesce(F.nullif(F.array_join(words, "_"), F.lit("")), F.lit("no_title"))


def short_slug(c: Column, most: int = SLUG_CHARS) -> Column:
    """Longer slugs end in six digits of their MD5."""
    short = F.concat(F.substring(c, 1, most - 7), F.lit("_"), F.substring(F.md5(c.cast("binary")), 1, 6))
    return F.when(F.char_length(c) > most, short).otherwise(c)


def title_from_slug(c: Column) -> Column:
    """Words between underscores, each with a capital, joined by spaces."""
    words = F.filter(F.split(c, "_"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.char_length(w))))), " ")


def canonical_markdown(c: Column, strict: bool = True) -> Column:
    """Line ends, separators and headers in one form.

    strict keeps a known quirk: a header of two or more marks that already has its space is split ("## T" to "# # T"), as the marks give
    one back. Without it such headers stay.
    """
    text = F.regexp_replace(line_feeds(c), r"^\x{FEFF}+", "")
    text = F.translate(text, "\u2028\u2029", "\n\n")
    text = F.regexp_replace(text, r"(?md)^(#{1,6})(\S)" if strict else r"(?md)^(#{1,6})([^#\s])", "$1 $2")
    return F.regexp_replace(text, r"(?mdU)^\s+(#{1,6}\s+)", "$1")


def roman(c: Column) -> Column:
    """The value of a numeral read from the right, also of ones that are not canonical (IIII); null for anything else."""
    digits = F.upper(strip(c))
    worth = F.create_map(*(F.lit(x) for pair in ROMAN.items() for x in pair))
    values = F.transform(F.split(F.reverse(digits), ""), lambda x: F.try_element_at(worth, x))
    total = F.aggregate(
        values,
        F.struct(F.lit(0).alias("t"), F.lit(0).alias("p")),
        lambda a, v: F.when(v < a["p"], F.struct((a["t"] - v).alias("t"), a["p"].alias("p"))).otherwise(F.struct((a["t"] + v).alias("t"), v.alias("p"))),
        lambda a: a["t"],
    )
    return F.when(digits.rlike("^[IVXLCDM]+$") & (total > 0), total)


def html_escape(c: Column) -> Column:
    """& < > only; null to empty."""
    out = F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_escape_quotes(c: Column) -> Column:
    out = F.replace(html_escape(c), F.lit('"'), F.lit("&quot;"))
    return F.replace(out, F.lit("'"), F.lit("&#x27;"))


def json_object(c: Column) -> Column:
    """The object that a reply holds, as VARIANT: the whole reply, or else from its first brace to its last. Null for anything else."""
    text = strip(c)
    whole = F.try_parse_json(text)
    inner = F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))
    found = F.coalesce(whole, inner)
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), found)
