"""Clamps, tolerant numbers and the display of metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: name: (format, better direction). Fixed values of the report.
METRICS = {
    "retrieval_recall_at_20": ("pct0", "up"),
    "retrieval_mean_rank": ("f1", "down"),
    "retrieval_mean_score": ("f2", "up"),
    "selected_pool_scores": ("text", "neutral"),
    "quote_match_rate": ("pct0", "up"),
    "final_recall": ("pct0", "up"),
    "extra_selected_count": ("f1", "down"),
    "answers_mean_relevance": ("f1", "up"),
    "extras_mean_relevance": ("f1", "up"),
    "expected_quotes_mean_relevance": ("f1", "up"),
}


def clamp(c: Column | int, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(c) if isinstance(c, int) else c, F.lit(high)))


def number(c: Column) -> Column:
    """A double; what is no number, and NaN, is null."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def fixed(value: Column, digits: int) -> Column:
    """Digits after the point, rounded half to even on the binary value."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits))


def display(value: Column, kind: str) -> Column:
    """A metric as the report shows it: percent without digits, or a decimal comma. Null to empty."""
    if kind == "text":
        return F.coalesce(value.cast("string"), F.lit(""))
    v = number(value)
    if kind == "pct0":
        out = F.concat(F.rint(v * 100).cast("long").cast("string"), F.lit("%"))
    else:
        out = F.replace(fixed(v, int(kind[1:])), F.lit("."), F.lit(","))
    return F.coalesce(out, F.lit(""))


def change(previous: Column, current: Column, kind: str, better: str) -> Column:
    """good, bad or neutral: neutral for texts, gaps and no change; any direction but up means down."""
    if kind == "text":
        return F.lit("neutral")
    delta = number(current) - number(previous)
    good = delta > 0 if better == "up" else delta < 0
    return F.when(delta.isNull() | (delta == 0), "neutral").when(good, "good").otherwise("bad")


def label(metric: str) -> str:
    """A metric's name in the report: without the prefix of run rows."""
    return metric.removeprefix("m__")


def run_timestamp(ts: Column) -> Column:
    """The time of a run as its folder names it."""
    return F.date_format(ts, "yyyy-MM-dd_HH-mm-ss")


def report_link(run_dir: Column) -> Column:
    """A link to a run's own report; nothing for a run without a folder."""
    escaped = F.replace(F.replace(F.replace(run_dir, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.when(F.length(run_dir) > 0, F.concat(F.lit('<a href="'), escaped, F.lit('/report.html" target="_blank">open</a>'))).otherwise(F.lit(""))
