"""URL filters: rules of (host, path) on hosts, their subdomains and path prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 16


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased. Empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end. Empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _expressions(host: Column, path: Column, longest_host: int, longest_path: int) -> Column:
    """Every host suffix at a dot joined to every path prefix that ends with a slash, if no longer than any rule's."""
    path = F.substring(path, 1, longest_path)
    tail = F.regexp_replace(F.right(host, F.lit(longest_host + 1)), r"^[^.]*\.?", "")
    host = F.when(F.length(host) > longest_host, tail).otherwise(host)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split(path, "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))
    )
    prefixes = F.when(F.size(parts) > 1, prefixes).otherwise(F.array(F.lit("")))
    every = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\n"), p))))
    return F.when(host != "", F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def _short(expression: Column) -> Column:
    """Four bytes of the digest; what the join runs on."""
    return F.conv(F.substring(F.sha2(expression, 256), 1, 8), 16, 10).cast("long")


def filter_urls(rows: DataFrame, rules: DataFrame, *, url: str, keys: list[str], default: str = "allow") -> DataFrame:
    """The verdict of the longest rule that fits each row's url.

    rules: columns action ("allow" or "block"), host, path (with its leading slash, or empty). A rule fits its host and all subdomains
    if the url's path starts with the rule's path. The longest host + path wins; of equals the longer host, then block.

    Each url is expanded, where it is read, into host-suffix and path-prefix expressions, which meet the rules in an equi-join on four
    bytes of their digest and a salt, so that an expression of a third of all rows (com/) is spread over many tasks if Spark does not
    broadcast the rules. What meets is confirmed by the full digest and the rule's whole path. The best rule of a row is an aggregate over
    a row number, which combines before its shuffle: one small row a url goes through it.

    Nulls: a null url, or one without ://, has an empty host and path, meets no rule and gets the default; null keys are kept. Rows that
    repeat come back as often as they came. An empty rules table gives every row the default. Columns besides keys and url are dropped,
    so names that clash (host, path, rule, verdict) in the input do no harm unless they are keys. Result: keys, host, path, rule (the
    rule's host + path, without the leading slash of an empty path; else null), verdict.
    """
    kept = {k: f"key_{i}" for i, k in enumerate(keys)}
    ids = list(kept.values())
    pages = rows.select(F.monotonically_increasing_id().alias("rid"), *(F.col(k).alias(i) for k, i in kept.items()), F.col(url).alias("url"))
    pages = pages.select("rid", *ids, url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    # a rule path that ends within a segment joins at its last slash and is confirmed by its whole path
    folder = F.regexp_extract("rule_path", r"(?s)^(.*/)?", 1)
    rule = (
        rules.select(F.col("action"), F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"))
        .where(F.col("rule_host").isNotNull() & (F.col("rule_host") != ""))
        .withColumn("expression", F.concat("rule_host", F.lit("\n"), F.when(folder == "", F.lit("")).otherwise(folder)))
        .select("action", "rule_host", "rule_path", F.sha2("expression", 256).alias("digest"), _short(F.col("expression")).alias("short"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    longest = rule.agg(F.max(F.length("rule_host")), F.max(F.length("rule_path"))).first()
    most = [x or 0 for x in longest]
    asked = F.explode_outer(F.array_union(_expressions(F.col("host"), F.col("path"), *most), _expressions(F.col("host"), F.lit(""), *most)))
    asks = (
        pages.withColumn("expression", asked)
        .withColumn("short", _short(F.col("expression")))
        .withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int"))
    )
    met = asks.join(rule, ["short", "salt"], "left")
    fits = (F.col("digest") == F.sha2("expression", 256)) & F.expr("startswith(path, rule_path)")
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("a"),
        F.length("rule_host").alias("b"),
        (F.col("action") == "block").cast("int").alias("c"),
    )
    best = met.groupBy("rid", *ids, "host", "path").agg(F.max(F.when(fits, F.struct(rank.alias("rank"), "action", "rule_host", "rule_path"))).alias("best"))
    name = F.concat("best.rule_host", F.when(F.col("best.rule_path") == "", F.lit("/")).otherwise(F.col("best.rule_path")))
    return best.select(
        *(F.col(i).alias(k) for k, i in kept.items()),
        "host",
        "path",
        F.when(F.col("best").isNotNull(), name).alias("rule"),
        F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"),
    )
