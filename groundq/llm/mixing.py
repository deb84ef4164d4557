"""Mixing to target weights: soft domain membership, and non-negative rates by projected-gradient least squares."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundq.llm.shared import dropped, written

#: Levels of each feature: logarithmic, the last one open.
LEVELS = 10
INSULTS = "idiot stupid moron trash scum loser clown worthless pathetic disgusting"


def words(text: Column) -> Column:
    """Tokens as mixing counts them: runs of what is no white space."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def _level(count: Column, out_of: Column) -> Column:
    rate = count * 1000.0 / F.greatest(out_of, F.lit(1))
    return F.least(F.lit(LEVELS - 1), F.floor(F.log2(1.0 + rate))).cast("int")


def levels(text: Column, tokens: Column) -> list[Column]:
    """The features of a whole text, each a level from 0 to LEVELS - 1."""
    size = F.char_length(text)

    def times(piece: str) -> Column:
        return (size - F.char_length(F.replace(text, F.lit(piece)))) / len(piece)

    def matches(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    return [
        _level(matches(r"[%*&$#|@^~<>{}]"), size),
        _level(times("!"), size),
        _level(matches(r"[A-Z]"), size),
        _level(matches(r"[0-9]"), size),
        _level(F.octet_length(text) - size, size),
        _level(matches(r"(?i)\b(?:" + INSULTS.replace(" ", "|") + r")\b") * 10, tokens),
        _level(times("\n"), size),
        _level(matches(r"(?<!\S)(\S++)\s++\1(?!\S)"), tokens),
        F.least(F.lit(LEVELS - 1), F.coalesce(F.floor(F.log2(F.try_divide(size, tokens))), F.lit(0))).cast("int"),
        F.least(F.lit(LEVELS - 1), F.floor(F.log2(1.0 + tokens) / 1.5)).cast("int"),
    ]


@dataclass
class Mixture:
    """What the fit leaves: log probabilities by domain, feature and level, and the steps that lead from the first rate to the last."""

    domains: list[str]
    prior: list[float]
    tables: list[list[list[float]]]
    first: float
    steps: list[list[float]]
    totals: list[float]
    targets: list[float]
    settled: bool = True

    def posterior(self, bins: list[Column]) -> Column:
        """The probability of each domain, an array in the order of domains."""
        logs = []
        for prior, tables in zip(self.prior, self.tables, strict=True):
            total = F.lit(prior)
            for table, level in zip(tables, bins, strict=True):
                total = total + F.get(F.lit(table), level)
            logs.append(total)
        most = F.greatest(*logs) if len(logs) > 1 else logs[0]
        return F.array(*(F.exp(x - most) for x in logs))

    def rate(self, posterior: Column) -> Column:
        """max(0, ...) once for each step: the rates after the last one."""
        rate = F.lit(self.first)
        for step in self.steps:
            move = F.lit(0.0)
            for d, s in enumerate(step):
                move = move + F.get(posterior, F.lit(d)) * s
            rate = F.greatest(F.lit(0.0), rate - move)
        return rate


def _normal(posterior: str) -> Column:
    return F.expr(f"transform({posterior}, x -> x / aggregate({posterior}, 0D, (a, b) -> a + b))")


def _features(docs: DataFrame, text: str, *columns: Column) -> DataFrame:
    read = docs.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_tokens", words(F.col("_text")))
    return read.withColumn("_bins", F.array(*levels(F.col("_text"), F.col("_tokens"))))


def fit_mixture(features: DataFrame, labelled: DataFrame, targets: dict[str, float], *, budget: float | None = 1.0, rounds: int = 30, close: float = 1e-3) -> Mixture:
    """features: id, tokens, bins. labelled: id, domain. The table's counts (domains x features x levels) are all that reaches the driver.

    The classifier is a naive Bayes over the levels with counts of all labelled rows. Rates minimise the squares of the differences between
    expected domain totals (the sum of rate x tokens x posterior) and targets x budget x all tokens, each over the domain's total at rate 1,
    by projected gradient from the rate `budget`. Rows of equal levels move alike, so the iterations run over their sums: one aggregate
    each, whose result, a number for each domain, is the next step. Steps end once every domain is within `close` of its target, or after
    `rounds`. `settled` says whether the targets are met or the totals no longer move (the targets are out of reach then, and the totals
    the nearest ones); where neither is so, a warning gives both. The budget None stands for the largest mix that repeats no domain: that in which the
    scarcest one, measured by its target, has the rate 1.
    """
    domains = sorted(targets)
    n_features = len(levels(F.lit(""), F.lit(1)))
    known = labelled.where(F.col("id").isNotNull() & F.col("domain").isin(domains)).select("id", "domain").distinct()
    counts = (
        features.select("id", "bins").join(known, "id").select("domain", F.posexplode("bins").alias("feature", "level")).groupBy("domain", "feature", "level").count().collect()
    )
    seen = {(r.domain, r.feature, r.level): r["count"] for r in counts}
    rows = {d: sum(seen.get((d, 0, v), 0) for v in range(LEVELS)) for d in domains}
    every = sum(rows.values())
    prior = [math.log((rows[d] + 1) / (every + len(domains))) for d in domains]
    tables = [[[math.log((seen.get((d, f, v), 0) + 0.5) / (rows[d] + 0.5 * LEVELS)) for v in range(LEVELS)] for f in range(n_features)] for d in domains]
    mixture = Mixture(domains, prior, tables, 1.0 if budget is None else float(budget), [], [], [])

    grouped = features.groupBy("bins").agg(F.sum("tokens").alias("tokens"))
    grouped = grouped.withColumn("p", mixture.posterior([F.get("bins", F.lit(i)) for i in range(n_features)]))
    grouped = written(grouped.select("tokens", _normal("p").alias("p")), "posteriors")

    def totals() -> list[float]:
        rate = mixture.rate(F.col("p"))
        sums = grouped.agg(*(F.sum(rate * F.col("tokens") * F.get("p", F.lit(d))).alias(f"t{d}") for d in range(len(domains)))).first()
        return [float(x or 0.0) for x in sums]

    now = totals()
    at_one = [x / mixture.first for x in now] if mixture.first else [0.0] * len(domains)
    weights = [max(0.0, targets[d]) for d in domains]
    shares = [w / (sum(weights) or 1.0) for w in weights]
    if budget is None:
        budget = min((a / (w * sum(at_one)) for a, w in zip(at_one, shares, strict=True) if w > 0 and a > 0), default=1.0)
        mixture.first, now = budget, [a * budget for a in at_one]
    mixture.targets = [w * budget * sum(at_one) for w in shares]
    reached = lambda: all(abs(a - t) <= close * max(t, close * sum(at_one)) for a, t in zip(now, mixture.targets, strict=True))
    before = now
    for _ in range(rounds):
        if reached():
            break
        mixture.steps.append([(a - t) / s if s > 0 else 0.0 for a, t, s in zip(now, mixture.targets, at_one, strict=True)])
        before, now = now, totals()
    mixture.settled = reached() or all(abs(a - b) <= 1e-6 * sum(at_one) for a, b in zip(now, before, strict=True))
    if not mixture.settled and close > 0:
        warnings.warn(f"rates have not settled after {rounds} rounds: {dict(zip(domains, now, strict=True))} of {dict(zip(domains, mixture.targets, strict=True))}", stacklevel=2)
    mixture.totals = now
    dropped(grouped)
    return mixture


def _copies(rate: Column, *keys: str) -> Column:
    """The rate rounded up or down by a hash of the row, so that copies are right on average and the same each time."""
    unit = F.pmod(F.xxhash64(*keys, F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (F.floor(rate) + (unit < rate - F.floor(rate)).cast("int")).cast("long")


def mix_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, id: str, text: str, **how) -> DataFrame:
    """For each document its tokens, domain posteriors (a struct of a column p_<domain> each), rate and copies.

    A null text is empty: no tokens, so its rate moves nothing. Null ids are kept and are never labelled. Rows that repeat count as often
    and get the same rate. Domains of labelled rows that are no target are left out; a target without labelled rows keeps a small prior;
    without any labelled row all posteriors are equal. Rates that no mix can reach end at the nearest totals in the least-squares sense.
    Other columns are dropped, so clashing names do no harm. An empty table gives an empty result. Result: id, tokens, posterior, rate,
    copies.
    """
    features = written(_features(docs, text, F.col(id).alias("id")).select("id", F.col("_tokens").alias("tokens"), F.col("_bins").alias("bins")), "mix-features")
    mixture = fit_mixture(features, labelled, targets, **how)
    n = len(mixture.tables[0])
    out = features.withColumn("p", mixture.posterior([F.get("bins", F.lit(i)) for i in range(n)])).withColumn("p", _normal("p"))
    out = out.withColumn("rate", mixture.rate(F.col("p"))).withColumn("copies", _copies(F.col("rate"), "id"))
    posterior = F.struct(*(F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(mixture.domains)))
    return out.select(F.col("id").alias(id), "tokens", posterior.alias("posterior"), "rate", "copies")


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, id: str, text: str, **how) -> DataFrame:
    """The rows of docs, all columns, each as often as its copies say (a rate below 1 leaves some out, one above 1 repeats some).

    Each row is written once beside its features, so that the texts are read and measured once.
    """
    rows = _features(docs, text, F.struct("*").alias("_row"), F.col(id).alias("id"))
    rows = written(rows.select("_row", "id", F.col("_tokens").alias("tokens"), F.col("_bins").alias("bins")), "mix-rows")
    mixture = fit_mixture(rows.select("id", "tokens", "bins"), labelled, targets, **how)
    n = len(mixture.tables[0])
    out = rows.withColumn("p", mixture.posterior([F.get("bins", F.lit(i)) for i in range(n)])).withColumn("p", _normal("p"))
    return out.select("_row", F.explode(F.array_repeat(F.lit(1), _copies(mixture.rate(F.col("p")), "id").cast("int")))).select("_row.*")
