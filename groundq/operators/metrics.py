"""Metrics of a test: refusal and audit, retrieval and citation recall, verbatim matches, grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundq.functions.text import clean_quote, fold_space, for_match
from groundq.operators.quotes import is_refusal
from groundq.operators.retrieve import first_wins, last_wins


def base_metrics(answers: DataFrame) -> DataFrame:
    """Five booleans from final_answer, must_refuse, expected (array of texts, any of which may stand in the answer) and audit_passed.

    Without expected texts the hit is true; an audit that the trace lacks counts as passed.
    """
    folded = fold_space(F.col("final_answer"))
    hit = (F.coalesce(F.size("expected"), F.lit(0)) <= 0) | F.exists("expected", lambda x: folded.contains(fold_space(x)))
    out = answers.withColumn("refusal", is_refusal(F.col("final_answer"))).withColumn("refusal_ok", F.col("refusal") == F.col("must_refuse"))
    out = out.withColumn("expected_quote_hit", F.coalesce(hit, F.lit(True))).withColumn("audit_passed", F.coalesce("audit_passed", F.lit(True)))
    return out.withColumn("pass_all", F.col("refusal_ok") & F.col("expected_quote_hit") & F.col("audit_passed"))


def recall_metrics(tests: DataFrame, expected: DataFrame, pool: DataFrame, cited: DataFrame) -> DataFrame:
    """Retrieval and citation recall of each test (qid). expected, cited: qid, key. pool: qid, key, rank, score; of a key the first counts.

    All columns are null for a test without expected keys.
    """
    exp = expected.where("key IS NOT NULL").distinct()
    final = cited.where("key IS NOT NULL").distinct()
    first = first_wins(pool.where("key IS NOT NULL"), ["qid", "key"], "rank", ["rank", "score"]).withColumn("_p", F.lit(1))
    hits = exp.join(first, ["qid", "key"], "left").join(final.withColumn("_c", F.lit(1)), ["qid", "key"], "left")
    each = hits.groupBy("qid").agg(
        F.count("*").alias("expected_total"), F.count("_p").alias("expected_retrieved"), (F.count("_p") / F.count("*")).alias("retrieval_recall_at_20"),
        F.avg("rank").alias("retrieval_mean_rank"), F.avg("score").alias("retrieval_mean_score"), F.count("_c").alias("expected_selected"), (F.count("_c") / F.count("*")).alias("final_recall"),
    )
    unique = final.groupBy("qid").agg(F.count("*").alias("_n"))
    out = tests.select("qid").join(each, "qid", "left").join(unique, "qid", "left")
    n = F.when(F.col("expected_total").isNotNull(), F.coalesce("_n", F.lit(0)))
    return out.withColumn("final_unique_citations", n).withColumn("extra_selected_count", n - F.col("expected_selected")).drop("_n")


def quote_match(quotes: DataFrame, selected: DataFrame, texts: DataFrame) -> DataFrame:
    """Of each qid: quotes checked against their file's text, those that match, the rate, whether all do, and those without a source.

    quotes: qid, quote, chapter, section (null if the reference has none: not counted). selected: qid, rank, chapter, section, filename;
    of a coordinate the last counts. texts: filename, text.
    """
    files = last_wins(selected.where("chapter IS NOT NULL AND section IS NOT NULL AND length(filename) > 0"), ["qid", "chapter", "section"], "rank", ["filename"])
    some = quotes.select("qid", "quote", "chapter", "section").withColumn("_q", clean_quote(F.col("quote"))).where("_q <> '' AND chapter IS NOT NULL AND section IS NOT NULL")
    # each text is normalised once, before it meets its quotes
    normal = texts.where("text IS NOT NULL").select("filename", for_match(F.col("text")).alias("_t"))
    met = some.join(files, ["qid", "chapter", "section"], "left").join(normal, "filename", "left")
    ok = F.col("_t").isNotNull() & F.col("_t").contains(for_match(F.col("_q")))
    each = met.groupBy("qid").agg(F.count("_t").alias("quote_match_checked"), F.count_if(ok).alias("quote_match_count"), F.count_if(F.col("_t").isNull()).alias("quote_match_missing_source"))
    checked = F.nullif(F.col("quote_match_checked"), F.lit(0))
    return each.withColumn("quote_match_rate", F.col("quote_match_count") / checked).withColumn("quote_match_all", F.col("quote_match_count") == checked)


def grade_mean(score: Column, is_int: Column) -> Column:
    """Mean of the scores that are whole numbers from 0 to 5."""
    return F.avg(F.when(is_int & score.between(0, 5), score))


def weighted_mean(a: Column, n_a: Column, b: Column, n_b: Column) -> Column:
    return (F.coalesce(a, F.lit(0.0)) * n_a + F.coalesce(b, F.lit(0.0)) * n_b) / F.nullif(n_a + n_b, F.lit(0))


def expected_quotes(quotes: DataFrame, expected: DataFrame) -> DataFrame:
    return quotes.join(expected, ["qid", "chapter", "section"], "left_semi")


def extra_quotes(quotes: DataFrame, expected: DataFrame) -> DataFrame:
    """Quotes outside the expected set, with those whose reference cannot be read."""
    return quotes.join(expected, ["qid", "chapter", "section"], "left_anti")
