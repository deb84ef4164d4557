"""A test suite against the answers of a run: one row of metrics a test."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundq.functions.numbers import run_timestamp
from groundq.operators import metrics, quotes
from groundq.operators.pipeline import Run

#: The columns that a test's row has beside its id.
COLUMNS = """refusal refusal_ok expected_quote_hit audit_passed pass_all expected_total expected_retrieved retrieval_recall_at_20 retrieval_mean_rank retrieval_mean_score
expected_selected final_recall final_unique_citations extra_selected_count extras_mean_relevance extras_count_graded expected_quotes_mean_relevance expected_quotes_count_graded
answers_mean_relevance answers_count_graded quote_match_checked quote_match_count quote_match_rate quote_match_all quote_match_missing_source""".split()


def final_citations(items: DataFrame) -> DataFrame:
    """Distinct (qid, chapter, section) that the references of final quotes name."""
    return items.where("chapter IS NOT NULL AND section IS NOT NULL").select("qid", "chapter", "section").distinct()


def graded(scores: DataFrame, prefix: str) -> DataFrame:
    """(qid, <prefix>_mean_relevance, <prefix>_count_graded) of scores (qid, ref, score): the mean of whole numbers from 0 to 5, and how many came back."""
    whole = F.col("score") == F.floor("score")
    return scores.groupBy("qid").agg(metrics.grade_mean(F.col("score"), whole).alias(f"{prefix}_mean_relevance"), F.count("*").alias(f"{prefix}_count_graded"))


def evaluate(tests: DataFrame, run: Run, texts: DataFrame, grade: Callable[[DataFrame, DataFrame], DataFrame] = quotes.grade_by_overlap) -> DataFrame:
    """(qid, then COLUMNS) for each test.

    tests: qid, question, must_refuse, expected (array of struct chapter, section), expected_quotes (array of texts). texts: filename, text.
    grade(questions, quotes) returns qid, ref, score. Recall metrics are null for a test that expects nothing; a test without quotes of a
    kind has a null mean and the count 0.
    """
    answered = tests.select("qid", "must_refuse", F.col("expected_quotes").alias("expected")).join(run.answers.select("qid", "final_answer"), "qid").join(run.meta, "qid")
    base = metrics.base_metrics(answered).select("qid", "refusal", "refusal_ok", "expected_quote_hit", "audit_passed", "pass_all")
    wanted = tests.select("qid", F.inline("expected")).dropna().distinct()
    key = F.struct("chapter", "section").alias("key")
    placed = run.pool.where("chapter IS NOT NULL AND section IS NOT NULL").select("qid", key, "rank", "score")
    recall = metrics.recall_metrics(tests, wanted.select("qid", key), placed, final_citations(run.quotes).select("qid", key))
    questions = tests.select("qid", "question")
    extras = graded(grade(questions, metrics.extra_quotes(run.quotes, wanted).select("qid", "ref", "quote")), "extras")
    expected = graded(grade(questions, metrics.expected_quotes(run.quotes, wanted).select("qid", "ref", "quote")), "expected_quotes")
    matched = metrics.quote_match(run.quotes, run.pool.where("selected = 'Y'"), texts)
    out = base.join(recall, "qid").join(extras, "qid", "left").join(expected, "qid", "left").join(matched, "qid", "left")
    zero = [c for c in COLUMNS if c.endswith("_count_graded") or c in ("quote_match_checked", "quote_match_count", "quote_match_missing_source")]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in zero if c in out.columns})
    both = [F.col(c) for c in ("extras_mean_relevance", "extras_count_graded", "expected_quotes_mean_relevance", "expected_quotes_count_graded")]
    out = out.withColumns({"answers_mean_relevance": metrics.weighted_mean(*both), "answers_count_graded": both[1] + both[3]})
    return out.select("qid", *COLUMNS)


def results(tests: DataFrame, run: Run, measured: DataFrame, *, version: str | None, suite_id: str, mode: str, corpus_id: str) -> DataFrame:
    """The rows that a run stores: the test, its answer, its metrics as one struct, and the run's own values in each of them."""
    row = tests.withColumnRenamed("qid", "id").join(run.answers.select(F.col("qid").alias("id"), "final_answer"), "id")
    row = row.join(measured.select(F.col("qid").alias("id"), F.struct(*COLUMNS).alias("metrics")), "id")
    fields = {"pipeline_version": version or "no_git", "suite_id": suite_id, "mode": mode, "corpus_id": corpus_id, "engine_mode": "v2"}
    return row.withColumns({n: F.lit(v) for n, v in fields.items()}).withColumn("timestamp", run_timestamp(F.current_timestamp()))


def for_corpora(tests: DataFrame, corpora: DataFrame) -> DataFrame:
    """Each test once for each corpus of the registry, which is a handful of rows."""
    return tests.join(F.broadcast(corpora.select("corpus_id", "reference_label", "retrieval_k", "selection_k")), F.lit(True))
