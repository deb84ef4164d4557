"""Payloads of the earlier assistant interface: pools from run steps, citations from messages, the citation gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundq.config import SNIPPET_CHARS, SPAN_CHARS


#: Messages that a page holds.
MESSAGES_MOST = 20


def _get(v: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def pool_from_steps(steps: DataFrame, files: DataFrame) -> DataFrame:
    """(qid, step, rank, file_id, filename, score, snippet) of file-search calls in run steps (qid, step, details VARIANT).

    Results may stand under results, output or documents, scores under score or relevance_score, texts under text, content (also as an
    object) or excerpt; the first that holds something counts. files: file_id, filename.
    """
    calls = steps.select("qid", "step", F.explode(_get("details", "$.tool_calls", "array<variant>")).alias("c")).where(_get("c", "$.type") == "file_search")
    lists = [F.when(F.size(x) > 0, x) for x in (_get("c", f"$.file_search.{name}", "array<variant>") for name in ("results", "output", "documents"))]
    rows = calls.select("qid", "step", F.posexplode(F.coalesce(*lists)).alias("at", "r"))
    text = F.coalesce(*(F.nullif(_get("r", p), F.lit("")) for p in ("$.text", "$.content.text", "$.content", "$.excerpt")), F.lit(""))
    score = F.coalesce(F.nullif(_get("r", "$.score", "double"), F.lit(0.0)), _get("r", "$.relevance_score", "double"), _get("r", "$.score", "double"))
    out = rows.select("qid", "step", (F.col("at") + 1).alias("rank"), F.coalesce(_get("r", "$.file_id"), _get("r", "$.file.id")).alias("file_id"), score.alias("score"), F.substring(text, 1, SNIPPET_CHARS).alias("snippet"))
    return out.join(files, "file_id", "left").select("qid", "step", "rank", "file_id", "filename", "score", "snippet")


def newest(messages: DataFrame, most: int = MESSAGES_MOST) -> DataFrame:
    """The page of messages that is read: the first `most` of each question by position, which counts from the newest."""
    place = F.row_number().over(W.partitionBy("qid").orderBy("position"))
    return messages.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def latest_assistant_message(messages: DataFrame) -> DataFrame:
    """(qid, content): the first assistant message in the order given (qid, position, role, content VARIANT)."""
    return messages.where("role = 'assistant'").groupBy("qid").agg(F.min_by("content", "position").alias("content"))


def citations(messages: DataFrame, files: DataFrame) -> DataFrame:
    """(qid, part, ord, file_id, filename, cited_span) of the file citations of messages (qid, content)."""
    parts = messages.select("qid", F.posexplode(_get("content", "$", "array<variant>")).alias("part", "p")).where(_get("p", "$.type") == "text")
    notes = parts.select("qid", "part", F.posexplode(_get("p", "$.text.annotations", "array<variant>")).alias("ord", "a"))
    out = notes.select("qid", "part", "ord", F.nullif(_get("a", "$.file_citation.file_id"), F.lit("")).alias("file_id"), F.substring(F.coalesce(_get("a", "$.text"), F.lit("")), 1, SPAN_CHARS).alias("cited_span")).where("file_id IS NOT NULL")
    return out.join(files, "file_id", "left").select("qid", "part", "ord", "file_id", "filename", "cited_span")


def message_summary(messages: DataFrame, cited: DataFrame) -> DataFrame:
    """(qid, text_blocks, text_total_len, citations): the text parts and how many file citations they carry."""
    texts = F.filter(F.transform(_get("content", "$", "array<variant>"), lambda p: F.try_variant_get(p, "$.text.value", "string")), lambda t: t.isNotNull())
    counted = cited.groupBy("qid").agg(F.count("*").alias("citations"))
    rows = messages.select("qid", texts.alias("text_blocks"))
    total = F.aggregate("text_blocks", F.lit(0), lambda a, t: a + F.char_length(t))
    return rows.withColumn("text_total_len", total).join(counted, "qid", "left").withColumn("citations", F.coalesce("citations", F.lit(0)))


def gate(answers: DataFrame, least: int = 1, fail: bool = False) -> DataFrame:
    """refused: fewer citations than `least`; with fail such a row stops the query instead."""
    few = F.col("citations") < least
    return answers.withColumn("refused", F.when(few, F.raise_error(F.lit("too few citations")).cast("boolean")).otherwise(F.lit(False)) if fail else few)


def answer_with_sources(text_blocks: Column, sources: Column) -> Column:
    """Blocks, a rule, and the verified sources (array of struct file_id, cited_span)."""
    rule = "-" * 80
    lines = F.transform(sources, lambda s: F.concat(F.lit("- file_id: "), s["file_id"], F.lit("\n  cited_span: "), s["cited_span"]))
    head = F.transform(text_blocks, F.trim)
    return F.trim(F.array_join(F.concat(head, F.array(F.lit(f"\n{rule}"), F.lit("SOURCES (verified)"), F.lit(rule)), lines), "\n"))
