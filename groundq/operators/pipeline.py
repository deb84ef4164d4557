"""From questions and their pools to answers, with all that a run leaves behind: quotes, selection view, coverage, trace rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundq.config import SELECTION_K
from groundq.functions.refs import readable_ref, ref_coordinates
from groundq.functions.text import strip
from groundq.operators import quotes, trace
from groundq.operators.retrieve import flag_by_rank

NO_POOL = "No retrieval_pool event found"
NO_QUOTE = "No verified quote extracted from fixed context"


@dataclass
class Run:
    """What a batch of questions gives. answers: qid, final_answer, refused, files. pool: with its flags. quotes: qid, ord, quote, filename, ref,
    chapter, section. sources: the selected rows aligned with the pool. view: the selection view. summary: a row a question.
    events: qid, seq, event, data (JSON). meta: qid, audit_passed, audit_reason."""

    answers: DataFrame
    pool: DataFrame
    quotes: DataFrame
    sources: DataFrame
    view: DataFrame
    summary: DataFrame
    events: DataFrame
    meta: DataFrame


def asked(questions: DataFrame) -> DataFrame:
    """questions (qid, question); a blank one stops the query, as there is nothing to retrieve for it."""
    blank = strip(F.coalesce("question", F.lit(""))) == ""
    return questions.withColumn("question", F.when(blank, F.raise_error(F.lit("a question is empty")).cast("string")).otherwise(F.col("question")))


def run_pipeline(questions: DataFrame, pool: DataFrame, sections: DataFrame, *, extract: Callable[[DataFrame], DataFrame] = quotes.extract_by_overlap, k: int = SELECTION_K, label: str = "Source") -> Run:
    """questions: qid, question. pool: qid, rank, filename, score, passage, and chapter and section or else those of the file name. sections: filename, text.

    The first k rows of each pool are selected; extract(qid, question, rank, filename, passage) proposes quotes of them, those that stand verbatim in
    their passage are kept, and a question without any is refused: its audit fails, and its selection view carries no quotes. A question
    without a pool gets an empty summary with a note.
    """
    if "chapter" not in pool.columns:
        pool = pool.withColumns({"chapter": F.lit(None).cast("int"), "section": F.lit(None).cast("int")})
    pool = flag_by_rank(trace.with_coordinates(pool), k)
    selected = pool.where("selected = 'Y'")
    verified = quotes.verify(extract(selected.join(questions, "qid")), selected)
    answers = quotes.formatted(questions, verified, label)
    ref = readable_ref(F.col("filename"), label)
    items = verified.where((F.col("quote") != "") & (strip(F.col("filename")) != "")).withColumn("ref", ref).withColumn("at", ref_coordinates(F.col("ref"))).select("*", "at.*").drop("at")
    sources = trace.align(selected.select("qid", "rank", "filename", "chapter", "section"), pool, "filename")
    found = trace.coverage(pool, sources, "filename").join(trace.selection_summary(pool), "qid")
    summary = questions.select("qid").join(found, "qid", "left").withColumn("note", F.when(F.col("pool_files").isNull(), F.lit(NO_POOL)))
    meta = answers.select("qid", (~F.col("refused")).alias("audit_passed"), F.when(F.col("refused"), F.lit(NO_QUOTE)).alias("audit_reason"))
    return Run(answers, pool, items, sources, trace.selection_view(pool, items, sections), summary, _events(answers, pool, sources, items, k), meta)


def _events(answers: DataFrame, pool: DataFrame, sources: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The steps of each question in order; what a step found is JSON, built beside the rows."""
    listed = lambda rows, name, *fields: rows.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct(*fields))), lambda x: x).alias(name))
    each = answers.join(listed(pool, "pool", "rank", "filename", "score", "chapter", "section", "selected"), "qid", "left")
    each = each.join(listed(sources, "sources", "rank", "filename", "retrieval_rank", "retrieval_score"), "qid", "left").join(listed(items, "quotes", "ord", "quote", "ref"), "qid", "left")
    count = lambda c: F.coalesce(F.size(c), F.lit(0)) if isinstance(c, str) else c
    data = lambda **fields: F.to_json(F.struct(*(v.alias(n) for n, v in fields.items()))) if fields else F.lit("{}")
    steps: list[tuple[str, Column]] = [
        ("pipeline_start", data()),
        ("retrieval_pool", data(count=F.greatest(count("pool"), F.lit(0)), pool=F.col("pool"))),
        ("retrieval_selection", data(strategy=F.lit("top_k"), selected_count=F.greatest(count("sources"), F.lit(0)), selection_k=F.lit(k))),
        ("assistant_message_extracted", data(sources_count=F.greatest(count("sources"), F.lit(0)), sources=F.col("sources"))),
        ("format_end", data(final_len=F.when(F.col("refused"), F.lit(0)).otherwise(F.char_length("final_answer")))),
        ("sources_selected", data(count=F.size("files"), filenames=F.col("files"))),
        ("quotes_selected", data(count=F.greatest(count("quotes"), F.lit(0)), quotes=F.col("quotes"))),
        ("audit_refused", F.when(F.col("refused"), data())),
    ]
    rows = F.array(*(F.struct(F.lit(n).alias("seq"), F.lit(name).alias("event"), value.alias("data")) for n, (name, value) in enumerate(steps)))
    return each.select("qid", F.inline(rows)).where("data IS NOT NULL")
