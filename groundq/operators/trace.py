"""The trace of a run as rows: latest events, alignment of sources with the pool, coverage, the selection view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundq.functions.numbers import fixed
from groundq.functions.refs import file_coordinates_or_chapter
from groundq.operators.retrieve import first_wins, last_wins


def latest_event(events: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    return last_wins(events, keys, order, values)


def elapsed_ms(events: DataFrame, key: str, ts: str) -> DataFrame:
    """t_ms: whole milliseconds since the key's first event."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return events.withColumn("t_ms", ((micros - F.min(micros).over(W.partitionBy(key))) / 1000).cast("long"))


def align(sources: DataFrame, pool: DataFrame, file: str) -> DataFrame:
    """Sources with the rank and score that the pool has first for their file; a file that the pool lacks keeps its own rank."""
    index = first_wins(pool, ["qid", file], "rank", ["rank", "score"]).select("qid", file, F.col("rank").alias("_r"), F.col("score").alias("retrieval_score"), F.lit(True).alias("_hit"))
    return sources.join(index, ["qid", file], "left").withColumn("retrieval_rank", F.when(F.col("_hit"), F.col("_r")).otherwise(F.col("rank"))).drop("_r", "_hit")


def coverage(pool: DataFrame, sources: DataFrame, file: str) -> DataFrame:
    """One row a question of the pool: files, chapters and ranks of the pool that the aligned sources use. Ratio null without chapters."""
    seen = pool.groupBy("qid").agg(F.countDistinct(file).alias("pool_files"), F.countDistinct("chapter").alias("pool_chapters"))
    inside = sources.join(pool.select("qid", file).distinct().withColumn("_in", F.lit(True)), ["qid", file], "left")
    used = inside.groupBy("qid").agg(
        F.countDistinct(file).alias("used_files"), F.countDistinct(F.when(F.col("_in"), F.col(file))).alias("used_in_pool"), F.countDistinct("chapter").alias("used_chapters"),
        F.max("retrieval_rank").alias("max_rank"), F.avg("retrieval_rank").alias("mean_rank"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    ratio = F.coalesce("used_chapters", F.lit(0)) / F.nullif(F.col("pool_chapters"), F.lit(0))
    return seen.join(used, "qid", "left").select("qid", "pool_files", zero("used_files"), zero("used_in_pool"), ratio.alias("coverage_ratio"), "max_rank", "mean_rank")


def with_coordinates(pool: DataFrame) -> DataFrame:
    """Chapter and section filled in from the file name where the chapter is missing."""
    found = file_coordinates_or_chapter(F.col("filename"))
    return pool.withColumn("_c", found).withColumns(
        {"section": F.when(F.col("chapter").isNull(), F.coalesce(F.col("_c.section"), F.col("section"))).otherwise(F.col("section")), "chapter": F.coalesce("chapter", F.col("_c.chapter"))}
    ).drop("_c")


def selection_view(pool: DataFrame, quotes: DataFrame, sections: DataFrame) -> DataFrame:
    """The pool with, for selected rows, the quote of their chapter and section (the last one, or empty) and, for others, their text.

    pool: qid, rank, filename, chapter, section, selected. quotes: qid, ord, chapter, section, quote. sections: filename, text.
    """
    last = last_wins(quotes.where("chapter IS NOT NULL AND section IS NOT NULL"), ["qid", "chapter", "section"], "ord", ["quote"])
    out = pool.join(last, ["qid", "chapter", "section"], "left").join(sections.select("filename", F.col("text").alias("_t")), "filename", "left")
    missing = F.when(F.length("filename") > 0, F.concat(F.lit("[ERROR reading "), "filename", F.lit("]"))).otherwise(F.lit("[No filename available to load local text]"))
    chosen = F.col("selected") == "Y"
    return out.withColumn("quote", F.when(chosen, F.coalesce("quote", F.lit("")))).withColumn("section_text", F.when(~chosen, F.coalesce("_t", missing))).drop("_t")


def selection_summary(pool: DataFrame) -> DataFrame:
    """Chapters of the pool and of its selected rows, ascending, and "rank:score" of the selected ones in pool order, each once."""
    chosen = F.col("selected") == "Y"
    text = F.concat(F.col("rank").cast("string"), F.lit(":"), F.coalesce(fixed(F.col("score"), 4), F.lit("None")))
    chapters = lambda c: F.array_join(F.transform(F.sort_array(F.collect_set(c)), lambda x: x.cast("string")), ",")
    labels = F.array_sort(F.collect_list(F.when(chosen, F.struct("rank", text.alias("t")))))
    return pool.groupBy("qid").agg(
        chapters("chapter").alias("retrieval_chapters"),
        chapters(F.when(chosen, F.col("chapter"))).alias("used_chapters"),
        F.array_join(F.array_distinct(F.transform(labels, lambda x: x["t"])), ",").alias("used_ranks"),
    )


def joined_scores(pool: DataFrame) -> DataFrame:
    """The scores of selected rows with six digits, in pool order, between " - "."""
    chosen = (F.upper("selected") == "Y") & F.col("score").isNotNull()
    each = F.array_sort(F.collect_list(F.when(chosen, F.struct("rank", fixed(F.col("score"), 6).alias("t")))))
    return pool.groupBy("qid").agg(F.array_join(F.transform(each, lambda x: x["t"]), " - ").alias("scores"))


def appended(log: DataFrame, more: DataFrame) -> DataFrame:
    """A trace log with more events; columns that either lacks are null there."""
    return log.unionByName(more, allowMissingColumns=True)


def merged_meta(rows: DataFrame) -> DataFrame:
    """(qid, meta): what was set (qid, ord, meta: map) in order, later values of a key in place of earlier ones."""
    each = rows.select("qid", "ord", F.explode("meta").alias("key", "value"))
    return last_wins(each, ["qid", "key"], "ord", ["value"]).groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("meta"))


def run_duration(events: DataFrame, key: str, ts: str, status: str = "completed") -> DataFrame:
    """(key, duration_ms, ok): whole milliseconds from a run's first event to its last, and whether the last one's status is `status`."""
    last = F.max_by("status", ts)
    ms = F.floor((F.max(F.unix_micros(F.col(ts).cast("timestamp"))) - F.min(F.unix_micros(F.col(ts).cast("timestamp")))) / 1000)
    return events.groupBy(key).agg(ms.cast("long").alias("duration_ms"), (last == status).alias("ok"))
