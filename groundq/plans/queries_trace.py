"""Retrieval pools, selection and the trace log."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundq.operators import trace
from groundq.operators.retrieve import first_wins, flag_by_rank, last_wins
from groundq.operators.segment import number_islands, number_within
from groundq.plans.views import POOL, SECTIONS, TOPK, pool, sections, table, topk

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return add


@query(f"WITH {TOPK} SELECT qid, rank, vec_id, score FROM topk")
def retrieve_topk(spark, d):
    return topk(spark, d)


@query(f"WITH {TOPK} SELECT qid, rank, vec_id, CASE WHEN rank <= 8 THEN 'Y' ELSE 'N' END AS selected FROM topk")
def select_flag(spark, d):
    return flag_by_rank(topk(spark, d)).select("qid", "rank", "vec_id", "selected")


@query(f"WITH {POOL} SELECT qid, rank, file, selected_by_rank, selected FROM pool")
def select_by_file(spark, d):
    return pool(spark, d).select("qid", "rank", "file", "selected_by_rank", "selected")


@query(f"WITH {POOL} SELECT qid, file, min(rank) AS rank, arg_min(score, rank) AS score FROM pool GROUP BY ALL")
def dedupe_first_wins(spark, d):
    return first_wins(pool(spark, d), ["qid", "file"], "rank", ["rank", "score"])


@query(f"WITH {POOL} SELECT qid, file, arg_max(vec_id, rank) AS vec_id FROM pool WHERE selected_by_rank = 'Y' GROUP BY ALL")
def dedupe_last_wins(spark, d):
    return last_wins(pool(spark, d).where("selected_by_rank = 'Y'"), ["qid", "file"], "rank", ["vec_id"])


def _aligned(spark, d):
    rows = pool(spark, d)
    return rows, trace.align(rows.where("selected = 'Y'").select("qid", "rank", "file", "chapter"), rows, "file")


ALIGNED = f"""{POOL}, first AS (SELECT qid, file, min(rank) AS r, arg_min(score, rank) AS s FROM pool GROUP BY ALL),
aligned AS (SELECT p.qid, p.rank, p.file, p.chapter, r AS retrieval_rank, s AS retrieval_score FROM pool p JOIN first USING (qid, file) WHERE selected = 'Y')"""


@query(f"WITH {ALIGNED} SELECT qid, rank, file, retrieval_rank, retrieval_score FROM aligned")
def align_sources(spark, d):
    return _aligned(spark, d)[1].select("qid", "rank", "file", "retrieval_rank", "retrieval_score")


@query(f"""WITH {ALIGNED}, seen AS (SELECT qid, count(DISTINCT file) AS pool_files, count(DISTINCT chapter) AS chapters FROM pool GROUP BY qid)
SELECT qid, pool_files, count(DISTINCT file) AS used_files, count(DISTINCT file) AS used_in_pool, count(DISTINCT chapter) / max(chapters) AS coverage_ratio, max(retrieval_rank) AS max_rank, avg(retrieval_rank) AS mean_rank
FROM aligned JOIN seen USING (qid) GROUP BY qid, pool_files""")
def trace_coverage(spark, d):
    rows, sources = _aligned(spark, d)
    return trace.coverage(rows, sources, "file")


SUMMARY = f"""WITH {POOL} SELECT qid, array_to_string(list_sort(list_distinct(list(chapter))), ',') AS retrieval_chapters,
array_to_string(list_sort(list_distinct(list(chapter) FILTER (selected = 'Y'))), ',') AS used_chapters,
string_agg(rank || ':' || printf('%.4f', score), ',' ORDER BY rank) FILTER (selected = 'Y') AS used_ranks FROM pool GROUP BY qid"""


@query(SUMMARY)
def selection_summary(spark, d):
    return trace.selection_summary(pool(spark, d))


@query(f"SELECT qid, used_ranks AS labels FROM ({SUMMARY})")
def used_rank_labels(spark, d):
    return trace.selection_summary(pool(spark, d)).select("qid", F.col("used_ranks").alias("labels"))


@query(f"WITH {POOL} SELECT qid, string_agg(printf('%.6f', score), ' - ' ORDER BY rank) FILTER (selected = 'Y') AS scores FROM pool GROUP BY qid")
def score_join_text(spark, d):
    return trace.joined_scores(pool(spark, d))


@query(f"""WITH {POOL}, {SECTIONS},
quotes AS (SELECT qid, chapter, section, arg_max('quote ' || rank, rank) AS quote FROM pool WHERE selected = 'Y' AND rank % 3 <> 0 GROUP BY ALL)
SELECT p.qid, p.rank, p.selected, CASE WHEN selected = 'Y' THEN coalesce(quote, '') END AS quote,
       CASE WHEN selected = 'N' THEN coalesce(md5(text), '[ERROR reading ' || coalesce(filename, 'none.txt') || ']') END AS section_text
FROM pool p LEFT JOIN quotes q USING (qid, chapter, section) LEFT JOIN sections s ON s.doc_id = p.file""")
def selection_branch(spark, d):
    rows = pool(spark, d)
    names = sections(spark, d).select(F.col("doc_id").alias("file"), "filename", "text")
    rows = rows.join(names.select("file", "filename"), "file", "left").withColumn("filename", F.coalesce("filename", F.lit("none.txt")))
    quotes = rows.where("selected = 'Y' AND rank % 3 <> 0").select("qid", F.col("rank").alias("ord"), "chapter", "section", F.concat(F.lit("quote "), F.col("rank").cast("string")).alias("quote"))
    view = trace.selection_view(rows, quotes, names)
    shown = F.when(F.col("section_text").startswith("["), F.col("section_text")).otherwise(F.md5("section_text"))
    return view.select("qid", "rank", "selected", "quote", shown.alias("section_text"))


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def latest_event(spark, d):
    return trace.latest_event(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value"])


@query("SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id")
def last_event_time(spark, d):
    return trace.latest_event(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["ts"])


@query("SELECT user_id, event_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 1000 AS t_ms FROM events")
def elapsed_ms(spark, d):
    return trace.elapsed_ms(table(spark, d, "events"), "user_id", "ts").select("user_id", "event_id", "t_ms")


ISLANDS = """islands AS (
  SELECT user_id, event_id, ts, event_type, CAST(sum(CASE WHEN before IS NULL OR before <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island
  FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events))"""


@query(f"WITH {ISLANDS} SELECT user_id, event_id, island FROM islands")
def chapter_islands(spark, d):
    return number_islands(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "island")


@query(f"""WITH {ISLANDS} SELECT i.user_id, i.event_id, island, CAST(row_number() OVER (PARTITION BY i.user_id, island ORDER BY i.ts, i.event_id) AS INTEGER) AS ordinal
FROM islands i JOIN events e USING (event_id) WHERE e.value > 10""")
def section_ordinal(spark, d):
    rows = number_islands(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").where("value > 10")
    return number_within(rows, ["user_id", "island"], ["ts", "event_id"]).select("user_id", "event_id", "island", "ordinal")
