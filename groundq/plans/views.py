"""The driver's tables as the engine's entities, once for Spark and once as SQL.

sections: documents under a file name with chapter and section. pool: for every hundredth embedding (a question) the top chunks among all,
each of a file (several chunks share one). trace and runs: events. A document's quotations: all its pieces between full stops, one turned
backwards, one in capitals and one blank, in a fixed order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundq.config import SELECTION_K
from groundq.operators.retrieve import flag_by_file, retrieve


SMALL, CAPITAL = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of whole texts, dealt over all cores if its files have fewer row groups than there are: a scan cannot split one."""
    rows = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() > cores:
        return rows
    busy = rows.groupBy(F.spark_partition_id()).count().count()  # reads no column, and no more splits than cores
    return rows if busy >= cores else rows.repartition(cores)


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapter = F.expr("CAST((doc_id div 20) % 99 + 1 AS INT)")
    section = F.expr("CAST(doc_id % 20 + 1 AS INT)")
    name = F.concat(
        F.lit("corpus_book01_x_ch_"), F.format_string("%02d", chapter), F.lit("_"), "source", F.lit("_s"), F.format_string("%02d", section), F.lit("_"), "lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")
    )
    return texts(spark, sf_dir).select("doc_id", "text", "lang", "source", F.concat(F.lit("file-"), F.col("doc_id").cast("string")).alias("file_id"), chapter.alias("chapter"), section.alias("section"), name.alias("filename"))


SECTIONS = """sections AS (
  SELECT doc_id, text, lang, source, 'file-' || doc_id AS file_id, CAST((doc_id // 20) % 99 + 1 AS INTEGER) AS chapter, CAST(doc_id % 20 + 1 AS INTEGER) AS section,
         'corpus_book01_x_ch_' || lpad(CAST((doc_id // 20) % 99 + 1 AS VARCHAR), 2, '0') || '_' || source || '_s' || lpad(CAST(doc_id % 20 + 1 AS VARCHAR), 2, '0') || '_' || lang || '_' || doc_id || '.txt' AS filename
  FROM documents)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve(table(spark, sf_dir, "embeddings"), questions(spark, sf_dir), id="vec_id", vector="embedding")


TOPK = """topk AS (
  SELECT qid, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM (
      SELECT q.vec_id AS qid, c.vec_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score
      FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0)) WHERE rank <= 20)"""


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topk with its file, the coordinates of that file's place, and both flags."""
    out = topk(spark, sf_dir).withColumn("file", F.col("vec_id") % 100)
    out = out.withColumns({"chapter": F.expr("CAST(file div 20 + 1 AS INT)"), "section": F.expr("CAST(file % 20 + 1 AS INT)")})
    return flag_by_file(out, "file", SELECTION_K)


POOL = (
    TOPK
    + """,
placed AS (
  SELECT *, vec_id % 100 AS file, CAST((vec_id % 100) // 20 + 1 AS INTEGER) AS chapter, CAST((vec_id % 100) % 20 + 1 AS INTEGER) AS section,
         CASE WHEN rank <= 8 THEN 'Y' ELSE 'N' END AS selected_by_rank FROM topk),
pool AS (
  SELECT *, CASE WHEN max(CASE WHEN selected_by_rank = 'Y' THEN 1 ELSE 0 END) OVER (PARTITION BY qid, file) = 1 THEN 'Y' ELSE 'N' END AS selected FROM placed)"""
)


def quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid (the document), ord, quote, filename: its first piece, that piece backwards, the last but one in capitals, a blank, and all others."""
    parts = F.col("parts")
    odd = F.array(F.get(parts, F.lit(0)), F.reverse(F.get(parts, F.lit(0))), F.translate(F.get(parts, F.size(parts) - 2), SMALL, CAPITAL), F.lit(" "))
    quotes = F.concat(odd, F.slice(parts, F.lit(2), F.size(parts)))
    each = sections(spark, sf_dir).withColumn("parts", F.split("text", r"\.")).select(F.col("doc_id").alias("qid"), "filename", "chapter", "section", F.posexplode(quotes).alias("at", "quote"))
    return each.select("qid", (F.col("at") + 1).alias("ord"), "quote", "filename", "chapter", "section").where("quote IS NOT NULL")


QUOTATIONS = (
    SECTIONS
    + """,
quotations AS (
  SELECT * FROM (
    SELECT qid, CAST(generate_subscripts(quotes, 1) AS INTEGER) AS ord, unnest(quotes) AS quote, filename, chapter, section FROM (
      SELECT doc_id AS qid, filename, chapter, section, list_concat([p[1], reverse(p[1]), translate(p[len(p) - 1], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ' '], p[2:]) AS quotes
      FROM (SELECT *, string_split(text, '.') AS p FROM sections)))
  WHERE quote IS NOT NULL)"""
)


def folded(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"


def matched(c: str) -> str:
    return f"""lower({folded(f"translate({c}, '’‘“”', '''''\"\"')")})"""


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(configs, results): events as tests of runs; a run is a day and the user's number modulo 5."""
    events = table(spark, sf_dir, "events")
    run = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("/"), (F.col("user_id") % 5).cast("string"), F.lit("/"), "event_type")
    rows = events.select(
        run.alias("run_dir"), F.col("event_id").alias("row_ord"), F.col("user_id").cast("string").alias("id"), "event_type", F.date_format("ts", "yyyy-MM-dd").alias("timestamp"),
        F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("question"), F.when(F.col("event_id") % 7 != 0, F.col("value") / 7).alias("retrieval_recall_at_20"),
        F.col("value").alias("retrieval_mean_rank"), F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("selected_pool_scores"),
    )
    configs = rows.groupBy("run_dir").agg(F.max("timestamp").alias("timestamp"), F.max("event_type").alias("suite_id"), F.count("*").alias("n_tests"))
    configs = configs.withColumns({"pipeline_version": F.lit(None).cast("string"), "mode": F.lit("strict")})
    return configs, rows.drop("timestamp", "event_type")


RUNS = """results AS (
  SELECT strftime(ts, '%Y-%m-%d') || '/' || (user_id % 5) || '/' || event_type AS run_dir, event_id AS row_ord, CAST(user_id AS VARCHAR) AS test_id, event_type, strftime(ts, '%Y-%m-%d') AS timestamp,
         'q' || user_id AS question, CASE WHEN event_id % 7 <> 0 THEN value / 7 END AS m__retrieval_recall_at_20, value AS m__retrieval_mean_rank,
         CASE WHEN event_id % 3 <> 0 THEN props END AS m__selected_pool_scores FROM events),
runs AS (
  SELECT r.timestamp, r.run_dir, CAST(NULL AS VARCHAR) AS pipeline_version, event_type AS suite_id, 'strict' AS mode, count(*) OVER (PARTITION BY run_dir) AS n_tests,
         row_ord, test_id, question, m__retrieval_recall_at_20, m__retrieval_mean_rank, m__selected_pool_scores FROM results r)"""
