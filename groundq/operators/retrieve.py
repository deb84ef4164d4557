"""Similarity retrieval for a batch of questions, and selection from the pools it returns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundq.config import RETRIEVAL_K, RETRIEVAL_MOST, SELECTION_K, SNIPPET_CHARS
from groundq.functions.refs import file_coordinates_or_chapter
from groundq.functions.text import strip
from groundq.shipping import ship

#: Chunks of a shard, and questions that are multiplied with it at once.
SHARD_ROWS, BLOCK_ROWS = 16384, 1024


def retrieve(chunks: DataFrame, questions: DataFrame, *, id: str, vector: str, k: int = RETRIEVAL_K) -> DataFrame:
    """(qid, rank, id, score): the k chunks (1 to 50) of the highest inner product, rounded to six digits, with each question (qid, vector).

    Chunks are dealt into shards of bounded size. Questions, the smaller side, travel: each shard is one matrix in one task, and the
    questions sent to it stream through it in batches. Nothing is broadcast or gathered whole. Ties go to the smaller id. Vectors that are
    null, empty or hold null or NaN components take no part; a question meets chunks of its own length only.
    """
    ship(chunks.sparkSession)
    k = max(1, min(k, RETRIEVAL_MOST))
    whole = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    shards = max(1, -(-chunks.count() // SHARD_ROWS))
    length = F.size(vector).alias("dims")
    points = chunks.where(whole).select(F.pmod(F.xxhash64(id), F.lit(shards)).cast("int").alias("shard"), length, F.lit(0).alias("what"), F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    sent = questions.where(whole).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), length, F.lit(1).alias("what"), F.col("qid").cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    stream = points.union(sent).repartition(shards, "shard").sortWithinPartitions("shard", "dims", "what", "id")

    def best(batches):
        here, ids, parts, matrix = None, [], [], None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("shard", "dims", "what", "id")]
            shard, dims, what, names = columns
            edges = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (dims[1:] != dims[:-1]) | (what[1:] != what[:-1]), [True]]))
            out = ([], [], [])
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if here != (shard[a], dims[a]):
                    here, ids, parts, matrix = (shard[a], dims[a]), [], [], None
                block = batch.column("v").slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
                if what[a] == 0:
                    ids.append(names[a:b])
                    parts.append(block)
                    continue
                if not parts:
                    continue
                if matrix is None:
                    matrix, own = np.concatenate(parts), np.concatenate(ids)
                for lo in range(0, b - a, BLOCK_ROWS):
                    for name, row in zip(names[a + lo : b].tolist(), np.round(block[lo : lo + BLOCK_ROWS] @ matrix.T, 6) + 0.0, strict=False):
                        top = np.arange(len(row))
                        if len(row) > k:  # all that tie with the kth stay for the comparison of ids
                            top = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
                        top = top[np.lexsort((own[top], -row[top]))[:k]]
                        out[0].extend([name] * len(top))
                        out[1].extend(own[top].tolist())
                        out[2].extend(row[top].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["qid", "id", "score"])

    found = stream.mapInArrow(best, "qid long, id long, score double")
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "rank", F.col("id").alias(id), "score")


def pool_rows(results: DataFrame) -> DataFrame:
    """Pool rows of search results (qid, rank, file_id, filename, score, content: array of texts): non-blank parts, stripped, are joined to
    the passage, its beginning is the snippet, and the file name gives chapter and section."""
    parts = F.filter(F.transform(F.coalesce("content", F.array().cast("array<string>")), strip), lambda x: x.isNotNull() & (x != ""))
    passage = F.array_join(parts, " ")
    at = file_coordinates_or_chapter(F.coalesce("filename", F.lit("")))
    return results.select("qid", "rank", "file_id", "filename", "score", snippet(passage).alias("snippet"), passage.alias("passage"), at["chapter"].alias("chapter"), at["section"].alias("section"))


def flag_by_rank(pool: DataFrame, k: int = SELECTION_K) -> DataFrame:
    return pool.withColumn("selected", F.when(F.col("rank") <= max(1, k), "Y").otherwise("N"))


def flag_by_file(pool: DataFrame, file: str, k: int = SELECTION_K) -> DataFrame:
    """selected_by_rank, and selected: Y for every chunk of a file that has a selected one. A null file is never Y."""
    w = W.partitionBy("qid", file)
    by_rank = flag_by_rank(pool, k).withColumnRenamed("selected", "selected_by_rank")
    used = F.col(file).isNotNull() & (F.max(F.col("selected_by_rank") == "Y").over(w))
    return by_rank.withColumn("selected", F.when(used, "Y").otherwise("N"))


def first_wins(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Of each key the values of the smallest order. Combines before the shuffle, so a hot key is no burden."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias("_v")).select(*keys, "_v.*")


def last_wins(rows: DataFrame, keys: list[str], order: str | list[str], values: list[str]) -> DataFrame:
    """Of each key the values of the largest order."""
    by = F.struct(*order) if isinstance(order, list) else F.col(order)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), by).alias("_v")).select(*keys, "_v.*")


def snippet(text, most: int = SNIPPET_CHARS):
    return F.substring(text, 1, most)
