"""op6_toxicity: the toxicity of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundq.llm.language import crc_fold
from groundq.llm.toxicity import score_texts, train


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_fold(F.col("doc_id"), 5) != 0)
    model = train(docs, labels, id="doc_id", text="text", label="toxic")
    return score_texts(docs, model, keys=["doc_id"], text="text").select(
        "doc_id",
        F.coalesce(crc_fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


QUERIES = {"op6_toxicity": op6_toxicity}
SQL: dict[str, str] = {}
