"""op4_language_id: the language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundq.llm.language import crc_fold, identify, train


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = docs.where(crc_fold(F.col("doc_id"), 4) != 2)
    model = train(known, known, id="doc_id", text="text", label="lang")
    return identify(docs, model, keys=["doc_id"], text="text").select(
        "doc_id", F.coalesce(crc_fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


QUERIES = {"op4_language_id": op4_language_id}
SQL: dict[str, str] = {}
