"""op2_ngram_jaccard_join: near-duplicate documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groundq.llm.near_texts import near_duplicate_texts


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), id="doc_id", text="text", width=5, jaccard=0.8)


QUERIES = {"op2_ngram_jaccard_join": op2_ngram_jaccard_join}
SQL: dict[str, str] = {}
