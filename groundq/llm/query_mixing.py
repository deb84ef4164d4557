"""op3_source_mixing: rates that bring the expected tokens of three domains to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundq.llm.mixing import mix_rates

TARGETS = {"clean": 0.85, "noisy": 0.1, "toxic": 0.05}


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels table as (id, domain): toxic, else clean or noisy by quality."""
    label = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "noisy")
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), label.alias("domain"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rates = mix_rates(docs, labelled_domains(spark, sf_dir), TARGETS, id="doc_id", text="text")
    return rates.select("doc_id", "tokens", "posterior.*", "rate", "copies")


QUERIES = {"op3_source_mixing": op3_source_mixing}
SQL: dict[str, str] = {}
