"""op5_warc: every page through WARC bundles and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundq.llm.warc import read_records, write_bundles


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"), key="page_id", url="url", payload=F.col("html"))
    response = F.col("warc_type") == "response"
    return read_records(index, key="page_id").select(
        "page_id",
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.col("refers_to_key").cast("long").alias("refers_to"),
    )


QUERIES = {"op5_warc": op5_warc}

SQL = {
    "op5_warc": """
WITH each AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
least AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM each)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n < 100 OR page_id = first THEN NULL ELSE first END AS refers_to
FROM least"""
}
