"""op8_packing: all documents in sequences of 1,024 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundq.llm.packing import pack_documents

VOCABULARY = "byte_bpe_50k.json"


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "kind"
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(pack_documents(docs, id="doc_id", text="text", vocabulary=public_tokenizers.path(VOCABULARY), window=1024, end=0))


QUERIES = {"op8_packing": op8_packing}
SQL: dict[str, str] = {}
