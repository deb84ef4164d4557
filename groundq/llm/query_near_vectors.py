"""op10_embedding_near_dedup: near-duplicate embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groundq.llm.near_vectors import near_duplicate_vectors


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), id="vec_id", vector="embedding", cosine=0.9)


QUERIES = {"op10_embedding_near_dedup": op10_embedding_near_dedup}
#: All pairs: the filters' recall is below 1, so a table with very many links at the threshold itself may lack some of these.
SQL = {
    "op10_embedding_near_dedup": """
WITH RECURSIVE usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, least(e.vec_id, coalesce(r.c, e.vec_id)) AS component_id, least(e.vec_id, coalesce(r.c, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = e.vec_id"""
}
