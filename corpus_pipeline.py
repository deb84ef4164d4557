"""From documents to packed sequences: five stages, each written and read again before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundq.llm.language import crc_fold, identify
from groundq.llm.language import train as train_language
from groundq.llm.mixing import mixed
from groundq.llm.near_texts import keep_one
from groundq.llm.packing import pack_documents
from groundq.llm.query_mixing import labelled_domains
from groundq.llm.query_packing import VOCABULARY, digests
from groundq.llm.shared import dropped, scratch, written
from groundq.llm.toxicity import score_texts
from groundq.llm.toxicity import train as train_toxicity

#: A document goes at this probability of being toxic.
TOXIC = 0.5
#: A document goes if it has no letter, or if it carries a lang and the model is at least this sure of another.
SURE = 0.99
#: Shares of tokens after mixing, and their sum as a share of what comes in: a training run over as many tokens as there are.
TARGETS, BUDGET = {"clean": 0.9, "noisy": 0.1}, 1.0


def _row(docs: DataFrame) -> DataFrame:
    """Each row under one column, so that no name can clash; the operators read the text within it."""
    return docs.select(F.struct("*").alias("_row"), "lang")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on labelled ones among them, does not score TOXIC or more. All labels are used."""
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), id="doc_id", text="text", label="toxic")
    scored = score_texts(_row(docs), model, keys=["_row"], text="_row.text")
    return scored.where(F.col("score") < TOXIC).select("_row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: they have a letter, and their lang, if it is one that was learned, is not surely another."""
    known = docs.where(crc_fold(F.col("doc_id"), 4) != 2)
    model = train_language(known, known, id="doc_id", text="text", label="lang")
    told = identify(_row(docs), model, keys=["_row", "lang"], text="_row.text")
    learned = F.col("lang").isin(model.classes if model else [])  # of another language the model knows nothing, so it contradicts none
    wrong = learned & (F.col("lang") != F.col("lang_pred")) & (F.col("score") >= SURE)
    return told.where((F.col("lang_pred") != "und") & ~F.coalesce(wrong, F.lit(False))).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id."""
    return keep_one(docs, id="doc_id", text="text", width=5, jaccard=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, so that the expected tokens of clean and noisy ones match TARGETS."""
    labelled = labelled_domains(spark, sf_dir).where(F.col("domain").isin(*TARGETS))
    return mixed(docs, labelled, TARGETS, id="doc_id", text="text", budget=BUDGET)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1,024 tokens."""
    return digests(pack_documents(docs, id="doc_id", text="text", vocabulary=public_tokenizers.path(VOCABULARY), window=1024, end=0))


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: No SQL: a trained model decides in the first stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each result written to the shared folder. What a stage wrote for itself goes once its result is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch() as tables:
            made = stage(spark, docs, sf_dir)
        before, docs = docs, written(made, name)
        tables.release()
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
