"""Books, section files, test suites and runs as DataFrames. All schemas are stated; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundq.functions.text import line_feeds

SUITE = "id string, mode string, tests array<struct<id:string, question:string, category:string, must_refuse:boolean, expected:array<struct<ch:int, sec:int>>, expected_quote_contains:variant>>"
CONFIG = "timestamp string, pipeline_version string, suite_id string, suite_path string, n_tests int, mode string, corpus_id string, data_dir string, engine_mode string"
RESULT = "id string, question string, must_refuse boolean, final_answer string, metrics variant, selection variant, trace variant, extras_grading variant, expected_quotes_grading variant"


def decoded(content: Column) -> Column:
    """UTF-8, or Latin-1 where it is not valid UTF-8."""
    return F.coalesce(F.expr("try_validate_utf8(cast(_content AS string))"), F.decode(content, "ISO-8859-1"))


def _files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    # on one machine binaryFile lists; nothing is opened until the content column is read
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def section_texts(spark: SparkSession, data_dir: str) -> DataFrame:
    """(filename, text) of every file of a folder."""
    return _files(spark, data_dir).select(name_of(F.col("path")).alias("filename"), F.col("content").alias("_content")).select("filename", decoded(F.col("_content")).alias("text"))


def with_section_text(rows: DataFrame, texts: DataFrame, data_dir: str) -> DataFrame:
    """rows with their file's text, or a message that says which file is missing."""
    missing = F.concat(F.lit(f"[ERROR reading {data_dir}/"), F.coalesce("filename", F.lit("")), F.lit("]"))
    return rows.join(texts.select("filename", F.col("text").alias("section_text")), "filename", "left").withColumn("section_text", F.coalesce("section_text", missing))


def book(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole books, line ends in one form."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), line_feeds(F.col("value")).alias("text"))


def indexable(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """(path, name) of the .txt, .md and .pdf files of a folder, by name, at most `limit` of them."""
    if limit is not None and limit < 0:
        raise ValueError("limit is negative")
    rows = _files(spark, folder).select("path", name_of(F.col("path")).alias("name")).where(F.lower("name").rlike(r"\.(txt|md|pdf)$")).orderBy("name")
    return rows if limit is None else rows.limit(limit)


def texts_of(v: Column) -> Column:
    """array<string> of a VARIANT that is a string or a list of strings; empty strings and null give none."""
    one = F.try_variant_get(v, "$", "string")
    is_list = F.schema_of_variant(v).startswith("ARRAY")
    return F.when(is_list, F.try_variant_get(v, "$", "array<string>")).when(F.length(one) > 0, F.array(one)).otherwise(F.array().cast("array<string>"))


def suite(spark: SparkSession, path: str) -> DataFrame:
    """One row a test: suite_id (the file's stem if it has none), mode, id, question, category, must_refuse, expected, expected_quotes.

    A file that is no JSON object, or has no list of tests, is an error.
    """
    rows = spark.read.schema(SUITE).json(path, multiLine=True, mode="FAILFAST")
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    checked = F.coalesce("tests", F.raise_error(F.lit("a suite needs a list of tests")).cast("array<struct<id:string, question:string, category:string, must_refuse:boolean, expected:array<struct<ch:int, sec:int>>, expected_quote_contains:variant>>"))
    tests = rows.select(F.coalesce("id", stem).alias("suite_id"), "mode", F.explode(checked).alias("t"))
    return tests.select(
        "suite_id", "mode", "t.id", "t.question", "t.category", F.coalesce("t.must_refuse", F.lit(False)).alias("must_refuse"), F.coalesce("t.expected", F.array()).alias("expected"), texts_of(F.col("t.expected_quote_contains")).alias("expected_quotes")
    )


def expected_pairs(tests: DataFrame) -> DataFrame:
    """Distinct (id, chapter, section) that tests expect."""
    return tests.select("id", F.explode("expected").alias("e")).select("id", F.col("e.ch").alias("chapter"), F.col("e.sec").alias("section")).dropna().distinct()


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(configs, results) of every folder below path that holds config.json and results.jsonl, with run_dir relative to it."""
    def read(name: str, schema: str, **how) -> DataFrame:
        rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", name).json(path, **how)
        # within a file the rows of a split keep their order, and splits are told apart by where they begin
        place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        return rows.select("*", _folder(F.col("_metadata.file_path")).alias("_dir"), place.alias("_place"))

    configs, results = read("config.json", CONFIG, multiLine=True), read("results.jsonl", RESULT)
    base = F.regexp_extract(F.col("_dir"), r"([^/]+/?)$", 1) if path.rstrip("/").endswith("*") else F.regexp_replace(F.col("_dir"), rf"^.*?{_quoted(path)}/?", "")
    configs = configs.join(results.select("_dir").distinct(), "_dir", "left_semi").withColumn("run_dir", base).drop("_dir")
    order = F.row_number().over(W.partitionBy("_dir").orderBy("_place")).cast("long")
    return configs.drop("_place"), results.withColumn("run_dir", base).withColumn("row_ord", order).drop("_dir", "_place")


def file_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, filename) of stored files, from JSON lines: what a list of file ids is looked up in."""
    return spark.read.schema("file_id string, filename string").json(path).dropna(subset=["file_id"])


def file_ids(spark: SparkSession, ids: list[str]) -> DataFrame:
    """A given list of file ids as a table, in its order."""
    return spark.createDataFrame(list(enumerate(ids)), "ord long, file_id string")


def _quoted(path: str) -> str:
    import re

    return re.escape(path.split("://")[-1].rstrip("/"))
