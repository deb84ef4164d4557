"""Runs over time: rows of tests, means of runs, change from one run to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundq.functions.numbers import METRICS, change, display, number

KEYS = ["timestamp", "run_dir", "pipeline_version", "suite_id", "mode", "n_tests"]


def load_runs(configs: DataFrame, results: DataFrame) -> DataFrame:
    """Each result (run_dir, row_ord, id, question, metric columns) with its run's configuration; metrics named m__*, bad numbers null."""
    names = [c for c in results.columns if c in METRICS or c.startswith("m__")]
    metrics = [(F.col(c) if METRICS.get(c.removeprefix("m__"), ("", ""))[0] == "text" else number(F.col(c))).alias("m__" + c.removeprefix("m__")) for c in names]
    fields = [c for c in KEYS if c != "run_dir"]
    return results.join(configs.select("run_dir", *fields), "run_dir").select(*KEYS, "row_ord", F.col("id").alias("test_id"), "question", *metrics)


def in_report_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last("timestamp"), F.desc_nulls_last("run_dir"))


def summarize_runs(rows: DataFrame) -> DataFrame:
    """Means of a run's metrics, and of text metrics the first test's value; null keys are groups."""
    metrics = [c for c in rows.columns if c.startswith("m__")]
    text = lambda c: METRICS.get(c.removeprefix("m__"), ("", ""))[0] == "text"
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row_ord")))
    return rows.groupBy(*KEYS).agg(*((first(c) if text(c) else F.avg(F.nanvl(F.col(c), F.lit(None)))).alias(c) for c in metrics))


def trend(rows: DataFrame, key: str, metric: str) -> DataFrame:
    """A metric's value before, its change class and its display, by the key's runs in order of time."""
    kind, better = METRICS[metric.removeprefix("m__")]
    w = W.partitionBy(key).orderBy("timestamp", "run_dir")
    out = rows.withColumn("previous", F.lag(metric).over(w))
    return out.withColumn("change", change(F.col("previous"), F.col(metric), kind, better)).withColumn("shown", display(F.col(metric), kind))


def union_runs(*tables: DataFrame) -> DataFrame:
    """Rows of runs whose metrics differ: all columns that any of them has, null where one has none."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def analyse(rows: DataFrame, suite: str | None = None, mode: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(run means in report order, the rows that they are of), of one suite and mode if they are named."""
    some = rows.where((F.col("suite_id") == suite) if suite else F.lit(True)).where((F.col("mode") == mode) if mode else F.lit(True))
    return in_report_order(summarize_runs(some)), some
