"""Runs over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundq.functions.numbers import clamp, display, number
from groundq.operators import runs as ops
from groundq.plans.views import RUNS, runs, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return add


def _rows(spark, d):
    return ops.load_runs(*runs(spark, d))


@query(f"WITH {RUNS} SELECT * FROM runs")
def load_runs(spark, d):
    return _rows(spark, d)


@query(f"""WITH {RUNS} SELECT timestamp, run_dir, pipeline_version, suite_id, mode, n_tests, avg(m__retrieval_recall_at_20) AS m__retrieval_recall_at_20, avg(m__retrieval_mean_rank) AS m__retrieval_mean_rank,
arg_min(m__selected_pool_scores, row_ord) FILTER (m__selected_pool_scores IS NOT NULL) AS m__selected_pool_scores FROM runs GROUP BY ALL""")
def run_summary(spark, d):
    return ops.in_report_order(ops.summarize_runs(_rows(spark, d)))


#: One row a test and run: the first. Values in whole tens, so that some do not change.
TREND = f"""{RUNS}, once AS (SELECT test_id, timestamp, run_dir, arg_min(floor(m__retrieval_mean_rank / 10), row_ord) AS value FROM runs GROUP BY ALL),
lagged AS (SELECT *, lag(value) OVER (PARTITION BY test_id ORDER BY timestamp, run_dir) AS previous FROM once)"""


@query(f"""WITH {TREND} SELECT test_id, timestamp, run_dir, value, previous, CASE WHEN previous IS NULL OR value = previous THEN 'neutral' WHEN value < previous THEN 'good' ELSE 'bad' END AS change,
replace(printf('%.1f', value), '.', ',') AS shown FROM lagged""")
def run_trend(spark, d):
    once = _rows(spark, d).groupBy("test_id", "timestamp", "run_dir").agg(F.min_by(F.floor(F.col("m__retrieval_mean_rank") / 10).cast("double"), "row_ord").alias("m__retrieval_mean_rank"))
    out = ops.trend(once, "test_id", "m__retrieval_mean_rank")
    return out.withColumnRenamed("m__retrieval_mean_rank", "value").select("test_id", "timestamp", "run_dir", "value", "previous", "change", "shown")


@query(f"WITH {RUNS} SELECT row_ord, test_id FROM runs WHERE suite_id = 'click' AND mode = 'strict'")
def run_filter(spark, d):
    return _rows(spark, d).where("suite_id = 'click' AND mode = 'strict'").select("row_ord", "test_id")


@query("""SELECT event_id, CAST(CAST(round_even(value / 8 * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS pct0, replace(printf('%.1f', value / 8), '.', ',') AS f1, replace(printf('%.2f', value / 8), '.', ',') AS f2 FROM events WHERE value IS NOT NULL""")
def metric_format(spark, d):
    v = F.col("value") / 8
    return table(spark, d, "events").where("value IS NOT NULL").select("event_id", display(v, "pct0").alias("pct0"), display(v, "f1").alias("f1"), display(v, "f2").alias("f2"))


@query("SELECT event_id, CASE WHEN event_id % 4 < 2 THEN value END AS v FROM events")
def numeric_coerce(spark, d):
    raw = F.when(F.col("event_id") % 4 < 2, F.col("value").cast("string")).when(F.col("event_id") % 4 == 2, "NaN").otherwise("n/a")
    return table(spark, d, "events").select("event_id", number(raw).alias("v"))


@query("SELECT p_partkey, greatest(1, least(p_size, 50)) AS k FROM part")
def clamp_k(spark, d):
    return table(spark, d, "part").select("p_partkey", clamp(F.col("p_size"), 1, 50).alias("k"))


@query("SELECT DISTINCT user_id AS test_id FROM events WHERE user_id IS NOT NULL")
def test_ids(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("test_id")).distinct().dropna().orderBy("test_id")


@query("""SELECT user_id, count(DISTINCT event_type) FILTER (value > 20) AS wanted, count(DISTINCT event_type) FILTER (value <= 20) AS seen,
len(list_intersect(coalesce(list(DISTINCT event_type) FILTER (value > 20), []), coalesce(list(DISTINCT event_type) FILTER (value <= 20), []))) AS both FROM events GROUP BY user_id""")
def set_operations(spark, d):
    sets = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 20, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") <= 20, F.col("event_type"))).alias("b"))
    return sets.select("user_id", F.size("a").cast("long").alias("wanted"), F.size("b").cast("long").alias("seen"), F.size(F.array_intersect("a", "b")).cast("long").alias("both"))
