"""Connected components of a graph whose edges no single machine holds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundq.llm.shared import dropped, joined, written


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place that the links (i, j) lead to."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for each id in edges (a, b: long, not null), component the smallest id that edges lead to.

    Alternating large-star and small-star steps over the edges as a table, each written to the shared folder, until nothing changes. Each
    step hangs the neighbours of a node below the smallest of them, so the number of edges does not grow and the rounds grow with the
    logarithm of the longest path. A node's neighbours are never gathered: their minimum is an aggregate that combines before the shuffle,
    and the join that brings it back is one that Spark can split where a node has very many edges. Empty edges give an empty result.
    """

    def star(table: DataFrame, large: bool) -> DataFrame:
        # small-star: from each node its smaller neighbours and itself hang below the smallest; large-star: its larger neighbours do
        both = table.union(table.select("b", "a")) if large else table
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        hung = both.join(least, "a").where(F.col("b") > F.col("a") if large else F.lit(True)).select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            hung = hung.union(least.select("a", F.col("m").alias("b")))
        return hung.where("a <> b").distinct()

    def sums(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    table = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    last = sums(table)
    for _ in range(rounds):
        large = star(table, True)
        large = written(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "large-star")
        small = written(star(large, False), "small-star")
        dropped(table, large)
        table, now = small, sums(small)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    members = table.select(F.col("a").alias("id"), F.col("b").alias("component"))
    out = members.union(table.select("b", "b").distinct())
    out._groundq_path = table._groundq_path  # so that `dropped` can take its table away
    return out


def named_by_least(members: DataFrame, names: DataFrame) -> DataFrame:
    """(rep, c): for each member (id, component) the smallest least_id of its component. names: rep, least_id, one row each."""
    some = written(members.withColumnRenamed("id", "rep").join(names.select("rep", "least_id"), "rep"), "component-members")
    least = some.groupBy("component").agg(F.min("least_id").alias("c"), F.count("*").alias("size"))
    return joined(some.select("rep", "component"), least, "component", "size", some.count()).select("rep", "c")
