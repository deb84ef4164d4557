"""Exact top-k search by inner product: KD-trees per shard."""

from __future__ import annotations

import heapq
import math
import pickle
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundq.llm.shared import dropped, partitions, written
from groundq.llm.vectors import common_length, usable
from groundq.shipping import ship

#: Shards of a first search and of all searches after each round: a round asks so many times what was asked before.
GROWTH = 4
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


class KDTree:
    """Median splits on the widest side, down to leaves; each node has the tight bounding box of its points."""

    def __init__(self, points: np.ndarray, leaf: int = 256):
        self.order = np.arange(len(points))
        self.children: list[tuple[int, int] | None] = []
        self.spans: list[tuple[int, int]] = []
        low, high = [], []
        todo = [(0, len(points), -1, 0)] if len(points) else []
        while todo:
            a, b, parent, side = todo.pop()
            node = len(self.spans)
            own = points[self.order[a:b]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            self.spans.append((a, b))
            self.children.append(None)
            if parent >= 0:
                self.children[parent] = (node, self.children[parent][1]) if side == 0 else (self.children[parent][0], node)
            if b - a > leaf:
                axis = int(np.argmax(high[-1] - low[-1]))
                if high[-1][axis] > low[-1][axis]:
                    middle = (b - a) // 2
                    self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], middle)]
                    self.children[node] = (-1, -1)
                    todo += [(a + middle, b, node, 1), (a, a + middle, node, 0)]
        self.low, self.high = (np.array(x) if x else np.zeros((0, points.shape[1]), points.dtype) for x in (low, high))
        self.points = points[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(query, node): the largest inner product that any point of the node's box can have with the query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bound: np.ndarray, k: int, at_least, ids: np.ndarray, skip: int) -> list[tuple]:
        """The k best (score, -id) among points with a score of at_least (None: any), but for id skip; nodes in the order of their bounds."""
        best: list[tuple] = []
        heap = [(-bound[0], 0)] if len(self.spans) else []
        while heap:
            top, node = heapq.heappop(heap)
            kth = best[0][0] if len(best) == k else at_least
            if kth is not None and _within(-top) < kth:
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    heapq.heappush(heap, (-bound[child], child))
                continue
            a, b = self.spans[node]
            score = self.points[a:b] @ query
            if score.dtype == object:
                score = np.array([_within(s) for s in score], object)
            own = ids[self.order[a:b]]
            keep = own != skip
            if kth is not None:
                keep &= score >= kth
            keep = np.flatnonzero(keep)
            if len(keep) > k:  # ties at the kth score all stay for the comparison of ids
                keep = keep[score[keep] >= np.partition(score[keep], len(keep) - k)[len(keep) - k]]
            for s, i in zip(score[keep].tolist(), own[keep].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
        return best


def _within(score):
    """A score beyond 64 bits counts as the nearest 64-bit number."""
    return min(max(score, LOWEST), HIGHEST)


def _floored(x: float, scale: float) -> int:
    y = x * scale
    return math.floor(y) if math.isfinite(y) else math.floor(Fraction(x) * Fraction(scale))


def _packed(x: np.ndarray, scale: float) -> list[tuple[int, bytes]]:
    """(bytes a component, bytes) of each vector: integers of 2 or 4 bytes, or, where those do not hold them, the doubles that they come from."""
    with np.errstate(over="ignore"):
        q = np.floor(scale * x)
    most = np.abs(q).max(axis=1, initial=0)
    return [(2, q[i].astype("<i2").tobytes()) if m < 2**15 else (4, q[i].astype("<i4").tobytes()) if m < 2**31 else (8, x[i].astype("<f8").tobytes()) for i, m in enumerate(most)]


def _unpacked(kinds: list[int], packed: list[bytes], scale: float) -> np.ndarray:
    """Integer vectors: in 16 or 32 bits where all fit, else as Python integers."""
    widest = max(kinds, default=2)
    if widest < 8:
        return np.stack([np.frombuffer(v, f"<i{k}").astype(f"i{widest}") for k, v in zip(kinds, packed, strict=True)])
    rows = [[_floored(y, scale) for y in np.frombuffer(v, "<f8").tolist()] if k == 8 else np.frombuffer(v, f"<i{k}").tolist() for k, v in zip(kinds, packed, strict=True)]
    return np.array(rows, object).reshape(len(rows), -1)


def _exact(points: np.ndarray, queries: np.ndarray):
    """The fastest type in which every inner product and bound of these integers is exact."""
    if points.dtype == object or queries.dtype == object:
        return object
    most = float(np.abs(points.astype("i8")).max(initial=0)) * float(np.abs(queries.astype("i8")).max(initial=0)) * max(points.shape[1], 1) * 2
    return "f8" if most < 2.0**53 else "i8" if most < 2.0**63 else object


def _as(x: np.ndarray, kind) -> np.ndarray:
    return np.vectorize(int, otypes=[object])(x) if kind is object and x.dtype != object and x.size else x.astype(kind)


class _Shard:
    """A shard's tree in the type that the queries at hand ask for."""

    def __init__(self, packed: bytes):
        self.ids, self.tree = pickle.loads(packed)
        self.points, self.boxes, self.kind = self.tree.points, (self.tree.low, self.tree.high), None

    def ready(self, queries: np.ndarray) -> np.ndarray:
        kind = _exact(self.points, queries)
        if kind != self.kind:
            self.kind = kind
            self.tree.points, self.tree.low, self.tree.high = _as(self.points, kind), _as(self.boxes[0], kind), _as(self.boxes[1], kind)
        return _as(queries, kind)


def top_k_inner_product(rows: DataFrame, *, id: str, vector: str, queries: str, k: int = 5, scale: float = 256.0, shard_rows: int = 65536) -> DataFrame:
    """The k rows of the highest integer inner product with each query row, the query's own id left out.

    Components become floor(scale * x), x as double, kept in 16 bits where they fit. queries is an SQL condition on id. Rows are dealt by a
    hash of their id into shards of at most about shard_rows (more shards where that keeps fewer cores busy), and each shard becomes one
    KD-tree (median splits, tight boxes), built and written once. Queries, the smaller side, travel: a task holds one tree and streams the
    queries sent to it through a best-first visit by the box-to-query bound. They go to one shard first, then to three, twelve and so on; after each
    round the kth score is propagated: whatever is bounded below it is never visited and nothing below it comes back. All arithmetic
    is exact: in doubles only where every product and sum is below 2^53, else in integers of any size.

    Vectors that are null, empty or hold null or non-finite components take no part, neither do rows with a null id, nor vectors of another
    length than the table's most frequent one (of equally frequent ones the shortest). Rows that repeat an id count once: with its vector
    of the smallest encoding. Ties go to the smaller id. Fewer rows than k give all. A score beyond 64 bits counts as the nearest 64-bit
    number. Other columns are dropped, so clashing names do no harm. An empty table gives an empty result. Result: query_id, rank (from
    1), the id column, score.
    """
    spark = rows.sparkSession
    ship(spark)

    def quantised(batches):
        for batch in batches:
            for at, x in usable(batch.column("v")):
                packed = _packed(x, scale)
                arrays = [pa.array(np.full(len(at), x.shape[1]), pa.int32()), pa.array([b for b, _ in packed], pa.int32()), pa.array([v for _, v in packed], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), *arrays], ["id", "dims", "kind", "packed"])

    some = rows.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"))
    table = written(some.mapInArrow(quantised, "id long, dims int, kind int, packed binary"), "quantised")
    points = table.where(F.col("dims") == common_length(table, "dims")).drop("dims")
    n = points.count()
    shards = max(1, -(-n // shard_rows), min(-(-n // 8192), partitions(spark)))
    shard_of = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "kind", "packed"], kind="stable").drop_duplicates("id")
        vectors = _unpacked(part["kind"].tolist(), part["packed"].tolist(), scale)
        return pd.DataFrame({"shard": [part["shard"].iat[0]], "tree": [pickle.dumps((part["id"].to_numpy(), KDTree(vectors)))]})

    trees = written(points.withColumn("shard", shard_of).repartition(shards, "shard").groupBy("shard").applyInPandas(build, "shard int, tree binary"), "trees")
    asked = points.where(F.expr(queries)).groupBy("id").agg(F.min(F.struct("kind", "packed")).alias("v"))
    asked = written(asked.select("id", "v.kind", "v.packed", shard_of.alias("home")), "queries")

    def searched(batches):
        shard, number = None, None
        for batch in batches:
            numbers, tree = batch.column("shard").to_numpy(), batch.column("tree")
            edges = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1], [True]]))
            out = []
            for a, b in zip(edges, edges[1:], strict=False):
                if numbers[a] != number:
                    shard, number = None, numbers[a]
                if tree[a].is_valid:
                    shard, a = _Shard(tree[a].as_py()), a + 1
                if a == b or shard is None:
                    continue
                part = batch.slice(a, b - a)
                vectors, names, least = _unpacked(part.column("kind").to_pylist(), part.column("packed").to_pylist(), scale), part.column("id").to_pylist(), part.column("kth").to_pylist()
                vectors = shard.ready(vectors)
                for lo in range(0, len(vectors), 512):
                    bounds = shard.tree.bounds(vectors[lo : lo + 512])
                    for i, bound in enumerate(bounds, lo):
                        out += [(names[i], -v, int(s)) for s, v in shard.tree.search(vectors[i], bound, k, least[i], shard.ids, names[i])]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], ["query_id", "vec", "score"])

    best = spark.createDataFrame([], "query_id long, vec long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec"))
    none = lambda kind: F.lit(None).cast(kind)
    done, more = 0, 1
    while done < shards:
        last = min(shards, done + more) - 1
        kth = best.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
        sent = asked.withColumn("shard", F.explode(F.sequence(F.lit(done), F.lit(last))))
        sent = sent.withColumn("shard", F.pmod(F.col("home") + F.col("shard"), F.lit(shards))).join(kth, "id", "left")
        stream = trees.select("shard", "tree", none("long").alias("id"), none("int").alias("kind"), none("binary").alias("packed"), none("long").alias("kth"))
        stream = stream.unionByName(sent.select("shard", none("binary").alias("tree"), "id", "kind", "packed", "kth"))
        stream = stream.repartition(shards, "shard").sortWithinPartitions("shard", F.col("tree").isNull(), "id")
        found = best.union(stream.mapInArrow(searched, "query_id long, vec long, score long"))
        before, best = best, written(found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), "best")
        dropped(before)
        done, more = last + 1, more * GROWTH if done else GROWTH - 1
    dropped(table, trees, asked)
    return best.withColumn("rank", rank).select("query_id", "rank", F.col("vec").alias(id), "score")
