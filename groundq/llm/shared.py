"""Tables and folders that the driver and all executors can reach, and joins that no frequent key holds up."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that may be frequent enough to be broadcast, at most.
HOT_KEYS = 20_000

_open: list[Scratch] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Only on one machine (a local master, as in tests) may a local folder stand in where that is unset."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="groundq-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir() or base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there: lineage ends here and lost executors lose nothing."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if _open:
        _open[-1].paths.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._groundq_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of `written` that no later plan reads."""
    for table in tables:
        if path := getattr(table, "_groundq_path", None):
            _delete(table.sparkSession, path)


class Scratch:
    """The tables that operators wrote for a result which is still to be read."""

    def __init__(self):
        self.paths: list[tuple[SparkSession, str]] = []

    def release(self) -> None:
        """Deletes them; to be called once the result itself is written or no longer wanted."""
        for spark, path in self.paths:
            _delete(spark, path)
        self.paths.clear()


@contextmanager
def scratch() -> Iterator[Scratch]:
    """Notes every table written within the block:

    with scratch() as tables: out = operator(...)
    out.write.parquet(path); tables.release()
    """
    _open.append(Scratch())
    try:
        yield _open[-1]
    finally:
        _open.pop()


def joined(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, least: int = 1000) -> DataFrame:
    """rows joined to groups (one row a key) on key, without a task that holds all rows of a frequent key.

    size: the column of groups that says how many rows have the key; total: their sum or more. Keys of more than max(least, total / HOT_KEYS)
    rows are joined by a broadcast, as there can be no more than HOT_KEYS of them; all others by a shuffle.
    """
    limit = max(least, total // HOT_KEYS)
    hot = F.broadcast(groups.where(F.col(size) > limit))
    others = rows.join(F.broadcast(groups.where(F.col(size) > limit).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(others.join(groups.where(F.col(size) <= limit), key))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
