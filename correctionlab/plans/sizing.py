"""Materialisation and size checks that keep plans safe at any data size."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A few hundred bytes a row: at most tens of MB on each executor.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a local one only for local masters."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """Within it each job's shuffle files go when the job ends, instead of when the driver happens to collect garbage.

    For steps that each write a table: what stays on disk is the tables, and the shuffles of one step. A frame that is run twice
    shuffles twice.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def cut_lineage(df: DataFrame, name: str = "table", partition_by: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    A written table survives lost executors, and its file sizes give Catalyst true statistics,
    so joins to it are planned by size without any hint. With `partition_by`, readers that filter on
    that column open only their part of the files.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_within(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast `df` when it has at most `max_rows` rows, else leave it to a shuffled join.

    Counting stops one row past the bound. Call it on written tables, not on long plans.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def hashed(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, a written table of distinct keys, as the side that a join looks up: broadcast within the bound, else a hash table of each partition's share.

    A sort-merge join would sort the other side, and write what of it doesn't fit in memory to disk; for texts that is most of them.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df.hint("shuffle_hash")


ROWS_PER_TASK = 1_000_000  # a few hundred MB to sort


def tasks_for(spark: SparkSession, rows: int, per_task: int = ROWS_PER_TASK) -> int | None:
    """Into how many partitions to deal this many rows for a sort, so that a task's share does not grow with the table.

    None where the session's number of shuffle partitions is enough: the plan is left to Spark then.
    """
    tasks = -(-rows // per_task)
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """`df` dealt by keys that the next join or grouping has, into `tasks` partitions; as it is for None."""
    return df if tasks is None else df.repartition(tasks, *keys)
