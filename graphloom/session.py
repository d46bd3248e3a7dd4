"""Lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task takes of a table that is dealt out by key.
TASK_ROWS = 500_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's spark.checkpoint.dir; a local folder only where none is set."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="graphloom-"))


def cut(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def parts(table: DataFrame) -> int:
    """How many partitions a table (of files, whose rows are counted in their footers) is dealt into.

    The number grows with the rows, so that what a task sorts or groups does not. It is
    given to ``repartition``, as partitions that Spark joins up by size grow with the input.
    """
    return max(-(-table.count() // TASK_ROWS), table.sparkSession.sparkContext.defaultParallelism)
