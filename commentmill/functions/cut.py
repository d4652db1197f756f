"""Cutting lineage where a result is read more than once, and dealing rows to tasks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Rows below which nothing is dealt anew, and how far above its share the largest partition may be.
FEW_ROWS, SHARES = 1_000, 4


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; a temporary one only where none is set and
    the session is a local one (as in tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(folder)


def materialized(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in reliable storage. A lost executor re-reads
    them; it does not repeat the work (for a scorer: it does not score again)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """The same rows; dealt evenly if a few partitions hold most of them, as those of a file that cannot be
    split do. Partitions are counted first."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]  # one line per partition
    if sum(held) < FEW_ROWS or max(held) * cores <= SHARES * sum(held):
        return df
    return df.repartition(max(2 * cores, len(held)))
