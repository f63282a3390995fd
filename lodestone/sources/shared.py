"""Cutting lineage in a folder that driver and executors share, and the size of what tasks in Python take at once."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch of texts that a Python task takes at once.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in spark.checkpoint.dir and read back; rows and their order in partitions are then fixed,
    whatever executor is lost. Where none is set, a local session gets one; a cluster must name its own."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        here = spark.conf.get("spark.checkpoint.dir", None)
        if not here:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            here = tempfile.mkdtemp(prefix="lodestone-checkpoints-")
        spark.sparkContext.setCheckpointDir(here)
    return df.checkpoint()


def bounded_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to these bounds; fewer rows stay."""
    rows, size = (f"spark.sql.execution.arrow.{k}" for k in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set(size, str(BATCH_BYTES))
