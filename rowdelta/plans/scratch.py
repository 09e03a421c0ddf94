"""A folder for files that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which all executors share; a temporary folder only on a single machine where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
        base = tempfile.mkdtemp(prefix="rowdelta-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, loop: bool = False) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder, so that loops don't grow their plan and lost executors don't matter.

    A checkpoint keeps what Spark has guessed of its size, and a join's size is guessed as the product of its sides. Where a ``loop`` makes a frame from itself such guesses soon have
    millions of digits, which take the driver's memory and time; so there frames go through files, whose sizes are known.
    """
    spark = df.sparkSession
    if loop:
        path = scratch(spark, "round")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch(spark, "checkpoints"))
    return df.checkpoint(eager=True)
