"""The shared folder for data that outlives a plan."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a fresh local one only where a local session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return folder or current
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a shared folder")
        folder = tempfile.mkdtemp(prefix="tessera-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The frame materialised in the shared folder, without its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
