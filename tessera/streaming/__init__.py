"""Incremental ingest: a file-source stream of N-Triples or N-Quads lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.readers import lines


def quad_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming DataFrame of the quads in files that arrive in a folder; a line is parsed once, by native functions.

    Statements are not made unique: that would need unbounded state. Use dropDuplicatesWithinWatermark on an event
    time of your own, or merge micro-batches into a table.
    """
    return lines(spark.readStream.text(folder), F.lit(""), uescapes=False)
