"""Incremental flattening of arriving cell files (an extension: what was done is remembered between runs)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import nested
from tessera.sources.files import patch_of


def flatten_arriving(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 10_000) -> StreamingQuery:
    """Flatten the cell files below ``source`` that earlier runs have not seen into tagged rows below ``target``, then stop.

    The checkpoint holds which files are done, so a run that dies is taken up by the next without loss or
    repeats. ``files_per_batch`` bounds a micro-batch.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(source)
    named = files.select(F.xxhash64("_metadata.file_path").alias("file_id"), patch_of(F.col("_metadata.file_path")).alias("patch_id"), F.col("value").alias("body"))
    return nested.emit(named).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).partitionBy("tag").trigger(availableNow=True).start()
