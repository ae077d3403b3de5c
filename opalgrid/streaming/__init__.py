"""Streams of images: a folder is watched and each micro-batch goes through a batch operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalgrid.sources.images import decode_images

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_images(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Decoded images of a folder as they arrive."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).load(path)
    return decode_images(files.select(F.col("path").alias("image_id"), "content"))


def run_batches(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True):
    """Applies a batch operator to each micro-batch and appends Parquet to ``out``."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch replaces itself

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()
