"""Folder watcher: new files reach the store as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch_batches(spark: SparkSession, folder: str, ingest: Callable[[DataFrame, int], object], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Call ingest with the rows of every batch of new files (path, modificationTime, length, content) and its number.

    A batch may come again after a failure, with the same number and the same files.
    """
    files = spark.readStream.format("binaryFile").schema(BINARY).load(folder)
    writer = files.writeStream.foreachBatch(lambda batch, number: ingest(batch, number) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def watch_folder(spark: SparkSession, folder: str, ingest: Callable[[DataFrame], object], checkpoint: str, once: bool = False) -> StreamingQuery:
    """As watch_batches(), without the number: for an ingest that skips what it knows."""
    return watch_batches(spark, folder, lambda batch, _: ingest(batch), checkpoint, once)
