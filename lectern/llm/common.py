"""Shared plumbing of the training-data operators: bucket counts, Arrow columns, tree merges."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from lectern import storage


def bound_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Let no Arrow batch hold more than `size` bytes or one row, on either side of the pipe."""
    for key in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"):
        limit = size if "Bytes" in key else size >> 12
        now = spark.conf.get(key)
        now = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now)) if "Bytes" in key else int(now)
        if now <= 0 or now > limit:
            spark.conf.set(key, str(limit))


class Workspace(storage.Workspace):
    """Tables that one operator call writes, with Arrow batches bounded."""

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        super().__init__(spark, name)


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's estimate for the input, 0 where it has none."""
    n = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return n if n < 1 << 56 else 0


def bucket_count(df: DataFrame, each: int = 16 << 20) -> int:
    """Hash buckets that follow the input, so that one bucket always fits a worker's memory.

    Catalyst's estimate may be far off for joins; files that the table reads bound it both ways
    (parquet opens to a few times its size).
    """
    least, guess = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size_in_bytes(df)
    files = storage.input_bytes(df)
    if files:
        guess = min(max(guess, files), 16 * files)
    return min(max(least, math.ceil(guess / each)), 1 << 20)


def merge_tree(parts: DataFrame, merge: Callable[[Iterator[bytes]], bytes], fan_in: int = 64) -> bytes | None:
    """One value from bounded binary summaries (one column, `part`), merged level by level.

    Each level streams its summaries through `merge`, so a task holds two of them, and one row
    reaches the driver. None without any summary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x.as_py() for b in batches for x in b.column(0))
        first = next(rows, None)
        if first is not None:
            yield pa.RecordBatch.from_arrays([binary_array([merge(_chain(first, rows))])], ["part"])

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Without a number of partitions, so that AQE can join the small ones.
    now = parts.select("part").withColumn("at", _spread(n)).repartition("at").select("part").mapInArrow(run, "part binary")
    while n > fan_in:
        n = -(-n // fan_in)
        now = now.withColumn("at", _spread(n)).repartition(n, "at").select("part").mapInArrow(run, "part binary")
    rows = now.repartition(1).mapInArrow(run, "part binary").collect()
    return bytes(rows[0].part) if rows else None


def _chain(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


def _spread(n: int):
    from pyspark.sql import functions as F

    return F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(n))


def task_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds at most `limit` bytes of the column, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_column(batch, column)
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def text_column(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a text column; null counts as empty."""
    return utf8_parts(batch.column(batch.schema.get_field_index(column)))


def utf8_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    _, offs, data = col.buffers()
    n = len(col)
    if not n or offs is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, o - o[0]


def integers(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
