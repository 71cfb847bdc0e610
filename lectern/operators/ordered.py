"""Global order at scale: numbering, prefix sums and running maxima over range partitions.

A window without partitions would draw all rows into one task. Here rows are dealt by range,
each partition is scanned by itself, and only one summary row for each partition is scanned
globally.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.storage import written


def _placed(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rows sorted in range partitions, with _part and _idx: one exchange, as the sort's own count is the number."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.withColumns({"_part": F.spark_partition_id(), "_idx": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1})


def dealt(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rows with _part, ascending along the order, and _idx inside it from 1."""
    return written(_placed(df, *order))


def _differs(col: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal, and so are NaNs."""
    a, b = col[:-1], col[1:]
    null = col.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_struct(col.type):
        other = [_differs(x) for x in col.flatten()]
        return np.logical_or.reduce([null[1:] != null[:-1], *other])
    if pa.types.is_nested(col.type):
        return np.array([x != y for x, y in zip(a.to_pylist(), b.to_pylist())], bool)
    out = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (null[1:] != null[:-1])
    if pa.types.is_floating(col.type):
        nan = pc.fill_null(pc.is_nan(col), False).to_numpy(zero_copy_only=False)
        out &= ~(nan[1:] & nan[:-1])
    return out


def _begins(before: pa.Array | None, col: pa.Array) -> np.ndarray:
    """Where a group begins in a batch whose predecessor ended with the group `before`."""
    if before is None:
        return np.append(True, _differs(col))
    return _differs(pa.concat_arrays([before, col]))


def _scanned(df: DataFrame, group: str, order: tuple, fields: list[T.StructField], scan: Callable) -> DataFrame:
    """Written rows, dealt by range, with what a scan over each partition adds to them.

    scan: (batch, begins, state) -> (arrays, state), for one batch of a partition's sorted rows.
    """
    rows = _placed(df, group, *order)
    names = [*rows.columns, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = state = None
        for batch in batches:
            if batch.num_rows:
                col = batch.column(batch.schema.get_field_index(group))
                more, state = scan(batch, _begins(before, col), state)
                before = col.slice(len(col) - 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names)

    return written(rows.mapInArrow(run, T.StructType([*rows.schema.fields, *fields])))


def _first_groups(rows: DataFrame, group: str, *ends: Column) -> DataFrame:
    """_p, _g and `ends` of every earlier partition, _q, that ends with the group that partition _p begins with.

    No other group of a partition has rows in earlier ones, so this takes a row for each partition.
    """
    found = written(rows.groupBy("_part").agg(F.min_by(group, "_idx").alias("_f"), F.max_by(group, "_idx").alias("_l"), *ends))
    here = found.select(F.col("_part").alias("_p"), F.col("_f").alias("_g"))
    earlier = found.withColumnRenamed("_part", "_q").drop("_f")
    return here.join(F.broadcast(earlier), F.col("_g").eqNullSafe(F.col("_l")) & (F.col("_q") < F.col("_p"))).drop("_l")


def _before() -> W:
    return W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)


def number_rows(df: DataFrame, *order: Column | str, base: Column | int = 0, name: str = "id") -> DataFrame:
    """Dense numbers from `base` on along the order."""
    rows = dealt(df, *order)
    counts = rows.groupBy("_part").agg(F.max("_idx").alias("n"))
    # One row for each partition: as many as shuffle partitions, whatever the input.
    offsets = counts.select("_part", F.coalesce(F.sum("n").over(_before()), F.lit(0)).alias("_off"))
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_off") + F.col("_idx") - 1 + base).cast("bigint")).drop("_part", "_idx", "_off")


def running_sum(df: DataFrame, value: Column, *order: Column | str, name: str = "running") -> DataFrame:
    """Sum of the value from the first row along the order to each row."""
    return segmented_sum(df.withColumn("_all", F.lit(0)), value, "_all", *order, name=name).drop("_all")


def segmented_sum(df: DataFrame, value: Column, group: str, *order: Column | str, name: str = "running") -> DataFrame:
    """As running_sum(), from the first row of each group: no group is drawn into one task.

    Only the group that a partition begins with can have rows in earlier ones, so what is carried
    over is one row for each partition at most. Rows are exchanged once.
    """
    valued = df.drop(name).withColumn("_v", value)
    kind = valued.agg(F.sum("_v").alias("n")).schema["n"].dataType
    valued = valued.withColumn("_v", F.col("_v").cast(kind))
    whole = isinstance(kind, T.LongType)

    def scan(batch: pa.RecordBatch, begins: np.ndarray, state: tuple | None) -> tuple:
        col = batch.column(batch.schema.get_field_index("_v"))
        known = col.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.maximum.accumulate(np.where(begins, np.arange(len(col)), -1))
        total, count = state or (0, 0)

        def upto(n: np.ndarray, carried) -> np.ndarray:
            run = np.cumsum(n)
            return run - np.where(start < 0, -carried, (run - n)[start])

        if whole:
            sums = upto(pc.fill_null(col, 0).to_numpy(zero_copy_only=False), total)
        else:  # differences of running sums would round
            n = np.array([0 if x is None else x for x in col.to_pylist()], None if isinstance(kind, T.DoubleType) else object)
            parts = np.split(n, np.flatnonzero(begins))
            sums = np.concatenate([np.cumsum(np.append(total, parts[0]))[1:], *(np.cumsum(p) for p in parts[1:])])
        counts = upto(known, count)
        made = pa.array(sums, mask=counts == 0) if whole else pa.array([x if c else None for x, c in zip(sums.tolist(), counts)], col.type)
        return [made], (sums[-1], counts[-1])

    rows = _scanned(valued, group, order, [T.StructField(name, kind)], scan)
    carried = _first_groups(rows, group, F.max_by(name, "_idx").alias("_n")).groupBy("_p", "_g").agg(F.sum("_n").alias("_off"))
    met = rows.join(F.broadcast(carried), (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")), "left")
    both = F.when(F.col(name).isNull(), F.col("_off")).otherwise(F.col(name) + F.coalesce("_off", F.lit(0).cast(kind)))
    return met.withColumn(name, both.cast(kind)).drop("_part", "_idx", "_p", "_g", "_off", "_v")


def segmented_last(df: DataFrame, values: dict[str, Column], group: str, *order: Column | str) -> DataFrame:
    """For each row the last value that isn't null among the earlier rows of its group, by name.

    Two levels, as in segmented_sum(): a group may hold all rows.
    """
    inner = {f"_v_{name}": c for name, c in values.items()}
    valued, held = df.withColumns(inner).drop(*values), list(inner)

    def scan(batch: pa.RecordBatch, begins: np.ndarray, state: list | None) -> tuple:
        n, made, kept = batch.num_rows, [], []
        # Row k is at k + 1: the value carried over from the last batch comes before.
        start = np.maximum.accumulate(np.where(begins, np.arange(1, n + 1), 0))
        for k, name in enumerate(held):
            col = batch.column(batch.schema.get_field_index(name))
            col = pa.concat_arrays([state[k] if state else pa.nulls(1, col.type), col])
            valid = col.is_valid().to_numpy(zero_copy_only=False)
            seen = np.maximum.accumulate(np.where(valid, np.arange(n + 1), -1))
            made.append(col.take(pa.array(seen[:-1], mask=seen[:-1] < start)))
            kept.append(col.take(pa.array(seen[-1:], mask=seen[-1:] < start[-1])))
        return made, kept

    fields = [T.StructField(name, valued.schema[f"_v_{name}"].dataType) for name in values]
    rows = _scanned(valued, group, order, fields, scan)
    ends = [F.max_by(F.coalesce(f"_v_{name}", name), "_idx").alias(f"_c_{name}") for name in values]
    last = [F.max_by(f"_c_{name}", F.when(F.col(f"_c_{name}").isNotNull(), F.col("_q"))).alias(f"_c_{name}") for name in values]
    carried = _first_groups(rows, group, *ends).groupBy("_p", "_g").agg(*last)
    met = rows.join(F.broadcast(carried), (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")), "left")
    return met.withColumns({name: F.coalesce(name, f"_c_{name}") for name in values}).drop("_part", "_idx", "_p", "_g", *inner, *(f"_c_{name}" for name in values))


def queue_waits(calls: DataFrame, arrival: Column, duration: Column, *order: Column | str) -> DataFrame:
    """Waiting time of each call of a first-in first-out queue with one server, as column wait.

    finish = S + max over earlier and own j of (arrival_j - S before j), S the running sum of
    durations; both sums and maxima are scanned by partition and then over partitions.
    """
    rows = dealt(calls.withColumns({"_a": arrival, "_d": duration}), *order)
    upto = W.partitionBy("_part").orderBy("_idx").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_s", F.sum("_d").over(upto)).withColumn("_gap", F.col("_a") - F.col("_s") + F.col("_d"))
    rows = rows.withColumn("_m", F.max("_gap").over(upto))
    ends = rows.groupBy("_part").agg(F.sum("_d").alias("s"), F.max("_gap").alias("m"))
    ends = ends.withColumn("_so", F.coalesce(F.sum("s").over(_before()), F.lit(0)))
    ends = ends.withColumn("_mo", F.max(F.col("m") - F.col("_so")).over(_before())).select("_part", "_so", "_mo")
    full = rows.join(F.broadcast(ends), "_part")
    finish = F.col("_s") + F.col("_so") + F.greatest(F.col("_m") - F.col("_so"), F.col("_mo"))
    return full.withColumn("wait", finish - F.col("_d") - F.col("_a")).drop(*(c for c in full.columns if c.startswith("_")))
