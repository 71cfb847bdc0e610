"""Packed exchange: fixed-width entries travel as one binary per bucket and batch.

An entry costs its own bytes instead of a row's; one buffer per column also reads back
without a loop over rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, utf8_parts


def buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each hash, from its upper half."""
    return ((hashes >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _binary(raw: np.ndarray, bounds: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(raw)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * raw.itemsize).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def pack(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each bucket that occurs, with the bytes of its entries."""
    order = np.argsort(bucket, kind="stable")
    ids, first = np.unique(bucket[order], return_index=True)
    bounds = np.append(first, len(bucket))
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), *(_binary(c[order], bounds) for c in columns.values())], ["bucket", *columns])


def ragged_binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of a flat array as binaries; bounds must start at 0 and end at len(values)."""
    return _binary(values, bounds)


def schema(*columns: str) -> str:
    return ", ".join(["bucket int", *(f"{c} binary" for c in columns)])


def unpack(batches: Iterator[pa.RecordBatch], **kinds: type) -> dict[str, np.ndarray]:
    """All entries of a partition, column by column."""
    parts: dict[str, list[np.ndarray]] = {c: [] for c in kinds}
    for batch in batches:
        for c, kind in kinds.items():
            raw, _ = utf8_parts(batch.column(batch.schema.get_field_index(c)))
            parts[c].append(np.frombuffer(raw.tobytes(), kind))
    return {c: np.concatenate(p) if p else np.empty(0, kinds[c]) for c, p in parts.items()}


def exchange(df: DataFrame, n: int) -> DataFrame:
    """Bring the entries of a bucket together."""
    return df.repartition(n, "bucket")


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by the keys, and the group number of each sorted entry."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def bloom(keys: DataFrame, column: str, log2_bits: int = 25) -> np.ndarray:
    """A bitmap of bounded size over a long column, or'ed together by the executors.

    2**(log2_bits - 6) rows of 16 bytes reach the driver at most. Beyond its capacity the
    bitmap passes every key, which costs time and changes no result: users of it join exactly.
    """
    k = F.col(column)
    slots = [F.shiftrightunsigned(F.xxhash64(k, F.lit(seed)), 64 - log2_bits) for seed in (1, 2)]
    bits = keys.select(F.explode(F.array(*slots)).alias("s"))
    words = bits.groupBy(F.shiftrightunsigned("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b"))
    out = np.zeros(1 << (log2_bits - 6), np.int64)
    for r in words.toArrow().to_batches():
        out[r.column(0).to_numpy(zero_copy_only=False)] = r.column(1).to_numpy(zero_copy_only=False)
    return out


def bloom_slots(column: str, log2_bits: int = 25) -> list:
    """Columns to test against a bitmap of bloom()."""
    k = F.col(column)
    return [F.shiftrightunsigned(F.xxhash64(k, F.lit(seed)), 64 - log2_bits).alias(f"s{seed}") for seed in (1, 2)]


def may_hold(bitmap: np.ndarray, *slots: np.ndarray) -> np.ndarray:
    ok = np.ones(len(slots[0]), bool)
    for s in slots:
        ok &= (bitmap[s >> 6] >> (s & 63)) & 1 == 1
    return ok


def split_by_ids(docs: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose id surely isn't among the ids, and those whose id may be: only these need a join.

    Both have the columns of docs; a row goes to exactly one side, whatever its other values.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(bloom(ids, column))
    taken, slots = {c.lower() for c in docs.columns}, []
    for k, c in enumerate(bloom_slots(column)):
        name = f"_slot{k}"
        while name in taken:
            name += "_"
        slots.append(c.alias(name))

    def side(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns[-2:])
                kept = batch.filter(pa.array(may_hold(sent.value, a, b) == wanted))
                yield pa.RecordBatch.from_arrays(kept.columns[:-2], kept.schema.names[:-2])

        return docs.select("*", *slots).mapInArrow(run, docs.schema)

    return side(False), side(True)
