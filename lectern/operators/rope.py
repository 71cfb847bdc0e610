"""A corpus as a rope: offsets, parallel bounded splitting and packing, without one string for the corpus.

Splitting is a walk: where a piece ends depends on where it began, so a loop would follow a corpus
from its start. Here the corpus is cut into blocks of equal size, and every block tells for each
offset at which a walk may enter it where that walk leaves it. That map is a step function, and
after a few pieces nearly always a constant, since walks meet at the same white space. Maps are
composed by pointer doubling over blocks, and then every block is cut by itself. Nothing but one
block is ever held by a task, however much one corpus holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.storage import Workspace, bounded, steady

from .ordered import segmented_sum

# The code points that count as white space.
WHITE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
BLANK = "".join(map(chr, WHITE))
#: Characters of a block; at least as many as one piece may hold.
BLOCK = 1 << 16
#: Blocks at most whose small rows are sent to every task rather than joined by an exchange of the texts.
SENT = 1 << 20


class Cuts:
    """Where the walk goes on inside one block: at the last mark that a piece reaches, else `most` further."""

    def __init__(self, marks: np.ndarray, reach: int, most: int, end: int | None, block: int):
        self.marks, self.reach, self.most, self.end, self.block = marks, reach, most, end, block

    def step(self, p: np.ndarray) -> np.ndarray:
        if len(self.marks):
            i = np.searchsorted(self.marks, p + self.reach, "right") - 1
            c = self.marks[np.maximum(i, 0)]
            to = np.where((i >= 0) & (c > p), c, p + self.most)
        else:
            to = p + self.most
        return to if self.end is None else np.where(self.end - p <= self.most, np.maximum(self.end, p), to)

    def _inside(self, p: np.ndarray) -> np.ndarray:
        return (p < self.block) & (p < (self.block if self.end is None else self.end))

    def exits(self, entries: np.ndarray) -> np.ndarray:
        """Offsets in the next block at which walks from the entries arrive."""
        now, back = entries, np.arange(len(entries))
        while (inside := self._inside(now)).any():
            # Walks that meet go on as one.
            now, again = np.unique(np.where(inside, self.step(now), now), return_inverse=True)
            back = again[back]
        return np.maximum(now - self.block, 0)[back]

    def walk(self, entry: int) -> np.ndarray:
        """The entry and all later cuts up to the first at or behind the block's end."""
        out = [entry]
        while self._inside(np.array(out[-1])):
            out.append(int(self.step(np.array([out[-1]]))[0]))
        return np.array(out)


def _pack(exits: np.ndarray) -> bytes:
    """A step function over 0, 1, ... as the places of its last equal values, and these."""
    last = np.append(np.flatnonzero(exits[1:] != exits[:-1]), len(exits) - 1)
    return np.stack([last, exits[last]]).astype(np.int32).tobytes()


def _apply(packed: bytes, p: np.ndarray) -> np.ndarray:
    last, value = np.frombuffer(packed, np.int32).reshape(2, -1)
    return value[np.minimum(np.searchsorted(last, p), len(last) - 1)]


def _compose(first: bytes, then: bytes) -> bytes:
    last, value = np.frombuffer(first, np.int32).reshape(2, -1)
    return np.stack([last, _apply(then, value)]).astype(np.int32).tobytes()


def _maps(blocks: DataFrame, group: str, cuts: Callable[[dict], Cuts], columns: list[str], most: int) -> DataFrame:
    """group, block, map and `fixed`, the exit where all entries share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, fixed = [], []
            for row in batch.select(["block", *columns]).to_pylist():
                exits = cuts(row).exits(np.arange(1 if row["block"] == 0 else most))
                maps.append(_pack(exits))
                fixed.append(int(exits[0]) if (exits == exits[0]).all() else None)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(group)), batch.column(batch.schema.get_field_index("block")), pa.array(maps, pa.binary()), pa.array(fixed, pa.int64())], [group, "block", "map", "fixed"])

    return blocks.select(group, "block", *columns).mapInArrow(run, f"{_kind(blocks, group)}, block long, map binary, fixed long")


def _entries(work: Workspace, maps: DataFrame, group: str) -> DataFrame:
    """group, block, entry: where the walk from a group's start enters each of its blocks but the first.

    A row waits with a pointer to an earlier block and the composed map from there; each round
    doubles the distance, until a block is reached whose entry is known.
    """

    @F.pandas_udf("binary")
    def both(first: pd.Series, then: pd.Series) -> pd.Series:
        return pd.Series([_compose(a, b) if a is not None else None for a, b in zip(first, then)])

    @F.pandas_udf("long")
    def at(packed: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([int(_apply(m, np.array([int(x)]))[0]) if x == x else None for m, x in zip(packed, p)], dtype="Int64")

    now = work.save(maps.select(group, (F.col("block") + 1).alias("block"), F.col("block").alias("from"), "map", F.col("fixed").alias("entry")))
    while not (open_ := now.where("entry is null")).isEmpty():
        ahead = now.select(F.col(group).alias("_g"), F.col("block").alias("_b"), F.col("from").alias("_from"), F.col("map").alias("_map"), F.col("entry").alias("_entry"))
        met = open_.join(ahead, (F.col(group).eqNullSafe(F.col("_g"))) & (F.col("from") == F.col("_b")))
        step = met.select(group, "block", F.col("_from").alias("from"), F.when(F.col("_entry").isNull(), both("_map", "map")).otherwise(F.col("map")).alias("map"), at("map", "_entry").alias("entry"))
        now = work.save(now.where("entry is not null").unionByName(step))
    return now.select(group, "block", "entry")


def _sent(small: DataFrame) -> DataFrame:
    """A saved table of a few numbers for each block, broadcast unless there are very many."""
    return F.broadcast(small) if small.count() <= SENT else small


def _entered(blocks: DataFrame, entries: DataFrame, group: str) -> DataFrame:
    other = entries.select(F.col(group).alias("_g"), F.col("block").alias("_b"), "entry")
    met = blocks.join(_sent(other), F.col(group).eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b")), "left")
    return met.drop("_g", "_b").withColumn("entry", F.coalesce("entry", F.lit(0).cast("long")))


def _kind(df: DataFrame, column: str) -> str:
    return f"`{column}` {df.schema[column].dataType.simpleString()}"


def text_blocks(parts: DataFrame, group: str, *order: str, text: str = "text", block: int = BLOCK, more: int = 0) -> DataFrame:
    """group, block, text: the parts of each group laid end to end, in blocks and the `more` characters behind each."""
    placed = segmented_sum(parts.where(F.col(text) != ""), F.char_length(text).cast("long"), group, *order, name="_end")
    placed = placed.select(group, (F.col("_end") - F.char_length(text)).alias("_at"), F.col(text).alias("_t"))

    def slice_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                at, t = batch.column(1)[j].as_py(), batch.column(2)[j].as_py()
                first, last = max(0, (at - block - more) // block), (at + len(t) - 1) // block
                rows = [(k, max(k * block - at, 0), min((k + 1) * block + more - at, len(t))) for k in range(first, last + 1)]
                rows = [r for r in rows if r[1] < r[2]]
                for lo in range(0, len(rows), 64):
                    some = rows[lo : lo + 64]
                    one = pa.array([j] * len(some))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(one), pa.array([r[0] for r in some], pa.int64()), pa.array([at + r[1] for r in some], pa.int64()), pa.array([t[r[1] : r[2]] for r in some], pa.string())], [group, "block", "at", "t"])

    cut = placed.mapInArrow(slice_up, f"{_kind(parts, group)}, block long, at long, t string")
    # A block's group is bounded by its characters, so no corpus is ever collected.
    ordered = F.array_sort(F.collect_list(F.struct("at", "t")))
    return cut.groupBy(group, "block").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "").alias("text"))


def _text_cuts(row: dict, most: int, block: int, tail: int) -> tuple[Cuts, str]:
    t = row["text"]
    code = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    end = len(t) - tail if len(t) < block + most + tail else None
    return Cuts(np.flatnonzero(np.isin(code, WHITE)), most - 1, most, end, block), t


def split_corpus(parts: DataFrame, group: str, *order: str, most: int, text: str = "text", separator: str = "", block: int = BLOCK) -> DataFrame:
    """group, chunk_index, start, piece: what bounded_split() makes of each group's joined parts.

    Parts are laid end to end in order with the separator between them; start is the piece's
    offset in the joined text, before trimming. Ties in the order are broken arbitrarily.
    """
    if block < most:
        raise ValueError("a block must hold a whole piece")
    steady(parts.sparkSession)
    work, tail = Workspace(bounded(parts.sparkSession), "rope"), len(separator)
    closed = parts.withColumn(text, F.concat(F.col(text), F.lit(separator)))
    blocks = work.save(text_blocks(closed, group, *order, text=text, block=block, more=most + tail))
    maps = _maps(blocks, group, lambda row: _text_cuts(row, most, block, tail)[0], ["text"], most)
    ready = _entered(blocks, _entries(work, maps, group), group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j, row in enumerate(batch.select(["block", "text", "entry"]).to_pylist()):
                cuts, t = _text_cuts(row, most, block, tail)
                p = cuts.walk(row["entry"]).tolist()
                whole = row["block"] == 0 and cuts.end is not None and cuts.end <= most
                cut = [(row["block"] * block + a, t[a:b]) for a, b in zip(p, p[1:])] or ([(0, "")] if whole else [])
                pieces = [(a, x) for a, x in ((a, x.strip(BLANK)) for a, x in cut) if whole or x]
                if pieces:
                    start, piece = zip(*pieces)
                    one = pa.array([j] * len(pieces))
                    yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(group)).take(one), batch.column(batch.schema.get_field_index("block")).take(one), pa.array(range(len(pieces)), pa.int64()), pa.array(start, pa.int64()), pa.array(piece, pa.string())], [group, "block", "chunk_index", "start", "piece"])

    kept = work.save(ready.mapInArrow(run, f"{_kind(parts, group)}, block long, chunk_index long, start long, piece string"))
    # Pieces are numbered inside their blocks; only the blocks' counts are summed along a group.
    counts = kept.groupBy(group, "block").agg(F.count("*").alias("_n"))
    before = segmented_sum(counts, F.col("_n"), group, "block", name="_upto")
    before = work.save(before.select(F.col(group).alias("_g"), F.col("block").alias("_b"), (F.col("_upto") - F.col("_n")).alias("_off")))
    met = kept.join(_sent(before), F.col(group).eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b")))
    return met.select(group, (F.col("_off") + F.col("chunk_index")).alias("chunk_index"), "start", "piece")


def pack_facts(facts: DataFrame, group: str, order: str, size: Column, most: int, block: int | None = None) -> DataFrame:
    """Rows with _pack and _end: equal packs are runs of neighbours whose sizes sum to `most` or less.

    Packs are filled in order, each until the next row doesn't fit. _end is where a row's sizes
    end in its group. Rows of a size over `most` are refused by the caller's contract.
    """
    work, block = Workspace(facts.sparkSession, "packs"), max(block or BLOCK, most)
    placed = work.save(segmented_sum(facts, size.cast("long"), group, order, name="_end"))
    # A mark belongs to the block that it ends in, and is seen by the one before where that reaches it.
    own = F.floor((F.col("_end") - 1) / block).cast("long")
    seen = placed.select(group, "_end", F.explode(F.when((own > 0) & (F.col("_end") - own * block <= most), F.array(own, own - 1)).otherwise(F.array(own))).alias("block"))
    blocks = work.save(seen.groupBy(group, "block").agg(F.array_sort(F.collect_list(F.col("_end") - F.col("block") * block)).alias("marks")))
    cuts = lambda row: Cuts(np.array(row["marks"], np.int64), most, most, None, block)
    ready = _entered(blocks, _entries(work, _maps(blocks, group, cuts, ["marks"], most), group), group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j, row in enumerate(batch.select(["block", "marks", "entry"]).to_pylist()):
                p = cuts(row).walk(row["entry"])
                marks = np.unique(np.array(row["marks"], np.int64))
                marks = marks[marks <= block]
                if len(marks):
                    base, one = row["block"] * block, pa.array([j] * len(marks))
                    # The pack that a row belongs to is known by its end: the first cut that isn't before the row's.
                    yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(group)).take(one), pa.array(base + marks), pa.array(base + p[np.searchsorted(p, marks)])], [group, "end", "pack"])

    packs = ready.mapInArrow(run, f"{_kind(facts, group)}, end long, pack long").select(F.col(group).alias("_g"), F.col("end").alias("_e"), F.col("pack").alias("_pack"))
    return placed.join(packs, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_end") == F.col("_e"))).drop("_g", "_e")
