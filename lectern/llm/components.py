"""Connected components by alternating large-star and small-star contraction.

Every step is a partial aggregation and a join on node ids, so neither links nor components are
gathered anywhere; each round is written to the shared folder. Before the rounds each task
contracts links of its own, about TASK_BYTES of them; where these are all, no round is needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern import storage

from .common import Workspace

#: Bytes of written links that a task contracts, and links that it holds at a time.
TASK_BYTES, HELD = 1 << 20, 1 << 20


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links, and the smallest node that these links join each with."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        low, now = np.minimum(root[u], root[v]), root.copy()
        np.minimum.at(now, root[u], low)
        np.minimum.at(now, root[v], low)
        while not np.array_equal(now, now[now]):
            now = now[now]
        if np.array_equal(now, root):
            return ids, ids[root]
        root = now


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the same components, from each node of a task's links to the smallest one that it reaches there."""
    held, n = [], 0

    def made() -> pa.RecordBatch:
        nodes, roots = local_roots(*(np.concatenate(x) for x in zip(*held)))
        more = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[more]), pa.array(roots[more])], ["a", "b"])

    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += batch.num_rows
        if n >= HELD:
            yield made()
            held, n = [], 0
    if n:
        yield made()


def _contracted(links: DataFrame) -> tuple[DataFrame, int]:
    """Written links after contraction, and by how many tasks."""
    tasks = max(1, math.ceil(storage.input_bytes(links) / TASK_BYTES))
    return links.coalesce(tasks).mapInArrow(contract, "a long, b long"), tasks


def connected_components(edges: DataFrame, work: Workspace, most: int = 60) -> DataFrame:
    """node and root (the smallest node of its component) for all nodes of edges (a, b).

    Loops and repeated edges change nothing; without edges the result is empty.
    """
    clean = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = work.save(clean), None
    links, tasks = _contracted(now)
    final = tasks == 1 and now.count() < HELD  # held by one task at a time, so nothing is left to join
    before, now = now, work.save(links)
    work.drop(before)
    for _ in range(0 if final else most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Dealt anew, so that both sides of the joins are plain exchanges: a star of half of all
        # nodes can be split.
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")).repartition("a")
        # Large star: neighbours above a node point to the smallest node around it.
        large = both.join(low, "a").where("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours point to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.repartition("a"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, now = now, work.save(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        work.drop(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        if not final:
            raise RuntimeError(f"components didn't settle in {most} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
