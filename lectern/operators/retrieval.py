"""Exact nearest chunks by cosine similarity, and pluggable embedders."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.vectors import cosine, norm
from lectern.storage import Workspace, bounded


def with_norm(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.withColumn("norm", norm(F.col(column)))


def top_k(chunks: DataFrame, query: list[float], k: int, key: str = "chunk_id", column: str = "embedding") -> DataFrame:
    """The k chunks nearest to one vector with their score; ties in key order."""
    q = F.array(*(F.lit(float(x)) for x in query)).cast("array<double>")
    scored = chunks.withColumn("score", cosine(F.col(column), q))
    return scored.orderBy(F.desc("score"), key).limit(k)


def top_k_batched(chunks: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", column: str = "embedding", query_key: str = "query_id", query_column: str = "query", limit: int = 10_000) -> DataFrame:
    """The k nearest chunks of every query: query_key, rank, key, score.

    Up to `limit` queries are broadcast and scored map-side over all chunks; more of them meet the
    chunks in blocks, see top_k_blocks().
    """
    if queries.limit(limit + 1).count() > limit:
        return top_k_blocks(chunks, queries, k, key, column, query_key, query_column)
    asked = F.broadcast(queries.select(query_key, query_column, norm(F.col(query_column)).alias("_qn")))
    both = chunks.select(key, column, norm(F.col(column)).alias("_cn")).crossJoin(asked)
    scored = both.select(query_key, key, cosine(F.col(column), F.col(query_column), F.col("_cn"), F.col("_qn")).alias("score"))
    place = F.row_number().over(W.partitionBy(query_key).orderBy(F.desc("score"), key)).cast("bigint")
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select(query_key, "rank", key, "score")


#: Vectors of one block of queries and of chunks, chunk blocks that meet a query block in one task,
#: queries that are multiplied at once, and what a sum of products may be off by.
QUERY_BLOCK, CHUNK_BLOCK, TOGETHER, AT_ONCE, SLACK = 4096, 4096, 16, 512, 1e-9


class Block:
    """Vectors side by side: numbers in a row, lengths, norms, a middle and the widest angle to it."""

    def __init__(self, sizes: np.ndarray, values: np.ndarray):
        self.sizes, self.bounds, self.values = sizes, np.concatenate(([0], np.cumsum(sizes))), values
        self._rows: dict[int, tuple] = {}

    def rows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, vectors and norms of the rows of one length that can have a similarity at all."""
        if size not in self._rows:
            at = np.flatnonzero(self.sizes == size)
            m = self.values[self.bounds[at][:, None] + np.arange(size)]
            n = _norms(m)
            ok = n != 0  # also where it isn't finite
            self._rows[size] = at[ok], m[ok], n[ok]
        return self._rows[size]

    def spread(self, size: int) -> tuple[np.ndarray, float] | None:
        """A unit vector and the widest angle of the rows to it; None where they aren't finite."""
        _, m, n = self.rows(size)
        if not len(n) or not np.isfinite(n).all():
            return None
        unit = m / n[:, None]
        middle = unit.mean(axis=0)
        length = np.sqrt(middle @ middle)
        if length < 1e-6:
            return None
        middle /= length
        return middle, float(np.arccos(np.clip((unit @ middle).min(), -1, 1)))


def _norms(m: np.ndarray) -> np.ndarray:
    """As norm(): squares summed from the first to the last."""
    total = np.zeros(len(m))
    with np.errstate(all="ignore"):
        for j in range(m.shape[1]):
            total += m[:, j] * m[:, j]
        return np.sqrt(total)


def _exact(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """As cosine(): products summed from the first to the last, NaN as 0."""
    total = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for j in range(a.shape[1]):
            total += a[:, j] * b[:, j]
        s = total / (na * nb)
    return np.where(np.isnan(s), 0.0, s)


class Nearest:
    """The k best (score, key) of each query of a block, fed one chunk block after another."""

    def __init__(self, queries: Block, k: int):
        self.queries, self.k = queries, k
        self.best: list[list[tuple[float, object]]] = [[] for _ in queries.sizes]
        self.least = np.full(len(queries.sizes), -np.inf)  # scores to reach
        self.skipped = 0

    def _take(self, i: int, found: list[tuple[float, object]]) -> None:
        self.best[i] = sorted(self.best[i] + found, key=lambda x: (-x[0], x[1] is not None, x[1] if x[1] is not None else 0))[: self.k]
        if len(self.best[i]) == self.k:
            self.least[i] = self.best[i][-1][0]

    def add(self, chunks: Block, keys: list) -> None:
        order = sorted(range(len(keys)), key=lambda j: (keys[j] is not None, keys[j] if keys[j] is not None else 0))
        for size in np.unique(self.queries.sizes).tolist():
            rows, q, nq = self.queries.rows(size)
            at, m, n = chunks.rows(size) if size > 0 else (np.empty(0, int), None, None)
            # What has no similarity scores 0: the first keys of those stand for all.
            rest = np.ones(len(keys), bool)
            rest[at] = False
            zeros = [(0.0, keys[j]) for j in order if rest[j]][: self.k]
            for i in rows[self.least[rows] <= 0].tolist() if zeros else ():
                self._take(i, zeros)
            none = [(0.0, keys[j]) for j in order[: self.k]]
            for i in np.setdiff1d(np.flatnonzero(self.queries.sizes == size), rows).tolist():
                self._take(i, none)
            if len(at):
                self._multiply(rows, q, nq, at, m, n, keys, chunks.spread(size))

    def _multiply(self, rows, q, nq, at, m, n, keys, spread) -> None:
        for lo in range(0, len(rows), AT_ONCE):
            some, a, na = rows[lo : lo + AT_ONCE], q[lo : lo + AT_ONCE], nq[lo : lo + AT_ONCE]
            least = self.least[some]
            if spread is not None:
                # No angle to a row is smaller than the one to the middle less the widest one there.
                with np.errstate(all="ignore"):
                    angle = np.arccos(np.clip(a @ spread[0] / na, -1, 1)) - spread[1]
                near = ~(np.cos(np.maximum(angle, 0)) < least - SLACK)
                self.skipped += int((~near).sum())
                some, a, na, least = some[near], a[near], na[near], least[near]
                if not len(some):
                    continue
            with np.errstate(all="ignore"):
                s = (a @ m.T) / (na[:, None] * n[None, :])
            s = np.where(np.isnan(s), 0.0, s)
            if s.shape[1] > self.k:
                least = np.maximum(least, np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k])
            i, j = np.nonzero(s >= least[:, None] - SLACK)
            exact = _exact(a[i], m[j], na[i], n[j])
            cut = np.searchsorted(i, np.arange(len(some) + 1))
            for x in np.flatnonzero(np.diff(cut)).tolist():
                part = slice(cut[x], cut[x + 1])
                self._take(int(some[x]), [(e, keys[at[y]]) for e, y in zip(exact[part].tolist(), j[part].tolist())])


def _blocks(df: DataFrame, key: str, column: str, size: int, name: str) -> DataFrame:
    """Vectors packed in blocks: `part` (the partition), keys, sizes, values. Null vectors count as empty."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n = TaskContext.get().partitionId(), [], 0

        def flush():
            whole = pa.concat_arrays([b.column(0) for b in held])
            lists = pa.concat_arrays([b.column(1) for b in held])
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int32)
            values = pc.fill_null(lists.flatten().cast(pa.float64()), float("nan")).to_numpy()
            keys = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)
            return pa.RecordBatch.from_arrays([pa.array([part]), keys, pa.array([sizes.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], ["part", "keys", "sizes", "values"])

        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                held.append(batch.slice(lo, size - n))
                n, lo = n + held[-1].num_rows, lo + held[-1].num_rows
                if n == size:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    made = df.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("v")).mapInArrow(run, f"part long, keys array<{kind}>, sizes binary, values binary")
    return made.select(*(F.col(c).alias(f"{name}_{c}") for c in ("part", "keys", "sizes", "values")))


def top_k_blocks(chunks: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", column: str = "embedding", query_key: str = "query_id", query_column: str = "query", query_block: int = QUERY_BLOCK, chunk_block: int = CHUNK_BLOCK) -> DataFrame:
    """As top_k_batched() for any number of queries: blocks of both sides meet by the numbers of their cell.

    A cell is a block of queries with some blocks of chunks, so a chunk travels once for each
    block of queries and nothing is broadcast. A task multiplies matrices and keeps k rows a
    query; products that may rank are summed again as cosine() does, so scores and ties are the
    same. Chunk blocks whose widest angle rules them out for a query are skipped. What the cells
    keep is merged in two levels.
    """
    spark = chunks.sparkSession
    work = Workspace(bounded(spark), "nearest")
    n = queries.count()
    groups = max(1, -(-n // query_block))
    kind_q, kind_c = queries.schema[query_key].dataType.simpleString(), chunks.schema[key].dataType.simpleString()
    asked = work.save(_blocks(queries.repartition(groups), query_key, query_column, query_block, "q").withColumn("qb", F.monotonically_increasing_id()))
    held = work.save(_blocks(chunks, key, column, chunk_block, "c").withColumn("cb", F.monotonically_increasing_id()))
    cells = max(1, min(1 << 20, -(-held.count() // TOGETHER)))
    numbers = [r.qb for r in asked.select("qb").collect()]  # one for each block of queries
    left = held.withColumns({"cell": F.pmod(F.xxhash64("cb"), F.lit(cells)), "qb": F.explode(F.array(*map(F.lit, numbers)) if numbers else F.array().cast("array<bigint>"))})
    right = asked.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cells - 1).cast("bigint"))))
    met = left.join(right.hint("shuffle_merge"), ["qb", "cell"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: tuple | None = None

        def rows():
            flat = [(state[1][i], *x) for i, best in enumerate(state[2].best) for x in best]
            qs, scores, keys = zip(*flat) if flat else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(qs, types[0]), pa.array(keys, types[1]), pa.array(scores, pa.float64())], ["q", "c", "score"])

        for batch in batches:
            types = batch.schema.field("q_keys").type.value_type, batch.schema.field("c_keys").type.value_type
            for row in batch.to_pylist():
                who = row["qb"], row["cell"]
                if state is None or state[0] != who:
                    if state is not None:
                        yield rows()
                    state = who, row["q_keys"], Nearest(Block(np.frombuffer(row["q_sizes"], np.int32), np.frombuffer(row["q_values"])), k)
                state[2].add(Block(np.frombuffer(row["c_sizes"], np.int32), np.frombuffer(row["c_values"])), row["c_keys"])
        if state is not None:
            yield rows()

    found = met.select("qb", "cell", "q_keys", "q_sizes", "q_values", "c_keys", "c_sizes", "c_values").mapInArrow(run, f"q {kind_q}, c {kind_c}, score double")
    order = F.desc("score"), F.col("c").asc()
    near = found.withColumn("_s", F.pmod(F.xxhash64("c"), F.lit(32))).withColumn("rank", F.row_number().over(W.partitionBy("q", "_s").orderBy(*order))).where(F.col("rank") <= k)
    place = F.row_number().over(W.partitionBy("q").orderBy(*order)).cast("bigint")
    return near.withColumn("rank", place).where(F.col("rank") <= k).select(F.col("q").alias(query_key), "rank", F.col("c").alias(key), "score")


class Embedder(Protocol):
    """Turns texts to vectors; one instance serves a whole partition."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Deterministic vectors from hashed words; needs no service."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.size
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out


class HttpEmbedder:
    """One POST of {model, prompt} to <host>/api/embeddings for each text."""

    def __init__(self, host: str, model: str, timeout: float = 60):
        self.url, self.model, self.timeout = f"{host.rstrip('/')}/api/embeddings", model, timeout

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            body = json.dumps({"model": self.model, "prompt": t}).encode()
            req = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
            with urllib.request.urlopen(req, timeout=self.timeout) as r:
                out.append(json.load(r)["embedding"])
        return out


def embed_column(embedder: Embedder):
    """A pandas UDF that embeds a text column, batch by batch."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(embedder.embed(["" if t is None else t for t in texts]))

    return run


def embed(df: DataFrame, text: str, embedder: Embedder | None = None, name: str = "embedding") -> DataFrame:
    column: Column = embed_column(embedder or HashEmbedder())(F.col(text))
    return df.withColumn(name, column)
