"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes from learned rotations (iterative quantisation, fitted on a bounded
sample). A code is cut into substrings of about as many bits as a block's rows have digits, and
each substring has its own index. By the pigeonhole principle a code within Hamming radius r of
the query is within r // m in one of its m substrings, so probing their neighbourhoods, one shell
after another, retrieves every code inside a known radius. A search ends when that radius lies
well beyond the code distances of the k best rows by exact inner product, or holds `need` codes.

Where neighbours are far apart a shell comes to have more probes than the block has rows. Then the
block's codes are compared with the query's one by one, which finds the same codes for less.

Every vector is indexed; blocks of vectors meet blocks of queries.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, as query or candidate; rows with an equal id count once (the
smallest vector); fewer candidates than k give fewer rows; a query without candidates or an
empty table gives none; inner products that overflow are infinite; other columns are neither read
nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernel import ragged

#: Vectors and queries of one task; vectors of the fitting sample; bits of a code; codes that a block's search must hold.
BLOCK, QUERIES, SAMPLE, BITS, NEED = 16_384, 1024, 8192, 256, 512
_FOUND = "query_id long, vec_id long, score double"


@dataclass
class Coder:
    """Rotations to BITS signs. largest: the greatest norm, which turns inner products to angles; unit: what vectors are divided by first."""

    mean: np.ndarray
    turns: np.ndarray
    largest: float
    unit: float = 1.0

    def codes(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Bytes of the codes, one row for each vector."""
        # Lengths of a query don't matter: its largest component becomes one.
        x = x / (np.abs(x).max(axis=1, keepdims=True, initial=0) if query else self.unit)
        norm = np.linalg.norm(x, axis=1)
        if query:
            y = np.concatenate([x / norm[:, None], np.zeros((len(x), 1))], 1)
        else:
            rest = np.sqrt(np.maximum(self.largest**2 - norm**2, 0))
            y = np.concatenate([x, rest[:, None]], 1) / self.largest
        return np.packbits((y - self.mean) @ self.turns > 0, axis=1)


def fit(sample: np.ndarray, largest: float, bits: int = BITS, rounds: int = 15) -> Coder:
    """Principal directions of the sample, then rotations that bring it near the corners of the cube."""
    rest = np.sqrt(np.maximum(largest**2 - (sample**2).sum(1), 0))
    y = np.concatenate([sample, rest[:, None]], 1) / largest
    mean = y.mean(0)
    y = y - mean
    _, vectors = np.linalg.eigh(y.T @ y / max(1, len(y)))
    d = min(sample.shape[1], 64)
    base = vectors[:, ::-1][:, :d]
    v, rng, turns, have = y @ base, np.random.default_rng(0), [], 0
    while have < bits:
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        turns.append((base @ r)[:, : bits - have])
        have += turns[-1].shape[1]
    return Coder(mean, np.concatenate(turns, 1), largest)


_shells: dict[int, list[np.ndarray]] = {}


def shells(bits: int) -> list[np.ndarray]:
    """For each distance the masks with so many of `bits` bits."""
    if bits not in _shells:
        count = np.bitwise_count(np.arange(1 << bits, dtype=np.uint32))
        _shells[bits] = [np.flatnonzero(count == k).astype(np.uint16) for k in range(bits + 1)]
    return _shells[bits]


class ByteIndex:
    """For every substring of the codes (8 or 16 bits) the rows in order of their value."""

    def __init__(self, codes: np.ndarray, bits: int = 8):
        self.bits, self.words = bits, np.ascontiguousarray(codes).view(np.uint64)
        parts = self._parts(codes)
        (self.n, self.m), self.touched = parts.shape, 0
        size = 1 << bits
        self.order = np.concatenate([np.argsort(parts[:, s], kind="stable") for s in range(self.m)])
        counts = np.stack([np.bincount(parts[:, s], minlength=size) for s in range(self.m)])
        self.bounds = np.concatenate([np.zeros((self.m, 1), np.int64), np.cumsum(counts, 1)], 1) + self.n * np.arange(self.m)[:, None]

    def _parts(self, codes: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(codes).view(np.uint16 if self.bits == 16 else np.uint8)

    def _far(self, rows: np.ndarray | slice, code: np.ndarray) -> np.ndarray:
        word = np.ascontiguousarray(code).view(np.uint64)
        return np.bitwise_count(self.words[rows] ^ word).sum(1).astype(np.int64)

    def probe(self, code: np.ndarray):
        """Yields new rows, their distances and the radius up to which no code is missing."""
        parts, seen, spent = self._parts(code[None, :])[0], np.zeros(self.n, bool), 0
        at = np.arange(self.m)[:, None]
        for rho, masks in enumerate(shells(self.bits)):
            spent += self.m * len(masks)
            if spent > self.n and rho:  # more probes than rows
                rows = np.flatnonzero(~seen)
                self.touched += len(rows)
                yield rows, self._far(rows, code), 8 * len(code)
                return
            value = parts[:, None] ^ masks[None, :]
            lo = self.bounds[at, value]
            hit = self.order[ragged(lo.ravel(), (self.bounds[at, value.astype(np.int64) + 1] - lo).ravel())]
            fresh = np.zeros(self.n, bool)
            fresh[hit] = True
            fresh &= ~seen
            rows = np.flatnonzero(fresh)
            seen |= fresh
            self.touched += len(rows)
            yield rows, self._far(rows, code), self.m * (rho + 1) - 1

    def within(self, code: np.ndarray, need: int) -> np.ndarray:
        """All rows inside the smallest radius that holds at least `need` rows (all, if fewer)."""
        rows, far, radius = np.empty(0, np.int64), np.empty(0, np.int64), 0
        for new, d, radius in self.probe(code):
            rows, far = np.concatenate([rows, new]), np.concatenate([far, d])
            if (far <= radius).sum() >= min(need, self.n):
                break
        if len(far) > need:
            radius = min(radius, int(np.partition(far, need - 1)[need - 1]))
        return rows[far <= radius]

    def nearest(self, code: np.ndarray, k: int, need: int, score) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores inside a radius that ends where `need` codes are, or well beyond the k best by score.

        score(rows) gives exact scores. The radius suffices when it lies two standard deviations
        (of a sum of so many bits) above the largest code distance of the k best rows found, as
        further codes rarely hold better ones.
        """
        rows, far = np.empty(0, np.int64), np.empty(0, np.int64)  # retrieved
        known, dist, found = rows, far, np.empty(0)  # scored, those inside a complete radius
        for new, d, radius in self.probe(code):
            rows, far = np.concatenate([rows, new]), np.concatenate([far, d])
            enough = len(known) + int((far <= radius).sum()) >= min(need, self.n)
            if enough and len(known) + len(far) > need:
                radius = min(radius, int(np.partition(np.concatenate([dist, far]), need - 1)[need - 1]))
            inside = far <= radius
            known, dist, found = np.concatenate([known, rows[inside]]), np.concatenate([dist, far[inside]]), np.concatenate([found, score(rows[inside])])
            rows, far = rows[~inside], far[~inside]
            if enough:
                break
            if len(known) >= k:
                bits, worst = 8 * len(code), float(dist[np.argpartition(-found, k - 1)[:k]].max())
                if worst + 2 * np.sqrt(worst * (1 - worst / bits)) + 1 <= radius:
                    break
        return known, found


def usable(vector: Column, length: int) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) == length) & fine & F.exists(vector, lambda x: x != 0)


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat = table.column(column).combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)


def _unique(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids, ascending, and vectors; of equal ids the smallest vector."""
    ids, x = table.column("vec_id").to_numpy(), _matrix(table, "v")
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    if (ids[1:] == ids[:-1]).any():
        order = np.lexsort((*x.T[::-1], ids))
        ids, x = ids[order], x[order]
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    return ids[new], x[new]


def search(vectors: DataFrame, is_query: Column, k: int = 20, need: int = NEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k nearest other rows found."""
    spark = vectors.sparkSession
    found = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where("vec_id is not null")
    lengths = raw.where(F.size("v") > 0).groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    good = raw.where(usable(F.col("v"), lengths.d if lengths else 0))
    # Divided by the largest component, squares neither overflow nor vanish together.
    total = good.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("unit")).first()
    if not total.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") / F.lit(total.unit), F.lit(2.0)))
    largest = float(np.sqrt(good.agg(F.max(square)).first()[0]))
    # A draw by hash: every task sends its part of about SAMPLE rows in all.
    drawn = good if total.n <= SAMPLE else good.where(F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(1 << 30)) < int(SAMPLE / total.n * (1 << 30)))
    rows = drawn.orderBy("vec_id").select("v").collect() or good.limit(1).select("v").collect()
    made = fit(np.array([r.v for r in rows], np.float64) / total.unit, largest)
    made.unit = total.unit
    coder = spark.sparkContext.broadcast(made)
    asked = good.where(is_query)
    blocks, groups = -(-total.n // BLOCK), max(1, -(-asked.count() // QUERIES))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = good.select("vec_id", "v", own(blocks).alias("block"), every(groups, "part"))
    right = asked.select("vec_id", "v", every(blocks, "block"), own(groups).alias("part"))

    def meet(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        if not ours.num_rows or not theirs.num_rows:
            return found.empty_table()
        ids, x = _unique(ours)
        q_ids, q = _unique(theirs)
        index, codes = ByteIndex(coder.value.codes(x, False), 16 if len(ids) >= 2048 else 8), coder.value.codes(q, True)
        out = []
        for j in range(len(q_ids)):
            with np.errstate(over="ignore", invalid="ignore"):
                rows, score = index.nearest(codes[j], k + 1, need + 1, lambda r: (x[r] * q[j]).sum(axis=1))  # one more, as the query itself may be there
            rows, score = rows[ids[rows] != q_ids[j]], score[ids[rows] != q_ids[j]]
            best = np.lexsort((ids[rows], -score))[:k]
            out.append((np.full(len(best), q_ids[j]), ids[rows][best], score[best]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=found)

    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, _FOUND)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
