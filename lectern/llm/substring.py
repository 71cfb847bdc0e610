"""Removal of repeated word sequences by difference-cover anchors.

Anchors are hashes of short windows at the positions of a document that fall into a difference
cover modulo a period. For any two positions some shift below the period brings both into the
cover, so every pair of equal windows holds an anchor pair at equal offsets. Only windows
around repeated anchors are then hashed in full (96 bits), which extends each match to its
whole length without comparing documents in pairs. Each batch sends an anchor or window once,
however often it holds it, so that a passage in a third of all documents stays small.

Defined results: a null or empty text has no words, nothing removed, and the hash of no bytes;
texts shorter than a window lose nothing; repeated rows repeat all their windows, so their long
texts are removed entirely; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bucket_count, slices, text_column
from .kernel import NOT_SPACE, mix, ragged, spans, windows, word_hashes
from .packed import bloom, bloom_slots, buckets, exchange, groups, may_hold, pack, ragged_binary, schema, unpack

# Perfect difference sets; each difference modulo the period occurs once.
PERFECT = {
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
}
_BYTES = 3 << 20
RESULT = "key long, doc_id long, n_words long, n_removed long, kept_sha256 string, starts array<int>, ends array<int>"


def cover(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and anchor length for matches of `window` words or more."""
    fitting = [v for v in PERFECT if v <= max(1, window * 3 // 5)]
    if not fitting:
        return 1, (0,), window
    v = max(fitting)
    return v, PERFECT[v], window - v + 1


def _batch_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offs = text_column(batch, "text")
    start, end, bounds = spans(data, offs, NOT_SPACE)
    return word_hashes(data, start, end, False), bounds


def _longs(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)


ENTRY = ("h", "x", "g", "k", "p", "f")


def _entries(h: np.ndarray, g: np.ndarray, key: np.ndarray, pos: np.ndarray, n: int, wide: bool) -> Iterator[pa.RecordBatch]:
    """One entry for each different hash (f = 0), and what already repeats inside the batch (f = 1).

    wide: send whole hashes. Half of one tells the anchors of a bucket apart well enough: two that
    it confuses only add windows to look at.
    """
    if not len(h):
        return
    order, group = groups(h, g)
    size = np.bincount(group)
    first = np.ones(len(order), bool)
    first[1:] = group[1:] != group[:-1]
    lead, sure = order[first], order[size[group] > 1]
    at = np.concatenate([lead, sure])
    bucket = np.concatenate([buckets(h[lead], n), buckets(mix(key[sure].view(np.uint64)), n)])
    flag = np.concatenate([np.zeros(len(lead), np.uint8), np.ones(len(sure), np.uint8)])
    upper = (h[at] >> np.uint64(32)).astype(np.uint32) if wide else np.zeros(len(at), np.uint32)
    yield pack(bucket, {"h": h[at].astype(np.uint32), "x": upper, "g": g[at], "k": key[at], "p": pos[at].astype(np.uint32), "f": flag})


def _repeated(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Of a bucket's entries those whose hash came from more than one place, packed by document."""
    e = unpack(batches, h=np.uint32, x=np.uint32, g=np.uint32, k=np.int64, p=np.uint32, f=np.uint8)
    free = np.flatnonzero(e["f"] == 0)
    order, group = groups(e["h"][free].astype(np.uint64) << np.uint64(32) | e["x"][free], e["g"][free])
    many = free[order[np.bincount(group)[group] > 1]] if len(free) else free
    take = np.concatenate([many, np.flatnonzero(e["f"] == 1)])
    key, pos = e["k"][take], e["p"][take]
    for lo in range(0, len(key), 1 << 20):
        k, p = key[lo : lo + (1 << 20)], pos[lo : lo + (1 << 20)]
        yield pack(buckets(mix(k.view(np.uint64)), n), {"k": k, "p": p})


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct positions of each document, in one binary."""
    e = unpack(batches, k=np.int64, p=np.uint32)
    order, group = groups(e["k"], e["p"])
    key, pos = e["k"][order], e["p"][order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])
    key, pos = key[new], pos[new]
    ids, at = np.unique(key, return_index=True)
    for lo in range(0, len(ids), 20_000):
        hi = min(lo + 20_000, len(ids))
        bounds = np.append(at, len(key))[lo : hi + 1]
        yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi]), ragged_binary(pos[bounds[0] : bounds[-1]], bounds - bounds[0])], ["key", "at"])


def _matches(entries: DataFrame, n: int) -> DataFrame:
    found = exchange(entries, n).mapInArrow(lambda b: _repeated(b, n), schema("k", "p"))
    return exchange(found, n).mapInArrow(_by_document, "key long, at binary")


def _positions(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The positions of each row."""
    return [np.frombuffer(x or b"", np.uint32).astype(np.int64) for x in batch.column(batch.schema.get_field_index("at")).to_pylist()]


def dedup_substrings(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word that lies in a `window`-word sequence which also starts anywhere else.

    Returns one row per input row: doc_id, n_words, n_removed, kept_sha256 (of the kept words
    joined by one space), starts and ends of the removed word ranges, and key, a hash of id and
    text by which rows are told apart.
    """
    work, n = Workspace(docs.sparkSession, "repeats"), bucket_count(docs, 8 << 20)
    period, residues, size = cover(window)
    chosen = np.zeros(period, bool)
    chosen[list(residues)] = True
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _BYTES):
            h, bounds = _batch_words(batch)
            words = np.diff(bounds)
            row = np.repeat(np.arange(len(words)), np.where(words >= window, words - size + 1, 0))
            at = ragged(bounds[:-1], np.where(words >= window, words - size + 1, 0))
            inner = at - bounds[row]
            keep = chosen[inner % period]
            at, row, inner = at[keep], row[keep], inner[keep]
            a = windows(h, at, size)
            yield from _entries(a, np.zeros(len(a), np.uint32), _longs(batch, "key")[row], inner, n, False)

    hits = work.save(_matches(keyed.select("text", "key").mapInArrow(anchors, schema(*ENTRY)), n))
    sent = docs.sparkSession.sparkContext.broadcast(bloom(hits, "key"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _BYTES):
            may = may_hold(sent.value, _longs(batch, "s1"), _longs(batch, "s2"))
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            split = [(t or "").encode().split() for t in texts]
            sha = [None if m else hashlib.sha256(b" ".join(w)).hexdigest() for m, w in zip(may, split)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in (batch.schema.get_field_index("key"), batch.schema.get_field_index("doc_id"))] + [pa.array([len(w) for w in split], pa.int64()), pa.array(sha, pa.string()), pa.array([t if m else None for m, t in zip(may, texts)], pa.string())],
                ["key", "doc_id", "n_words", "sha", "text"],
            )

    seen = work.save(keyed.select("*", *bloom_slots("key")).mapInArrow(scan, "key long, doc_id long, n_words long, sha string, text string"))
    clean = seen.where("sha is not null")
    suspect = seen.where("sha is null").select("key", "doc_id", "text")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _BYTES):
            h, bounds = _batch_words(batch)
            key, at, keys = [], [], _longs(batch, "key")
            for r, p in enumerate(_positions(batch)):
                if len(p):
                    mark = np.zeros(int(bounds[r + 1] - bounds[r]) + 1, np.int64)  # starts of windows that hold an anchor
                    np.add.at(mark, np.maximum(p - (window - size), 0), 1)
                    np.add.at(mark, p + 1, -1)
                    s = np.flatnonzero(np.cumsum(mark)[: max(0, len(mark) - window)] > 0)
                    at.append(s + bounds[r])
                    key.append(np.full(len(s), r))
            if at:
                first, row = np.concatenate(at), np.concatenate(key)
                second = (windows(h, first, window, 29) >> np.uint64(32)).astype(np.uint32)
                yield from _entries(windows(h, first, window), second, keys[row], first - bounds[row], n, True)

    # A document that repeats whole and often comes as one text per row; its windows go out once a batch.
    around = suspect.join(hits, "key").select("key", "text", "at")
    repeats = _matches(around.mapInArrow(extend, schema(*ENTRY)), n)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _BYTES):
            total, gone, sha, lo, hi = [], [], [], [], []
            for t, p in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), _positions(batch)):
                words = (t or "").encode().split()
                mark = np.zeros(len(words) + 1, np.int64)
                np.add.at(mark, p, 1)
                np.add.at(mark, p + window, -1)
                inside = np.cumsum(mark)[:-1] > 0
                edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
                lo.append(np.flatnonzero(edge == 1))
                hi.append(np.flatnonzero(edge == -1))
                total.append(len(words))
                gone.append(int(inside.sum()))
                sha.append(hashlib.sha256(b" ".join([w for w, x in zip(words, inside.tolist()) if not x])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("key")), batch.column(batch.schema.get_field_index("doc_id")), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(lo, pa.list_(pa.int32())), pa.array(hi, pa.list_(pa.int32()))],
                ["key", "doc_id", "n_words", "n_removed", "kept_sha256", "starts", "ends"],
            )

    dirty = suspect.join(repeats, "key", "left").select("key", "doc_id", "text", "at").mapInArrow(cut, RESULT)
    none = F.array().cast("array<int>")
    return clean.select("key", "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), none.alias("starts"), none.alias("ends")).unionByName(dirty)
