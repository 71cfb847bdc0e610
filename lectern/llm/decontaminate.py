"""Benchmark decontamination on a distributed positional inverted index.

The index is split by documents: a shard holds, for every benchmark term, the ascending word
positions in a few megabytes of neighbouring documents, so building and searching it moves no
row between executors. A phrase is found by intersecting the offset-adjusted position lists of
its terms, the rarest of the shard first; most phrases end at a term that the shard lacks.

Defined results: a null or empty text has no words and no hits; a null or wordless item has no
window; items with a null id are ignored; repeated rows are judged one by one; other columns of
either table are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, binary_array, integers, slices, text_column, utf8_parts
from .kernel import ALNUM, positions, spans, word_hashes

INDEX = "shard long, doc_ids array<long>, n_words array<int>, terms binary, counts binary, deltas binary, wide binary"
MATCHES = "shard long, row int, doc_id long, n_words int, starts array<int>, ends array<int>, items array<string>"
SHARD_BYTES = 3 << 20
#: Benchmark text of one round of the search; larger benchmarks take several rounds over the index.
ROUND_BYTES = 2 << 20
#: Different benchmark words that a broadcast may hold (8 bytes each).
MOST_TERMS = 8_000_000


class Phrases:
    """Windows of benchmark items as rows of term numbers, padded with -1."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        data, offs = utf8_parts(pa.array([t for _, t in items], pa.large_string()))
        start, end, bounds = spans(data, offs, ALNUM)
        self.window = window
        self.terms, tid = np.unique(word_hashes(data, start, end, True), return_inverse=True)
        rows, owner = [], []
        for k in range(len(items)):
            ids = tid[bounds[k] : bounds[k + 1]]
            if len(ids):
                short = np.full((1, window), -1, np.int64)
                short[0, : min(len(ids), window)] = ids[:window]
                rows.append(np.lib.stride_tricks.sliding_window_view(ids, window) if len(ids) >= window else short)
                owner += [k] * len(rows[-1])
        table = np.concatenate(rows).astype(np.int32) if rows else np.empty((0, window), np.int32)
        self.rows, back = np.unique(table, axis=0, return_inverse=True) if len(table) else (table, np.empty(0, int))
        self.owners: list[list[str]] = [[] for _ in range(len(self.rows))]
        for w, k in zip(back.ravel().tolist(), owner):
            if items[k][0] not in self.owners[w]:
                self.owners[w].append(items[k][0])
        self.sizes = (self.rows >= 0).sum(axis=1)


def _rounds(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, str]]]:
    """Items in groups of bounded size, streamed to the driver one partition at a time."""
    group, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).dropna().toLocalIterator()
    for item, text in rows:
        group.append((item, text))
        size += len(text)
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def _encode(pos: np.ndarray, tid: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    order = np.argsort(tid, kind="stable")
    t, p = tid[order], pos[order]
    terms, first, counts = np.unique(t, return_index=True, return_counts=True)
    gap = np.diff(p, prepend=0)
    gap[first] = p[first]
    big = gap >= 255
    return (
        terms.astype(np.int32).tobytes(),
        counts.astype(np.int32).tobytes(),
        np.where(big, 255, gap).astype(np.uint8).tobytes(),
        gap[big].astype(np.uint32).tobytes(),
    )


def _decode(terms: bytes, counts: bytes, deltas: bytes, wide: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t, n = np.frombuffer(terms, np.int32), np.frombuffer(counts, np.int32).astype(np.int64)
    gap = np.frombuffer(deltas, np.uint8).astype(np.int64)
    gap[gap == 255] = np.frombuffer(wide, np.uint32)
    run = np.cumsum(gap)
    bounds = np.concatenate(([0], np.cumsum(n)))
    base = np.where(bounds[:-1] > 0, run[np.maximum(bounds[:-1] - 1, 0)], 0) if len(n) else np.empty(0, np.int64)
    return t, bounds, run - np.repeat(base, n)


def build_index(docs: DataFrame, terms: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings of the given sorted term hashes for whole texts, one row per shard."""
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, part, k = known.value, TaskContext.get().partitionId(), 0
        # A direct table on the upper bits answers most words without a search.
        likely = np.zeros(1 << 20, bool)
        likely[(vocabulary >> np.uint64(44)).astype(np.int64)] = True
        for batch in slices(batches, "text", SHARD_BYTES):
            start, end, bounds = spans(*text_column(batch, "text"), ALNUM)
            h = word_hashes(text_column(batch, "text")[0], start, end, True)
            pos = np.flatnonzero(likely[(h >> np.uint64(44)).astype(np.int64)])
            at = np.searchsorted(vocabulary, h[pos])
            hit = vocabulary[np.minimum(at, len(vocabulary) - 1)] == h[pos] if len(vocabulary) else np.zeros(0, bool)
            row = _encode(pos[hit], at[hit])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | k]),
                    pa.array([integers(batch, "doc_id")], pa.list_(pa.int64())),
                    pa.array([np.diff(bounds).astype(np.int32)], pa.list_(pa.int32())),
                    *(binary_array([x]) for x in row),
                ],
                ["shard", "doc_ids", "n_words", "terms", "counts", "deltas", "wide"],
            )
            k += 1

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(shards, INDEX)


def _phrase(ids: np.ndarray, at: np.ndarray, bounds: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Starts of a phrase: lists minus the term's offset, intersected from the rarest on."""
    size = bounds[at[ids] + 1] - bounds[at[ids]]
    found = None
    for k in np.argsort(size, kind="stable"):
        a = at[ids[k]]
        shifted = pos[bounds[a] : bounds[a + 1]] - k
        if found is None:
            found = shifted
        else:
            i = np.minimum(np.searchsorted(shifted, found), len(shifted) - 1)
            found = found[shifted[i] == found]
        if not len(found):
            break
    return found


def search_index(index: DataFrame, phrases: Phrases, terms: np.ndarray) -> DataFrame:
    """Exact phrase matches of every row of the index: merged word ranges and item ids."""
    sent = index.sparkSession.sparkContext.broadcast((phrases, np.searchsorted(terms, phrases.terms), len(terms)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ph, where, n_terms = sent.value
        rows = np.where(ph.rows >= 0, where[ph.rows] if len(where) else ph.rows, -1).astype(np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                t, bounds, pos = _decode(r["terms"], r["counts"], r["deltas"], r["wide"])
                at = np.full(n_terms + 1, -1, np.int64)  # the last slot stands for padding
                at[t] = np.arange(len(t))
                at[n_terms] = 0
                n = np.asarray(r["n_words"], np.int64)
                first = np.concatenate(([0], np.cumsum(n)))
                alive = np.flatnonzero((at[np.where(rows >= 0, rows, n_terms)] >= 0).all(axis=1))
                lo, hi, who = [], [], []
                for w in alive.tolist():
                    size = int(ph.sizes[w])
                    s = _phrase(rows[w, :size], at, bounds, pos)
                    if len(s):
                        d = np.searchsorted(first, s, "right") - 1
                        s = s[s + size <= first[d + 1]]
                        lo.append(s)
                        hi.append(s + size)
                        who.append(np.full(len(s), w))
                starts = [[] for _ in n]
                ends, items = [[] for _ in n], [set() for _ in n]
                if lo and sum(map(len, lo)):
                    lo, hi, who = np.concatenate(lo), np.concatenate(hi), np.concatenate(who)
                    d = np.searchsorted(first, lo, "right") - 1
                    for a, b in np.unique(np.stack([d, who], 1), axis=0).tolist():
                        items[a].update(ph.owners[b])
                    cover = np.zeros(int(first[-1]) + 1, np.int64)
                    np.add.at(cover, lo, 1)
                    np.add.at(cover, hi, -1)
                    inside = np.cumsum(cover)[:-1] > 0
                    edge = np.zeros(len(inside) + 1, bool)  # runs end where a document ends
                    edge[first] = True
                    up = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
                    down = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
                    for x, a, b in zip((np.searchsorted(first, up, "right") - 1).tolist(), up.tolist(), down.tolist()):
                        starts[x].append(a - int(first[x]))
                        ends[x].append(b - int(first[x]))
                k = len(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["shard"]] * k, pa.int64()),
                        pa.array(np.arange(k, dtype=np.int32)),
                        pa.array(r["doc_ids"], pa.int64()),
                        pa.array(n.astype(np.int32)),
                        pa.array(starts, pa.list_(pa.int32())),
                        pa.array(ends, pa.list_(pa.int32())),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    ],
                    ["shard", "row", "doc_id", "n_words", "starts", "ends", "items"],
                )

    return index.mapInArrow(search, MATCHES)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", round_bytes: int = ROUND_BYTES) -> DataFrame:
    """Per document the words inside any occurrence of a benchmark window, and the items found.

    Words are runs of ASCII letters (folded), digits and non-ASCII characters. A window is
    `window` consecutive words of an item, or all of a shorter one. Returns doc_id, n_words,
    n_hit, n_items, items_sha256, contaminated, items, starts, ends (merged word ranges).
    """
    work = Workspace(docs.sparkSession, "postings")
    groups = lambda: _rounds(benchmark, item_col, item_text, round_bytes)
    terms, rounds = np.empty(0, np.uint64), 0
    for group in groups():
        terms, rounds = np.union1d(terms, Phrases(group, window).terms), rounds + 1
        if len(terms) > MOST_TERMS:
            raise ValueError(f"more than {MOST_TERMS} different benchmark words; split the benchmark by items, and unite the ranges that the parts return")
    index = work.save(build_index(docs, terms, id_col, text_col))
    if rounds < 2:
        found = search_index(index, Phrases(next(groups(), []), window), terms)
    else:
        # Written one by one: the driver and the broadcasts hold one round at a time.
        parts = [work.save(search_index(index, Phrases(g, window), terms)) for g in groups()]
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")]
        found = reduce(DataFrame.unionByName, parts).groupBy("shard", "row", "doc_id", "n_words").agg(*lists)
    ranges = F.array_sort(F.arrays_zip("starts", "ends"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("last"))
    hit = F.when(F.size("starts") == 0, F.lit(0).cast("long")).otherwise(
        F.aggregate(
            ranges,
            zero,
            lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["ends"] - F.greatest(x["starts"], a["last"]))).alias("n"), F.greatest(a["last"], x["ends"]).alias("last")),
            lambda a: a["n"],
        )
    )
    items = F.array_sort(F.array_distinct("items"))
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"), items.alias("items"), "starts", "ends").select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "items",
        "starts",
        "ends",
    )


def proximity(docs: DataFrame, phrase: str, within: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in which all distinct words of `phrase` occur inside some `within` consecutive words.

    Returns doc_id and position, the latest start of such a span for each occurrence of the
    rarest word, from the same index. A phrase without words matches nothing.
    """
    ph = Phrases([("q", phrase)], max(1, len(phrase)))
    need = len(ph.terms)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                t, bounds, pos = _decode(r["terms"], r["counts"], r["deltas"], r["wide"])
                ids, at = [], []
                if need and len(t) == need:
                    first = np.concatenate(([0], np.cumsum(r["n_words"])))
                    lists = sorted((pos[bounds[k] : bounds[k + 1]] for k in range(need)), key=len)
                    for p in lists[0].tolist():  # the rarest term leads
                        d = int(np.searchsorted(first, p, "right")) - 1
                        for s in range(p, max(int(first[d]), p - within + 1) - 1, -1):  # the latest start
                            e = min(s + within, int(first[d + 1]))
                            if all(np.searchsorted(x, s) < np.searchsorted(x, e) for x in lists):
                                ids.append(r["doc_ids"][d])
                                at.append(s - int(first[d]))
                                break
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64())], ["doc_id", "position"])

    return build_index(docs, ph.terms, id_col, text_col).mapInArrow(near, "doc_id long, position long").distinct()
