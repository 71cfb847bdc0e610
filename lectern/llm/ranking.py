"""Ranked lexical search by MaxScore over an index that is split by documents.

A shard holds the postings of every term of a few megabytes of neighbouring documents: document
numbers and term counts, and for each list its largest term count and its shortest document, from
which a bound on any score of the list follows. So building and searching move no row between
executors; only the counts of the queries' terms, and each task's best rows, are exchanged.

For each query a shard's lists are sorted by their bounds. The non-essential ones are those whose
bounds add up to less than the score to beat: a document that holds no other term cannot rank.
Documents of the essential lists are scored, and the other lists are probed, the largest bound
first, for those documents alone that can still reach the score to beat.

Terms are told apart by 64-bit hashes: among 1e10 different ones the chance that any takes part
in a query of ten thousand terms is 5e-6.

Defined results: a null text has no term and takes no part in any count; an item without terms, or
whose terms no document holds, has no rows; items with a null id are ignored; every other row of
the benchmark is a query of its own, also where its id repeats; repeated documents rank each;
equal scores go by ascending id, a null id last; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Workspace, binary_array, slices, text_column, utf8_parts
from .kernel import ALNUM, spans, word_hashes

INDEX = "doc_ids array<long>, sizes binary, terms binary, df binary, docs binary, tf binary, wide binary, most binary, least binary"
#: Text of one shard; text of the queries that one round broadcasts; rows that one task's result is spread over.
SHARD_BYTES, ROUND_BYTES, SALTS = 8 << 20, 1 << 20, 64


def _postings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document sizes, and sorted terms with their list lengths, documents, counts and bounds."""
    start, end, bounds = spans(data, offsets, ALNUM)
    n = np.diff(bounds)
    h = word_hashes(data, start, end, True)
    doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
    order = np.lexsort((doc, h)) if len(n) > 1 else np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(h)))
    h, doc = h[at], doc[at]
    lead = np.ones(len(h), bool)
    lead[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(lead)
    df = np.diff(np.append(first, len(h)))
    most = np.maximum.reduceat(tf, first) if len(first) else tf
    least = np.minimum.reduceat(n[doc], first) if len(first) else tf
    return n, h[first], df, doc, tf, most, least


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Postings of every term of whole texts, one row for each shard."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", shard_bytes):
            n, terms, df, doc, tf, most, least = _postings(*text_column(batch, "text"))
            big = tf >= 255
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            parts = [n.astype(np.int32), terms, df.astype(np.int32), doc.astype(np.int32), np.where(big, 255, tf).astype(np.uint8), tf[big].astype(np.int32), most.astype(np.int32), least.astype(np.int32)]
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([lists, *(binary_array([x.tobytes()]) for x in parts)], ["doc_ids", "sizes", "terms", "df", "docs", "tf", "wide", "most", "least"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(shards, INDEX)


class Queries:
    """Terms of a block of items, and for each item the numbers of its different terms."""

    def __init__(self, texts: list[str | None]):
        data, offsets = utf8_parts(pa.array(texts, pa.large_string()))
        start, end, bounds = spans(data, offsets, ALNUM)
        self.terms, number = np.unique(word_hashes(data, start, end, True), return_inverse=True)
        self.items = [np.unique(number[bounds[k] : bounds[k + 1]]) for k in range(len(texts))]
        self.weights = np.zeros(len(self.terms), np.int64)

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the queries' terms in a shard's, and whether each is there."""
        at = np.minimum(np.searchsorted(terms, self.terms), max(len(terms) - 1, 0))
        return at, (terms[at] == self.terms if len(terms) else np.zeros(len(self.terms), bool))


class Shard:
    """One row of the index, its lists scored on demand."""

    def __init__(self, row: dict, total: int, length: int):
        kinds = {"sizes": np.int32, "terms": np.uint64, "df": np.int32, "docs": np.int32, "most": np.int32, "least": np.int32}
        for name, kind in kinds.items():
            setattr(self, name, np.frombuffer(row[name], kind))
        self.tf = np.frombuffer(row["tf"], np.uint8).astype(np.int64)
        self.tf[self.tf == 255] = np.frombuffer(row["wide"], np.int32)
        self.bounds = np.concatenate(([0], np.cumsum(self.df, dtype=np.int64)))
        self.total, self.length, self.scored = total, length, {}
        self.m = self._norm(self.sizes)

    def _norm(self, n: np.ndarray) -> np.ndarray:
        return 10 + 90 * n.astype(np.int64) * self.total // self.length

    def ceilings(self, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """No score of a list is higher: it grows with the count and falls with the size."""
        tf = self.most[at].astype(np.int64)
        return weights * (1_000_000_000 * tf // (1000 * tf + 8 * self._norm(self.least[at])))

    def scores(self, at: int, weight: int) -> tuple[np.ndarray, np.ndarray]:
        if at not in self.scored:
            a, b = self.bounds[at], self.bounds[at + 1]
            doc, tf = self.docs[a:b], self.tf[a:b]
            self.scored[at] = doc, weight * (1_000_000_000 * tf // (1000 * tf + 8 * self.m[doc]))
        return self.scored[at]


def max_score(shard: Shard, at: np.ndarray, weights: np.ndarray, k: int, beat: int, tally: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the shard that may rank among k with scores of `beat` or more, with their scores."""
    ceiling = shard.ceilings(at, weights)
    order = np.argsort(ceiling, kind="stable")
    at, weights, reach = at[order], weights[order], np.cumsum(ceiling[order])
    essential = int(np.searchsorted(reach, beat, "left"))  # all before it add up to less than `beat`
    score = np.zeros(len(shard.sizes), np.int64)
    for j in range(essential, len(at)):
        doc, s = shard.scores(int(at[j]), int(weights[j]))
        score[doc] += s
    found = np.flatnonzero(score)
    if tally is not None:
        tally["scored"] = tally.get("scored", 0) + len(found)
    for j in range(essential - 1, -1, -1):
        part = score[found]
        if len(found) > k:
            beat = max(beat, int(np.partition(part, len(part) - k)[len(part) - k]))
        found = found[part + reach[j] >= beat]
        if not len(found):
            break
        if tally is not None:
            tally["probed"] = tally.get("probed", 0) + len(found)
        doc, s = shard.scores(int(at[j]), int(weights[j]))
        i = np.minimum(np.searchsorted(doc, found), len(doc) - 1)
        score[found] += np.where(doc[i] == found, s[i], 0)
    s = score[found]
    return found[s >= beat], s[s >= beat]


class Best:
    """The k best rows of one query so far: highest scores first, ties by id, null ids last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def beat(self) -> int:
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, ids: list[int | None], scores: np.ndarray) -> None:
        rows = self.rows + list(zip(scores.tolist(), ids))
        self.rows = sorted(rows, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[: self.k]


def _statistics(index: DataFrame, queries: Queries) -> tuple[int, int, np.ndarray]:
    """Documents with terms, their terms with repeats, and the documents of each term of the queries."""
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, total, length = sent.value, 0, 0
        df = np.zeros(len(q.terms), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
                total, length = total + int((sizes > 0).sum()), length + int(sizes.sum())
                at, there = q.find(np.frombuffer(row["terms"], np.uint64))
                df[there] += np.frombuffer(row["df"], np.int32)[at[there]]
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, [-1, -2])), pa.array(np.append(df[used], [total, length]))], ["term", "n"])

    found = index.select("sizes", "terms", "df").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    n = dict(zip(found.column("term").to_pylist(), found.column("n").to_pylist()))
    return n.get(-1, 0), n.get(-2, 0), np.array([n.get(k, 0) for k in range(len(queries.terms))], np.int64)


def search_index(index: DataFrame, ids: list, texts: list[str | None], kind, k: int, first: int = 0) -> DataFrame:
    """item_id (of type `kind`), query (its number, from `first`), doc_id and score: each task's best rows."""
    queries = Queries(texts)
    total, length, df = _statistics(index, queries)
    queries.weights = np.floor(1000 * np.log((2 * total + 2) / (2 * df + 1))).astype(np.int64)
    sent = index.sparkSession.sparkContext.broadcast((queries, ids, total, length))
    schema = StructType([StructField("item_id", kind), *(StructField(c, LongType()) for c in ("query", "doc_id", "score"))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, names, docs, words = sent.value
        best = [Best(k) for _ in q.items]
        for batch in batches:
            for j in range(batch.num_rows):
                row = {c: batch.column(i)[j].as_py() for i, c in enumerate(batch.schema.names) if c != "doc_ids"}
                doc_ids = batch.column(batch.schema.get_field_index("doc_ids"))[j].values
                shard = Shard(row, docs, max(words, 1))
                at, there = q.find(shard.terms)
                for item, top in zip(q.items, best):
                    t = item[there[item]]
                    t = t[q.weights[t] > 0]
                    if len(t):
                        found, scores = max_score(shard, at[t], q.weights[t], k, top.beat)
                        if len(found):
                            top.add(doc_ids.take(pa.array(found)).to_pylist(), scores)
        rows = [(names[i], first + i, d, s) for i, top in enumerate(best) for s, d in top.rows]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], kinds[0]), *(pa.array(c, pa.int64()) for c in columns[1:])], ["item_id", "query", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(kind)]
    return index.mapInArrow(search, schema)


def _rounds(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[tuple[list, list]]:
    """Items in blocks of bounded size, streamed to the driver one partition at a time."""
    ids, texts, size = [], [], 0
    for item, text in benchmark.select(item_col, text_col).where(F.col(item_col).isNotNull()).toLocalIterator():
        ids.append(item)
        texts.append(text)
        size += len(text or "") + 64
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def rank_documents(docs: DataFrame, benchmark: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", round_bytes: int = ROUND_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The k best documents of each item: item_id, rank (from 1), doc_id, score.

    A document's score for an item is the sum of w * (1e9 * tf div (1000 * tf + 8 * m)) over the
    item's different terms; m = 10 + 90 * n * N div L, w = floor(1000 * ln((2N + 2) / (2df + 1))).
    """
    work = Workspace(docs.sparkSession, "ranking")
    index = work.save(build_index(docs, id_col, text_col, shard_bytes))
    kind, parts, first = benchmark.schema[item_col].dataType, [], 0
    for ids, texts in _rounds(benchmark, item_col, item_text, round_bytes):
        # Written one by one: the driver and the broadcasts hold one round at a time.
        parts.append(work.save(search_index(index, ids, texts, kind, k, first)))
        first += len(ids)
    if not parts:
        return docs.sparkSession.createDataFrame([], StructType([StructField("item_id", kind)])).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    order = F.col("score").desc(), F.col("doc_id").asc_nulls_last()
    # Two levels, so that one query's rows of all tasks needn't meet at once.
    salted = reduce(DataFrame.unionByName, parts).withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))).where(F.col("rank") <= k)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")
