"""Retrieval in blocks agrees with scoring every pair."""

import random

import numpy as np
import pytest

from lectern.operators import retrieval


def everything(spark, chunks, queries, k):
    table = spark.createDataFrame(chunks, "chunk_id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, query array<float>").repartition(2)
    return table, asked, {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in retrieval.top_k_batched(table, asked, k).collect()}


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(2)
    v = lambda n=4: [round(rng.gauss(0, 1), 2) for _ in range(n)]
    hot = v()
    chunks = [(k, hot if k % 3 == 0 else v()) for k in range(150)] + [(k, v(3)) for k in range(200, 215)]
    chunks += [(300, None), (301, []), (302, [0.0] * 4), (303, [1e30] * 4), (304, [float("inf"), 1.0, 1.0, 1.0]), (305, [2 * x for x in hot]), (306, [-x for x in hot]), (7, v())]
    queries = [(k, v()) for k in range(30)] + [(100, hot), (101, v(3)), (102, v(5)), (103, []), (104, None), (105, [0.0] * 4), (106, [1e25, 0.0, 0.0, 0.0])]
    return chunks, queries


@pytest.mark.parametrize("query_block,chunk_block,k", [(4096, 4096, 5), (8, 16, 5), (1, 7, 3), (8, 16, 400)])
def test_blocks(spark, odd, query_block, chunk_block, k):
    chunks, asked, want = everything(spark, *odd, k)
    got = retrieval.top_k_blocks(chunks, asked, k, query_block=query_block, chunk_block=chunk_block)
    assert {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in got.collect()} == want


def test_many_queries(spark):
    rng = np.random.default_rng(3)
    n, m, k = 20_000, 600, 3
    q, c = rng.normal(size=(n, 8)).round(2), rng.normal(size=(m, 8)).round(2)
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "chunk_id long, embedding array<double>").repartition(4)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, query array<double>")
    got = retrieval.top_k_batched(chunks, asked, k)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    rows = got.toPandas()
    s = (q / np.linalg.norm(q, axis=1)[:, None]) @ (c / np.linalg.norm(c, axis=1)[:, None]).T
    best = np.sort(s, axis=1)[:, ::-1][:, :k]
    assert len(rows) == n * k
    have = rows.sort_values(["query_id", "rank"]).score.to_numpy().reshape(n, k)
    assert np.abs(have - best).max() < 1e-9


def test_blocks_are_skipped_where_angles_rule_them_out():
    rng = np.random.default_rng(4)
    centres = np.eye(6)
    block = lambda c: (centres[c] + rng.normal(scale=0.01, size=(50, 6))).astype(float)
    as_block = lambda m: retrieval.Block(np.full(len(m), 6, np.int32), m.ravel())
    queries = block(0)
    near = retrieval.Nearest(as_block(queries), 4)
    parts = [block(c) for c in (0, 1, 2, 3)]
    for c, m in enumerate(parts):
        near.add(as_block(m), list(range(100 * c, 100 * c + 50)))
    assert near.skipped == 3 * 50
    assert all(key < 50 for best in near.best for _, key in best)


def test_no_rows(spark):
    none = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, query array<float>")
    assert retrieval.top_k_blocks(none, asked, 3).count() == 0
    some = spark.createDataFrame([(1, [1.0])], "chunk_id long, embedding array<float>")
    assert retrieval.top_k_blocks(some, asked.limit(0), 3).count() == 0
