"""Linked levels, answer caches by version, and averages of keys that hold most rows."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions.text import bounded_split, raw_pieces
from lectern.operators import caches, chunking, profile


def test_a_hot_key_is_split(spark):
    rows = spark.range(300_000).select(F.when(F.col("id") % 50 == 0, "rare").otherwise("hot").alias("k"), "id", (F.col("id") % 97).cast("double").alias("x")).repartition(6)
    got = {r.k: (r.average, r.n) for r in profile.running_average(rows, "k", F.col("x"), "id").collect()}
    for key, ids in (("rare", range(0, 300_000, 50)), ("hot", (i for i in range(300_000) if i % 50))):
        v, n = 0.0, 0
        for i in ids:
            v += (i % 97 - v) / (min(n, 20) + 1)
            n += 1
        assert got[key] == (pytest.approx(v), n)


def test_linked_levels(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice(["ab", "c", " ", "\n", "  ", "longerword", "é"]) for _ in range(n))
    rows = [(k, text(rng.randint(0, 200))) for k in range(30)] + [(100, ""), (101, None), (102, " " * 300), (103, "x" * 300), (104, " " * 70 + "end"), (105, "ab " * 9 + " " * 90 + "cd")]
    sizes = (7, 20, 64)
    df = spark.createDataFrame(rows, "k int, t string").repartition(3)
    got = chunking.linked_levels(df, "t", sizes, "k").collect()
    whole = dict(rows)
    by = {(r.k, r.level, r.chunk_index): r for r in got}
    assert len(by) == len(got)
    plain = {(r.k, r.level, r.chunk_index): r.piece for r in chunking.levels(df, "t", sizes, "k").collect()}
    assert {x: r.piece for x, r in by.items()} == plain
    for r in got:
        assert whole[r.k][r.start :].startswith(r.piece)
        if r.level == len(sizes) - 1:
            assert r.parent_index is None
        elif r.piece:
            up = by[r.k, r.level + 1, r.parent_index]
            later = by.get((r.k, r.level + 1, r.parent_index + 1))
            assert up.start <= r.start and (later is None or r.start < later.start)
    raw = df.select("k", "t", raw_pieces(F.col("t"), 7).alias("p"), bounded_split(F.col("t"), 7).alias("b")).where("t is not null").collect()
    assert all("".join(r.p) == r.t for r in raw)


def test_answers_of_old_versions_are_stale(spark):
    rng = random.Random(10)
    versions = [("hot", 5 * k, k) for k in range(1, 30)] + [("cold", 70, 1)]
    asked = [(rng.choice(["hot", "hot", "cold", "none"]), at, rng.choice(["q1", "q2", "q3", None]), at) for at in range(150)]
    got = {r.n: (r.version, r.hit, r.first_at) for r in caches.answers(spark.createDataFrame(asked, "corpus string, at long, question string, n long").repartition(4), spark.createDataFrame(versions, "corpus string, at long, version long")).collect()}
    seen, want = {}, {}
    for corpus, at, question, n in asked:
        now = max((v for c, t, v in versions if c == corpus and t <= at), default=None)
        first = seen.get((corpus, now, question)) if now is not None else None
        want[n] = (now, first is not None, first)
        seen.setdefault((corpus, now, question), at)
    assert got == want and any(h for _, h, _ in want.values())


def test_versions_and_questions_at_one_time(spark):
    asked = spark.createDataFrame([("c", 1, "q", 0), ("c", 1, "q", 1), ("c", 2, "q", 2)], "corpus string, at long, question string, n int")
    log = spark.createDataFrame([("c", 1, 1), ("c", 2, 2)], "corpus string, at long, version long")
    rows = caches.answers(asked, log).collect()
    assert sorted((r["at"], r.version, r.hit) for r in rows) == [(1, 1, False), (1, 1, True), (2, 2, False)]
    assert caches.answers(asked, log.limit(0)).where("hit or version is not null").count() == 0
