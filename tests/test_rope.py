"""Corpora as ropes: offsets, parallel splitting and packing agree with walks from the start."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions.text import bounded_split
from lectern.operators import ordered, qa, rope


def test_segmented_sum(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), k, rng.randint(0, 9)) for k in range(500)] + [(None, k, 2) for k in range(5)]
    got = ordered.segmented_sum(spark.createDataFrame(rows, "g string, k int, v long").repartition(7), F.col("v"), "g", "k").collect()
    want, run = {}, {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        run[g] = run.get(g, 0) + v
        want[g, k] = run[g]
    assert {(r.g, r.k): r.running for r in got} == want and len(got) == len(rows)


def walk(marks, reach, most, start, stop):
    out, p = [start], start
    while p < stop:
        c = [m for m in marks if p < m <= p + reach]
        p = max(c) if c else p + most
        out.append(p)
    return out


def test_maps_and_walks():
    rng = random.Random(2)
    for _ in range(60):
        block, most = rng.randint(20, 60), rng.randint(3, 20)
        marks = np.array(sorted(rng.sample(range(block + most), rng.randint(0, 25))), np.int64)
        cuts = rope.Cuts(marks, most - 1, most, None, block)
        exits = cuts.exits(np.arange(most))
        assert exits.tolist() == [walk(marks.tolist(), most - 1, most, p, block)[-1] - block for p in range(most)]
        packed = rope._pack(exits)
        assert rope._apply(packed, np.arange(most)).tolist() == exits.tolist()
        twice = rope._compose(packed, packed)
        inside = exits < most
        assert rope._apply(twice, np.arange(most))[inside].tolist() == exits[exits[inside]].tolist()
        assert cuts.walk(3 % most).tolist() == walk(marks.tolist(), most - 1, most, 3 % most, block)


def joined(rows, separator):
    by = {}
    for g, k, t in sorted(rows, key=lambda r: r[1]):
        if t is not None:
            by.setdefault(g, []).append(t)
    return {g: separator.join(ts) for g, ts in by.items()}


@pytest.mark.parametrize("separator,most,block", [("\n\n", 40, 64), ("", 40, 40), ("\n\n", 64, 1024), ("---", 7, 16)])
def test_split_corpus(spark, separator, most, block):
    rng = random.Random(most)
    word = lambda: "".join(rng.choice("abcdé日🙂") for _ in range(rng.choice((1, 3, 9, 60 if rng.random() < 0.1 else 4))))
    white = lambda: rng.choice([" ", "\n", "\t ", "　", "\x85", "\xa0", "   "])
    text = lambda n: "".join(word() + white() for _ in range(n))
    rows = [("hot", k, text(rng.randint(0, 30))) for k in range(60)] + [("none", k, "x" * 37) for k in range(60)]
    rows += [("blank", 0, " \n" * 200), ("tiny", 0, "ab c"), ("empty", 0, ""), ("null", 0, None), (None, 1, text(20)), (None, 2, text(3)), ("edge", 0, "y" * (block + most)), ("edge2", 0, "y " * block), ("fits", 0, "z" * most)]
    table = spark.createDataFrame(rows, "g string, k int, text string").repartition(5)
    got = {}
    for r in rope.split_corpus(table, "g", "k", most=most, separator=separator, block=block).collect():
        got.setdefault(r.g, {})[r.chunk_index] = (r.start, r.piece)
    whole = joined(rows, separator)
    whole_table = spark.createDataFrame(list(whole.items()), "g string, t string")
    want = {r.g: r.p for r in whole_table.select("g", bounded_split(F.col("t"), most).alias("p")).collect()}
    want = {g: p for g, p in want.items() if p and not (whole[g] == "" and separator == "")}
    assert {g: [p for _, (_, p) in sorted(x.items())] for g, x in got.items()} == want
    assert all(sorted(x) == list(range(len(x))) for x in got.values())
    for g, x in got.items():
        assert all(whole[g][s:].lstrip().startswith(p) for s, p in x.values() if p)


def test_long_runs_without_white_space_are_composed(spark):
    """No block's map is constant here, so entries come from composed maps alone."""
    table = spark.createDataFrame([("g", 0, "x" * 5000), ("g", 1, "y z" * 100)], "g string, k int, text string")
    got = rope.split_corpus(table, "g", "k", most=37, block=40).orderBy("chunk_index").collect()
    want = table.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "").alias("t")).select(bounded_split(F.col("t"), 37).alias("p")).first().p
    assert [r.piece for r in got] == want


def next_fit(sizes, most):
    out, used = [], 0
    for s in sizes:
        if out and used + s <= most:
            used += s
            out[-1].append(s)
        else:
            out.append([s])
            used = s
    return [len(p) for p in out]


def test_packs(spark):
    rng = random.Random(4)
    groups = {g: [rng.randint(1, 30) for _ in range(n)] for g, n in (("hot", 900), ("one", 1), ("two", 2), (None, 50))}
    rows = [(g, k, s) for g, sizes in groups.items() for k, s in enumerate(sizes)]
    got = {}
    for r in rope.pack_facts(spark.createDataFrame(rows, "g string, k int, s int").repartition(6), "g", "k", F.col("s"), 30, block=30).orderBy("k").collect():
        got.setdefault(r.g, []).append(r._pack)
    for g, sizes in groups.items():
        ends = got[g]
        runs = [ends.count(e) for e in sorted(set(ends))]
        assert runs == next_fit(sizes, 30) and ends == sorted(ends)


def plain_reduce(facts, budget, word):
    """One group's rounds in plain Python: [(part, text, first, last, rounds, over)]."""
    sentence = lambda t: next((s.strip() for line in t.split("\n---\n") for s in line.split(".") if f" {word} " in s), "NONE")
    now, k = [(t, i, i) for i, t in enumerate(facts)], 0
    while True:
        packs = []
        for t, a, b in now:
            if packs and len(packs[-1][0]) + 5 + len(t) <= budget:
                packs[-1] = (packs[-1][0] + "\n---\n" + t, packs[-1][1], b)
            else:
                packs.append((t, a, b))
        if len(packs) == 1:
            return [(0, *packs[0], k, False)]
        said = [(sentence(t), a, b) for t, a, b in packs]
        said = [x for x in said if x[0] and x[0].lower() != "none"]
        if not said:
            return [(0, "", None, None, k + 1, False)]
        if sum(len(x[0]) + 5 for x in said) >= sum(len(x[0]) + 5 for x in packs):
            return [(j, *x, k, True) for j, x in enumerate(packs)]
        now, k = said, k + 1


def test_recursive_reduce(spark):
    rng = random.Random(6)
    fact = lambda that: " ".join("".join(rng.choice("abc") for _ in range(4)) for _ in range(rng.randint(2, 5))) + (" that " + "x" * rng.randint(1, 9) if that else "")
    groups = {"deep": [fact(True) for _ in range(400)], "small": [fact(True)], "none": [fact(False) for _ in range(60)], "stuck": ["a that " + "y" * 60 for _ in range(9)], "mixed": [fact(k % 9 == 0) for k in range(200)], None: [fact(True) for _ in range(30)]}
    rows = [(g, k, t) for g, ts in groups.items() for k, t in enumerate(ts)]
    table = spark.createDataFrame(rows, "g string, k long, excerpt string").repartition(4)
    got = {}
    for r in qa.recursive_reduce(table, "g", "k", 80, lambda p: qa.extract_sentence(p, "that", qa.FACT_ENDS), block=90).collect():
        got.setdefault(r.g, []).append((r.part, r.facts, r.first, r.last, r.rounds, r.over))
    want = {g: plain_reduce(ts, 80, "that") for g, ts in groups.items()}
    assert {g: sorted(x) for g, x in got.items()} == want
    assert want["deep"][0][4] >= 2 and want["stuck"][0][5] and want["none"][0][1] == ""


def test_levels_of_far_turns(spark):
    node = lambda k: ("c", k)
    edges = [(node(0), None, 0), (node(2_000_000), node(0), 2_000_000), (node(3_000_000_000), node(2_000_000), 2_998_000_000), (node(7), None, 7), (node(9), node(7), 2), (node(9), node(0), 1)]
    table = spark.createDataFrame(edges, "node struct<c:string,k:long>, needs struct<c:string,k:long>, dist long")
    assert {r.node.k: r.level for r in qa.dependency_levels(spark, table).collect()} == {0: 0, 7: 7, 9: 9, 2_000_000: 2_000_000, 3_000_000_000: 3_000_000_000}


def test_more_rounds_than_the_sql_unrolls(spark):
    """Packs of two facts halve a group each round; no round is the last by number."""
    facts = [f"a that {k:04d}" + "y" * 24 for k in range(300)]
    table = spark.createDataFrame([("g", k, t) for k, t in enumerate(facts)], "g string, k long, excerpt string")
    got = [(r.part, r.facts, r.first, r.last, r.rounds, r.over) for r in qa.recursive_reduce(table, "g", "k", 80, lambda p: qa.extract_sentence(p, "that", qa.FACT_ENDS)).collect()]
    assert got == plain_reduce(facts, 80, "that") and got[0][4] > 7
