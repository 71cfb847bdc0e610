"""Joins, substring removal and decontamination against plain Python."""

import random
from fractions import Fraction

import numpy as np
import pytest
from .brute import contamination, links, substrings

from lectern.llm.components import connected_components
from lectern.llm.common import Workspace
from lectern.llm.decontaminate import decontaminate, proximity
from lectern.llm.jaccard import link_documents
from lectern.llm.substring import PERFECT, cover, dedup_substrings

key = lambda r: tuple((x is None, x) for x in r)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


def test_links(docs, corpus):
    assert rows(link_documents(docs)) == sorted(links(corpus), key=key)


def test_links_in_blocks(docs, corpus, monkeypatch):
    monkeypatch.setattr("lectern.llm.jaccard.BLOCK", 4)  # a cluster of many block pairs
    assert rows(link_documents(docs)) == sorted(links(corpus), key=key)


def test_links_random(spark):
    rng = random.Random(3)
    for trial in range(2):
        words = [str(k) for k in range(12 + 30 * trial)]
        made = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))) for k in range(60)]
        made += [(100 + k, " ".join([*made[k][1].split(), *rng.choices(words, k=rng.randint(0, 2))])) for k in range(60)]
        df = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
        assert rows(link_documents(df)) == sorted(links(made), key=key)


def test_links_empty(empty):
    assert link_documents(empty).count() == 0


def test_threshold_is_exact(spark):
    # Seven shingles against those and one more: 7/8; sets of 3 in 4: exactly three quarters.
    made = [(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, "a b c d e f g h i")]
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert {r.doc_id: (r.component_id, r.n_links) for r in link_documents(df).collect()} == {1: (1, 1), 2: (1, 2), 3: (1, 1)}
    assert {r.component_id for r in link_documents(df, threshold=Fraction(9, 10)).collect()} == {1, 2, 3}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + k, 1001 + k) for k in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in connected_components(df, Workspace(spark, "t")).collect()}
    assert got == {x: find(x) for x in root}


def test_covers():
    for v, d in PERFECT.items():
        for a in range(v):
            assert any((a + s) % v in d and s % v in d for s in range(v)), (v, a)
    for window in (1, 2, 5, 12, 35, 100):
        v, d, size = cover(window)
        assert v + size - 1 == window and all(0 <= x < v for x in d)


def test_substrings(docs, corpus):
    got = dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert rows(got) == sorted(substrings(corpus), key=key)


@pytest.mark.parametrize("window", [1, 4, 9])
def test_short_windows(docs, corpus, window):
    got = dedup_substrings(docs, window).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert rows(got) == sorted(substrings(corpus, window), key=key)


def test_removed_ranges(docs):
    for r in dedup_substrings(docs).where("n_removed > 0").collect():
        assert sum(b - a for a, b in zip(r.starts, r.ends)) == r.n_removed


def test_substrings_empty(empty):
    assert dedup_substrings(empty).count() == 0


@pytest.fixture(scope="module")
def items(corpus):
    texts = dict(r for r in corpus if r[0] is not None)
    return [(1, texts[300][:200]), (2, texts[7]), (3, "one two"), (4, None), (5, " ,;"), (6, texts[7]), (None, texts[9]), (70, "日本語 é"), (8, texts[507][500:900].upper()), (9, "x")]


def test_contamination(spark, docs, corpus, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(got) == sorted(contamination(corpus, items), key=key)


def test_contamination_in_rounds(spark, docs, corpus, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(docs, bench, round_bytes=300).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(got) == sorted(contamination(corpus, items), key=key)


def test_contamination_empty(spark, docs, empty, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none).where("contaminated or n_items > 0").count() == 0
    assert decontaminate(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_ranges_and_proximity(spark):
    df = spark.createDataFrame([(1, "a x b y c"), (2, "a q q q q b c"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "x b")], "item_id long, text string")
    r = decontaminate(df, bench).where("doc_id = 1").first()
    assert (r.starts, r.ends, r["items"]) == ([1], [3], ["1"])
    assert {x.doc_id for x in proximity(df, "c A b", 5).collect()} == {1}
    assert {x.doc_id for x in proximity(df, "c A b", 7).collect()} == {1, 2}
    assert np.array(proximity(df, "!", 5).collect()).size == 0


def test_few_links_need_no_rounds(spark, monkeypatch):
    """Each round of joins is a dozen stages, however few its links; links of one task are joined there."""
    from lectern.llm import components

    edges = [(k, k + 1) for k in range(300)] + [(900 - k, 900) for k in range(1, 100)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    work = Workspace(spark, "t")
    want = {k: 0 for k in range(301)} | {k: 801 for k in range(801, 901)}
    assert {r.node: r.root for r in connected_components(df, work, most=0).collect()} == want
    monkeypatch.setattr(components, "TASK_BYTES", 512)  # many tasks, several turns in each
    monkeypatch.setattr(components, "HELD", 16)
    assert {r.node: r.root for r in connected_components(df, work).collect()} == want
    assert connected_components(df.limit(0), work).count() == 0
