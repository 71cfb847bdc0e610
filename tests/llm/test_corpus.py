"""Operators over the words of a whole corpus: language-model scores, spelling variants, ranked search."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import attention, ranking, scoring, spelling

from . import brute

# --- language model ------------------------------------------------------------------------

SMALL = attention.Shape(8, 8, 8, 12, 16)
QUICK = {"shape": SMALL, "steps": 60, "draw": 512, "frequent": 20}


def test_gradient_is_that_of_the_loss():
    shape, rng = attention.Shape(4, 5, 6, 7, 8), np.random.default_rng(0)
    model = attention.Model(shape, attention.start(shape, np.ones(20)).astype(np.float64))
    tokens, target, wanted = rng.integers(0, 20, (3, 8)), rng.integers(0, 20, (3, 8)), rng.random((3, 8)) < 0.7
    loss, g = model.gradient(tokens, target, wanted)
    assert loss == pytest.approx(-model.score(tokens, target, wanted).mean(), abs=1e-5)
    for i in rng.integers(0, shape.size, 60):
        old, both = model.flat[i], []
        for step in (1e-3, -1e-3):
            model.flat[i] = old + step
            both.append(model.gradient(tokens, target, wanted)[0])
        model.flat[i] = old
        assert (both[0] - both[1]) / 2e-3 == pytest.approx(g[i], abs=1e-3)


def test_probabilities_add_up_and_look_back_only():
    shape, rng = SMALL, np.random.default_rng(1)
    flat = attention.start(shape, rng.random(64) * 100)
    for scale in (1, 30):  # large weights too
        model = attention.Model(shape, (flat * scale).astype(np.float32))
        tokens = rng.integers(0, 64, (1, 16))
        wanted = np.zeros((64, 16), bool)
        wanted[:, 9] = True
        target = np.tile(tokens, (64, 1))
        target[:, 9] = np.arange(64)
        assert np.exp(model.score(np.tile(tokens, (64, 1)), target, wanted).astype(float)).sum() == pytest.approx(1, abs=1e-3)
    later = tokens.copy()
    later[0, 10:] = rng.integers(0, 64, 6)
    model = attention.Model(shape, flat)
    assert model.score(tokens, target[:1], wanted[:1]) == pytest.approx(model.score(later, target[:1], wanted[:1]), abs=1e-6)


@pytest.mark.parametrize("window,stride", [(8, 8), (8, 5), (8, 1), (3, 2)])
def test_windows_score_each_place_once(window, stride):
    sizes = np.array([1, 0, 7, 8, 9, 23, 24, 100])
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    first, owner, context = attention.windows(bounds, window, stride)
    places = np.arange(bounds[-1])
    source, _, wanted = attention.cut(places, places, bounds, first, owner, context, window)
    assert sorted(source[wanted].tolist()) == places.tolist()
    assert all(bounds[o] <= s.min() and s.max() < bounds[o + 1] for s, o in zip(source, owner))


def test_long_texts_keep_their_context():
    """With windows that overlap, a text of one window and the same inside a longer one score alike up to there."""
    shape = SMALL
    model = attention.Model(shape, attention.start(shape, np.ones(64)))
    seq = np.random.default_rng(2).integers(0, 64, 40)
    target, source = seq[1:], seq[:-1]
    parts = []
    for n in (16, 39):
        first, owner, context = attention.windows(np.array([0, n]), 16, 12)
        s, t, w = attention.cut(source, target, np.array([0, n]), first, owner, context, 16)
        parts.append(model.score(s, t, w))
    assert parts[1][:16] == pytest.approx(parts[0], abs=1e-6) and len(parts[1]) == 39


def test_words_are_those_of_the_contract():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aBé \t\n\x0b\x0c\r\x1c\x85\xa0Z日🙂.") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", "  ", "x"]
    words, number, rows = scoring.words_of(pa.array(texts))
    for k, t in enumerate(texts):
        assert [words[j] for j in number[rows[k] : rows[k + 1]]] == brute.SPACED.findall(brute.fold(t))
    assert len(set(words)) == len(words)


def test_base_scores(spark, docs, corpus):
    got = scoring.score_documents(docs, **QUICK).collect()
    want = brute.base_scores(corpus)
    key = lambda x: (str(x[0]), *x[1:5], round(x[5], 6))
    assert sorted(key(tuple(r)) for r in got) == sorted(map(key, want))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_same_text_same_score_whatever_the_partition(spark, corpus):
    one, two = (scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), share=10**9, **QUICK) for rows, n in ((corpus, 2), (corpus[::-1], 5)))
    a, b = ({(r.doc_id, r.n_tokens, r.n_known): r.score for r in x.collect()} for x in (one, two))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-4) for k in a)


def test_held_out_texts_teach_nothing(spark, corpus):
    import zlib

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    other = [(i, "quite another text here" if held(i) else t) for i, t in corpus]
    a, b = ({(r.doc_id, r.n_tokens): (r.score, r.base_score) for r in scoring.score_documents(spark.createDataFrame(x, "doc_id long, text string").coalesce(1), **QUICK).collect() if not r.held_out} for x in (corpus, other))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_model_beats_word_counts_on_held_out_texts(spark):
    got = scoring.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum()


def test_scores_of_odd_tables(spark, empty):
    assert scoring.score_documents(empty, **QUICK).count() == 0
    only = spark.createDataFrame([(7, "a b"), (2, None)], "doc_id long, text string")  # nothing to learn from, or one text
    rows = scoring.score_documents(only, folds=1, out=0, **QUICK).collect()
    assert {(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows} == {(7, True, 3, 0, 0, 0.0), (2, True, 1, 0, 0, 0.0)}
    long = spark.createDataFrame([(0, "x" * 200_000), (1, "ab " * 50_000)], "doc_id long, text string")
    assert all(math.isfinite(r.score) for r in scoring.score_documents(long, **QUICK).collect())


# --- spelling ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(11)
    stems = ["".join(rng.choice("abcéÿ×") for _ in range(rng.randint(4, 8))) for _ in range(60)]
    texts = []
    for k in range(80):
        words = []
        for _ in range(60):
            w = stems[min(rng.randrange(60), rng.randrange(60))]
            if rng.random() < 0.4:
                p, e = rng.randrange(len(w)), rng.randrange(3)
                w = w[:p] + ("", rng.choice("abcé"), rng.choice("abcé") + w[p])[e] + w[p + 1 :]
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        texts.append((k, " ".join(words)))
    texts.append((81, "qqqqqa " * 40 + "qqqqba " * 15 + "qqqcba " * 5))
    return texts + [(None, "abcab abcab, abcab"), (3, None), (4, ""), (5, "À1À bß 日本 aaaaaa aaaaa aaaaaaa " * 4), (5, "Straße STRASSE Straße Straße")]


def as_words(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.mark.parametrize("step", [1 << 20, 50])
def test_variants(spark, spelled, step):
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in spelled], "doc_id long, text string, word int, n int, near int").repartition(3)
    got = spelling.group_variants(docs, step=step)
    want = brute.variants(spelled)
    assert as_words(got) == want and got.count() == len(want)
    assert any(v[2] and v[4] != v[2] for v in want.values())  # a chain


def test_neighbourhoods_hold_every_string_once():
    letters = np.frombuffer("abé".encode("latin-1"), np.uint8)
    texts = ["aabb", "a", "éaé", "bbbbb", ""]
    words = spelling.Words(pa.array(texts))
    for step in (1, 7, 1 << 20):
        found = [[] for _ in texts]
        for place, word, letter, kind in spelling.neighbourhood(words, letters, lambda h: np.arange(len(h)), step):
            for w, t in zip(word.tolist(), spelling.spell(words, place, word, letter, kind).to_pylist()):
                found[w].append(t)
        for t, got in zip(texts, found):
            cuts = {t[:k] + t[k + 1 :] for k in range(len(t))}
            swaps = {t[:k] + c + t[k + 1 :] for k in range(len(t)) for c in "abé"} - {t}
            puts = {t[:k] + c + t[k:] for k in range(len(t) + 1) for c in "abé"} if t else set()
            assert sorted(got) == sorted(cuts | swaps | puts)


def test_hashes_of_edits_are_those_of_the_words():
    letters = np.frombuffer(b"abc", np.uint8)
    words, seen = spelling.Words(pa.array(["abcab", "cc"])), []
    for place, word, letter, kind in spelling.neighbourhood(words, letters, lambda h: seen.append(h) or np.arange(len(h))):
        h = seen[-1]
        if len(h) == len(place):
            assert (spelling.Words(spelling.spell(words, place, word, letter, kind)).hashes()[1] == h).all()


def test_long_chains_end(spark, tmp_path):
    from lectern.llm.common import Workspace

    forms = [(f"w{k}", f"w{k + 1}") for k in range(37)] + [(f"leaf{k}", "w5") for k in range(200)]
    got = spelling.roots(Workspace(spark, "roots"), spark.createDataFrame(forms, "word string, form string")).collect()
    assert len(got) == len(forms) and {r.root for r in got} == {"w37"}


def test_variants_of_odd_tables(spark, empty):
    assert spelling.group_variants(empty).count() == 0
    assert spelling.group_variants(spark.createDataFrame([(1, "a bb ccc"), (2, None)], "doc_id long, text string")).count() == 0
    long = "ab" * 20_000
    rows = [(k, f"{long} {long[:-1]}") for k in range(4)]
    assert as_words(spelling.group_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute.variants(rows)
    with pytest.raises(ValueError):
        spelling.group_variants(empty, factor=1)


# --- ranking -------------------------------------------------------------------------------

ITEMS = [("a", "one TWO three"), ("b", None), ("c", ""), ("d", "zzz yyy"), ("a", "x x x X"), ("e", "é ééé ü"), ("f", "a b a b a b")]


def ranked(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("shard_bytes,round_bytes", [(8 << 20, 1 << 20), (600, 1 << 20), (1, 100)])
def test_ranking(spark, docs, corpus, shard_bytes, round_bytes):
    items = ITEMS + [(f"t{k}", " ".join(brute.SPACED.findall(t)[:20])) for k, (_, t) in enumerate(corpus[:90:7])]
    table = spark.createDataFrame([(*x, 0, 1) for x in items] + [(None, "one two", 0, 1)], "item_id string, text string, doc_id long, rank int")
    got = ranking.rank_documents(docs, table, shard_bytes=shard_bytes, round_bytes=round_bytes)
    assert got.dtypes == [("item_id", "string"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert ranked(got) == sorted((x for r in brute.ranking(corpus, items).values() for x in r), key=repr)


def test_bounds_spare_work():
    """Probing gives what scoring all gives, and scores fewer documents."""
    rng = random.Random(5)
    texts = [" ".join(["the"] * rng.randint(0, 3) + [f"w{min(rng.randrange(300), rng.randrange(300))}" for _ in range(40)]) for _ in range(2000)]
    names = ["doc_ids", "sizes", "terms", "df", "docs", "tf", "wide", "most", "least"]
    data, offsets = ranking.utf8_parts(pa.array(texts, pa.large_string()))
    n, terms, df, doc, tf, most, least = ranking._postings(data, offsets)
    parts = [None, n.astype(np.int32), terms, df.astype(np.int32), doc.astype(np.int32), tf.astype(np.uint8), np.empty(0, np.int32), most.astype(np.int32), least.astype(np.int32)]
    row = {k: x.tobytes() if x is not None else None for k, x in zip(names, parts)}
    q = ranking.Queries(["the w200 w250 w1"])
    shard = ranking.Shard(row, len(texts), int(n.sum()))
    at, there = q.find(shard.terms)
    assert there.all()
    weights = np.floor(1000 * np.log((2 * len(texts) + 2) / (2 * df[at] + 1))).astype(np.int64)
    ceilings = shard.ceilings(at, weights)
    for k in range(len(at)):
        assert shard.scores(int(at[k]), int(weights[k]))[1].max() <= ceilings[k]
    all_ids, all_scores = ranking.max_score(shard, at, weights, 10, 1)
    tenth = int(np.sort(all_scores)[-10])
    tally = {}
    ids, scores = ranking.max_score(shard, at, weights, 10, tenth, tally)
    full = dict(zip(all_ids.tolist(), all_scores.tolist()))
    assert sorted(ids.tolist()) == sorted(i for i, s in full.items() if s >= tenth)
    assert all(full[i] == s for i, s in zip(ids.tolist(), scores.tolist()))
    assert tally["scored"] < len(full) / 4


def test_ties_go_by_id(spark):
    docs = spark.createDataFrame([(k, "same words here") for k in (5, 3, 9, 1, 7)] + [(None, "same words here"), (2, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "words")], "item_id int, text string")
    got = ranking.rank_documents(docs, items, k=4).orderBy("rank").collect()
    assert [(r.item_id, r.rank, r.doc_id) for r in got] == [(1, 1, 1), (1, 2, 3), (1, 3, 5), (1, 4, 7)]
    assert [r.doc_id for r in ranking.rank_documents(docs, items).orderBy("rank").collect()] == [1, 3, 5, 7, 9, None]


def test_ranking_of_odd_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id string, text string")
    some = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert ranking.rank_documents(docs, none).columns == ["item_id", "rank", "doc_id", "score"]
    assert ranking.rank_documents(docs, none).count() == 0 and ranking.rank_documents(empty, some).count() == 0
