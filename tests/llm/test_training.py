"""What the model of op11 learns from."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import scoring
from lectern.llm.attention import Model, Shape, start


def test_every_training_text_and_window_teaches(spark):
    texts = spark.range(300).selectExpr("concat('text ', id) text")
    kept, part = scoring._some(texts, 1.0 / scoring.SHARE, 1)
    assert kept.count() == 300 and part == 1


def test_texts_are_sequences_of_words(spark):
    """One place of a sequence for each word and one for the end, whatever pieces the words have."""
    counts = spark.createDataFrame([("one", 5), ("two", 3), ("unheardofword", 1), ("", 4)], "word string, n long")
    tokens = scoring.model_tokens(counts, 4)
    *_, hashes, rows = scoring.spelled(pa.array(["One two unheardofword", None, "Ünseen ONE"]))
    source, target, to = scoring.sequences(hashes, rows, tokens)
    assert target.tolist() == [2, 3, 1, 0, 0, 1, 2, 0] and source.tolist() == [0, 2, 3, 1, 0, 0, 1, 2] and to.tolist() == [0, 4, 5, 8]
    assert tokens.counts.tolist() == [4, 1, 5, 3] and 10**tokens.share == pytest.approx(1 + 1 + 1)


def test_tables_find_every_key():
    keys = np.random.default_rng(3).integers(0, 2**64, 5000, np.uint64)
    keys[:40] = np.arange(40, dtype=np.uint64)  # many of one slot
    table = scoring.Table(keys, np.arange(5000), -1)
    assert table(keys).tolist() == list(range(5000)) and (table(keys + np.uint64(41)) == -1).all()
    assert scoring.Table(keys[:0], np.arange(0), -1)(keys[:9]).tolist() == [-1] * 9


def test_windows_of_equal_targets_have_one_order(spark):
    """Weights don't depend on the order of rows where windows differ only in the word before them."""
    texts = [("x y " * 60,), ("a " * 16 + "b " * 16 + "a " * 16,), ("b " * 40,)]
    shape, out = Shape(8, 8, 8, 12, 16), []
    for rows in (texts, texts[::-1]):
        df = spark.createDataFrame(rows, "text string").coalesce(1)
        out.append(scoring.train(df, scoring.model_tokens(scoring.word_counts(df), shape.tokens), shape, 512, 60, 10**9))
    assert np.abs(out[0] - out[1]).max() < 1e-4


def test_frozen_models_score_alike():
    shape, rng = Shape(8, 8, 8, 12, 16), np.random.default_rng(4)
    flat = start(shape, rng.random(64) * 100)
    s, t, w = rng.integers(0, 64, (20, 16)), rng.integers(0, 64, (20, 16)), rng.random((20, 16)) < 0.8
    assert Model(shape, flat).freeze().score(s, t, w) == pytest.approx(Model(shape, flat).score(s, t, w), abs=1e-4)


def test_every_training_word_lies_in_one_class_or_is_a_token(spark):
    """Shares of a class and its unseen word sum to one; no word is left out, however long or seldom."""
    rng = np.random.default_rng(6)
    words = {"".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 7))): int(rng.integers(1, 9)) for _ in range(2000)} | {"ñu": 3, "9": 1, "é" * 40: 5000, "the": 4000}
    counts = spark.createDataFrame([*words.items(), ("", 70)], "word string, n long")
    tokens = scoring.model_tokens(counts, 64)
    data, start, end, hashes, _ = scoring.spelled(pa.array([*words]))
    n, target = np.array([*words.values()]), tokens(hashes, scoring.spellings(data, start, end))
    assert tokens.counts.sum() == n.sum() + 70 and tokens.classes == 31
    assert np.bincount(target, n, 64)[1:].tolist() == tokens.counts[1:].tolist()  # the end is the first
    assert dict(zip(words, target.tolist()))["é" * 40] == 32  # the most frequent word, though of 80 bytes
    used = np.bincount(target, n + 1, 64)[1:32] + 1
    assert 10**tokens.share == pytest.approx(used) and tokens.counts[1:32].max() < 4 * tokens.counts[1:32].mean()


def test_words_that_are_no_tokens_are_predicted_in_context(spark):
    """Words that occur once or never follow what words spelled alike follow."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"a q{k}{j} b z{k}{j}" for j in range(40)) for k in rng.permutation(300)]
    tried = ["a qx b zy " * 20, "a zy b qx " * 20]
    rows = [(k, t) for k, t in enumerate(texts)]
    held = [k for k in range(1000, 1100) if held_out(k)][:2]
    docs = spark.createDataFrame(rows + list(zip(held, tried)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in scoring.score_documents(docs, shape=Shape(8, 8, 8, 12, 16), draw=4096, steps=200).collect()}
    one, two = (got[k] for k in held)
    assert one.held_out and two.held_out and one.base_score == pytest.approx(two.base_score)
    assert one.score > two.score + 10


def held_out(k: int) -> bool:
    return zlib.crc32(str(k).encode()) % 7 == 2
