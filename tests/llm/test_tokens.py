"""Token counts and SentencePiece against the library."""

import random

import numpy as np
import pytest

from lectern.llm import counts, pieces

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=counts.default_model())


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(counts.default_model())


def odd_texts(vocabulary, n=1500):
    rng = random.Random(5)
    chars = "abeinrst th▁ \n\té日🙂</s>[INST]12\r;(){}\"'.,\x00​　"
    known = [p for p in vocabulary.pieces if not p.startswith("<0x")]
    out = ["", " ", "   ", "\n", " \n ", "a\n\n b", "▁", " ▁ x", "x" * 500, " " * 40, "🙂" * 9]
    out += ["".join(rng.choice(chars) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return out + ["".join(rng.choice(known) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def test_counts(docs, corpus, library):
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in counts.token_counts(docs, limit=100).collect()), key=repr)
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 100) for i, t in corpus]
    assert got == sorted(want, key=repr)


def test_counts_of_odd_texts(library, vocabulary):
    import pyarrow as pa

    known = ["the", "", " ", "\n"]
    raw = np.frombuffer("".join(known).encode(), np.uint8)
    ends = np.cumsum([len(k) for k in known])
    hashes = counts.word_hashes(raw, np.concatenate(([0], ends[:-1])), ends, False)
    made = counts.Counting(library.encode, counts.Table(hashes, np.array([counts.measure(library.encode, k) for k in known]), 8), limit=50)
    texts = [*odd_texts(vocabulary), None, *long_words()]
    for lo in range(0, len(texts), 97):
        part = texts[lo : lo + 97]
        n, size = made.counts(pa.array(part, pa.string()))
        assert n.tolist() == [len(library.encode(t or "")) for t in part]
        assert size.tolist() == [len((t or "").encode()) for t in part]
    assert len(made.cache) <= 50


def test_pretokens_of_both_forms(vocabulary):
    import pyarrow as pa

    for t in odd_texts(vocabulary):
        data, start, end, _, alone, _ = counts.pretoken_spans(pa.array([t]))
        assert sorted([bytes(data[a:b]).decode() for a, b in zip(start, end)] + [""] * len(alone)) == sorted(counts.pretokens(t)), t


def test_counts_empty(empty):
    assert counts.token_counts(empty).count() == 0


def test_frequent_pretokens_cover_all_texts(spark):
    df = spark.createDataFrame([(k, "rare%d often often" % k) for k in range(50)], "doc_id long, text string").repartition(4)
    assert counts.frequent_pretokens(df, limit=1) == [(b"often", 100)]
    assert counts.frequent_pretokens(df.where("doc_id < 0")) == []


def test_encoding_equals_the_library(library, vocabulary):
    encoder = pieces._Cache(pieces.Encoder(vocabulary))
    texts = odd_texts(vocabulary)
    for got, want in zip(encoder.texts(texts), library.encode(texts, num_threads=1)):
        assert np.frombuffer(got, np.int32).tolist() == want
    decoder = pieces.Decoder(vocabulary)
    for ids, want in zip(library.encode(texts), library.decode(library.encode(texts))):
        assert decoder.text(np.array(ids, np.int32)) == want


def long_words():
    rng = random.Random(9)
    letters, cjk = "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x4E00 + 7 * k) for k in range(900))
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    out = [pick(letters, n) for n in (21, 25, 400, 950, 961, 1056, 1057, 5000)]
    out += ["a" * n for n in (500, 961, 3001, 9999)] + ["ab" * 2500, "the" * 1500, "=" * 4001, "0" * 3000, "-" * 2000 + "x" * 2000]
    out += [pick(cjk, 3000), pick(cjk + letters + "0123456789+/", 6000), pick(letters + letters.upper() + "0123456789+/", 8000), pick("et", 4000), pick("日本語", 2500) + "é🙂" * 900, "x" * 1500 + "\n" + "internationalization" * 200]
    return out


def test_long_words_equal_the_library(library, vocabulary, monkeypatch):
    words = long_words()
    want = library.encode(words, num_threads=1)
    for step, overlap in ((480, 6), (40, 2), (31, 1)):  # rows that agree, and rows that don't
        monkeypatch.setattr(pieces, "STEP", step)
        monkeypatch.setattr(pieces, "OVERLAP", overlap)
        monkeypatch.setattr(pieces, "ROWS", 2048 if step == 480 else 7)
        got = pieces._Cache(pieces.Encoder(vocabulary)).texts(words)
        for w, g, x in zip(words, got, want):
            assert np.frombuffer(g, np.int32).tolist() == x, (step, w[:30], len(w))


def test_a_megabyte_without_spaces(library, vocabulary):
    import time

    rng = random.Random(1)
    for chars in ("abcdefghijklmnopqrstuvwxyz", "".join(chr(0x4E00 + k) for k in range(3000)), "a"):
        text = "".join(rng.choices(chars, k=1_000_000 // len(chars[0].encode())))
        start = time.process_time()
        got = np.frombuffer(pieces._Cache(pieces.Encoder(vocabulary)).texts([text])[0], np.int32)
        took = time.process_time() - start
        assert got.tolist() == library.encode(text) and took < 20, (chars[:3], took)


def test_refused_models(tmp_path, spark, docs):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(counts.default_model(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.add_dummy_prefix = False
    path = str(tmp_path / "m.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    with pytest.raises(ValueError):
        pieces.load(path)
    with pytest.raises(ValueError):
        counts.token_counts(docs, path)


def test_cache_generations(library, vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 30)
    encoder = pieces._Cache(pieces.Encoder(vocabulary))
    for t in ("the cat sat", "on the mat " * 3, " ".join(f"w{k}" for k in range(50)), "the cat"):
        assert np.frombuffer(encoder.texts([t])[0], np.int32).tolist() == library.encode(t)


def test_neighbours_stay_apart_as_merging_says(vocabulary):
    rng = random.Random(2)
    rank = {p: int(r) for p, r in zip(vocabulary.pieces, vocabulary.rank[:-1]) if r >= 0}
    pairs = [(int(rng.choice(vocabulary.key_ids)), int(rng.choice(vocabulary.key_ids))) for _ in range(4000)]
    got = pieces.stay_apart(vocabulary, *(np.array(x, np.int64) for x in zip(*pairs)))
    for (s, t), ok in zip(pairs, got):
        a, b = vocabulary.pieces[s], vocabulary.pieces[t]
        assert (pieces.merge(a + b, rank)[0] == [a, b]) == ok, (a, b)


def test_unigram_viterbi(vocabulary, tmp_path):
    """The same pieces with scores, read as a unigram model by the library and by us."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(counts.default_model(), "rb").read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    rng = random.Random(1)
    for p in proto.pieces:
        if p.type == pb.ModelProto.SentencePiece.NORMAL:
            p.score = -rng.uniform(5, 15) * (1 if len(p.piece) > 1 else 1.3)
    path = tmp_path / "u.model"
    path.write_bytes(proto.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    encoder = pieces.Encoder(pieces.load(str(path)))
    words = ["the", "internationalisation", "abcabcabc", "ertionhea", "Donaudampf"]
    for w, ids in zip(words, encoder.words([pieces.SPACE + w for w in words])):
        assert ids.tolist() == library.encode(w)


def test_round_trip(docs, corpus, library):
    got = sorted(((r.doc_id, tuple(r.ids), r.n_tokens, r.exact) for r in pieces.round_trip(docs).collect()), key=repr)
    want = [(i, tuple(library.encode(t or "")), len(library.encode(t or "")), True) for i, t in corpus]
    assert got == sorted(want, key=repr)


def test_encode_then_decode(docs, corpus):
    back = pieces.decode(pieces.encode(docs))
    got = sorted(((r.doc_id, r.text) for r in back.collect()), key=repr)
    assert got == sorted(((i, (t or "").replace("▁", " ")) for i, t in corpus), key=repr)


def test_round_trip_empty(empty):
    assert pieces.round_trip(empty).count() == 0


def test_short_words_are_encoded_by_length_not_one_by_one(monkeypatch):
    from lectern.llm import pieces

    words = ["", "x", "▁a", "▁" + "ab" * 9 + "c", "▁" + "abc" * 7, "é🙂日", "\ud800"] * 2
    encoder, seen, longer = pieces.Encoder(pieces.load(pieces.default_model())), [], pieces.Encoder._longer
    one_by_one = [encoder.words([w])[0].tolist() for w in words]
    monkeypatch.setattr(pieces.Encoder, "_longer", lambda self, ws: seen.extend(ws) or longer(self, ws))
    assert [x.tolist() for x in encoder.words(words)] == one_by_one
    assert seen == [w for w in words if len(w) > pieces.EXACT] and len(seen) == 2
