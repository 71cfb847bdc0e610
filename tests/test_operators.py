"""Chunking, store, caches, profiles, QA, sources and streaming."""

import io
import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import caches, chunking, ordered, profile, qa, retrieval, store, workspaces
from lectern.plans import catalogue
from lectern.plans.ingest import ask_document, ingest_folder, load_text
from lectern.sources import external, files
from lectern.sources.html import page_items
from lectern.streaming.watch import watch_folder


def test_pages(spark):
    items = [("d", 0, "first paragraph", 1), ("d", 1, "   ", 9), ("d", 2, "second paragraph", 1), ("d", 3, "page two", 2), ("d", 4, "x", None), ("d", 5, "y", None), ("d", 6, "back", 1), ("e", 0, "   ", 1), ("e", 1, "real content", 1)]
    df = spark.createDataFrame(items, "doc_id string, pos int, text string, page int")
    got = [tuple(r) for r in chunking.chunk_pages(df, 4000).orderBy("doc_id", "chunk_index").collect()]
    assert got == [("d", 0, 1, "first paragraph\nsecond paragraph"), ("d", 1, 2, "page two"), ("d", 2, None, "x\ny"), ("d", 3, 1, "back"), ("e", 0, 1, "real content")]
    big = spark.createDataFrame([("d", 0, "word " * 1000, 1)], "doc_id string, pos int, text string, page int")
    pieces = chunking.chunk_pages(big, 100).collect()
    assert len(pieces) > 1 and all(len(r.piece) <= 100 and r.page == 1 for r in pieces)


def test_converted(spark):
    ok = '{"texts": [{"text": "a", "prov": [{"page_no": 3}, {"page_no": 4}]}, {"text": "b"}], "more": 1}'
    df = spark.createDataFrame([("p", bytearray(ok.encode())), ("q", bytearray(b"{}"))], "path string, content binary")
    assert [tuple(r) for r in files.converted_items(df).collect()] == [("p", 0, 3, "a"), ("p", 1, None, "b")]
    with pytest.raises(Exception):
        files.converted_items(spark.createDataFrame([("p", bytearray(b"{oops"))], "path string, content binary")).collect()


def test_order_at_scale(spark):
    rng = random.Random(4)
    rows = [(k, rng.randint(0, 40), rng.randint(0, 9)) for k in range(500)]
    df = spark.createDataFrame(rows, "k long, a long, d long").repartition(7)
    want = sorted(rows, key=lambda r: (r[1], r[0]))
    ids = {r.k: r.id for r in ordered.number_rows(df, "a", "k", base=10).collect()}
    assert [ids[r[0]] for r in want] == list(range(10, 510))
    sums = {r.k: r.running for r in ordered.running_sum(df, F.col("d"), "a", "k").collect()}
    waits = {r.k: r.wait for r in ordered.queue_waits(df, F.col("a"), F.col("d"), "a", "k").collect()}
    total = free = 0
    for k, a, d in want:
        total += d
        assert sums[k] == total
        start = max(free, a)
        assert waits[k] == start - a
        free = start + d


def new_chunks(spark, path, *texts):
    return spark.createDataFrame([(path, k, None, t, [1.0]) for k, t in enumerate(texts)], "doc_path string, chunk_index long, page int, text string, embedding array<float>")


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    meta = lambda m: spark.createDataFrame([("a", m, 10, 0)], store.META)
    assert (s.version, s.chunks().count()) == (0, 0)
    s.replace(new_chunks(spark, "a", "v1"), meta(100))
    assert (s.version, s.chunks().count()) == (1, 1)
    probe = lambda m: store.unchanged(spark.createDataFrame([("a", m, 10)], "doc_path string, mtime long, size long"), s.meta()).count()
    assert (probe(100), probe(200)) == (1, 0)
    old = s.chunks()
    s.replace(new_chunks(spark, "a", "v2"), meta(200))
    assert (s.version, [(r.chunk_id, r.text) for r in s.chunks().collect()]) == (2, [(1, "v2")])
    assert old.first().text == "v1"  # readers keep their snapshot
    again = store.Store(spark, f"file://{tmp_path}/s")
    assert again.version == 2 and again.document("a").count() == 1
    gone = spark.createDataFrame([("a",), ("nope",)], "doc_path string")
    assert again.remove(gone) == 1 and again.version == 3 and again.chunks().count() == 0
    assert again.remove(gone) == 0 and again.version == 3


def test_folder_ingest(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.txt").write_text("word " * 500)
    (folder / "b.txt").write_text("short")
    (folder / "sub" / "c.txt").write_text("not seen")
    s = store.Store(spark, f"file://{tmp_path}/s")
    first = ingest_folder(spark, str(folder), s, 400).collect()
    assert s.version == 2 and all(not r.skipped_unchanged and r.chunks_stored > 0 for r in first)
    n = s.chunks().count()
    second = ingest_folder(spark, str(folder), s, 400).collect()
    assert s.version == 2 and s.chunks().count() == n and all(r.skipped_unchanged and r.chunks_stored == 0 for r in second)
    (folder / "b.txt").unlink()
    ingest_folder(spark, str(folder), s, 400, prune=True)
    assert s.version == 3 and s.meta().count() == 1


def test_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    seen = []
    watch = lambda: watch_folder(spark, str(tmp_path / "in"), lambda b: seen.extend(r.path for r in b.collect()), str(tmp_path / "ck"), once=True).awaitTermination(60)
    watch()
    (tmp_path / "in" / "b.txt").write_text("two")
    watch()
    assert [p.rsplit("/", 1)[1] for p in seen] == ["a.txt", "b.txt"]


def test_retrieval(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "chunk_id long, embedding array<float>")
    assert [r.chunk_id for r in retrieval.top_k(df, [1.0, 0.0], 3).collect()] == [1, 3, 2]
    q = spark.createDataFrame([("q", [0.0, 1.0])], "query_id string, query array<float>")
    assert [(r["rank"], r.chunk_id) for r in retrieval.top_k_batched(df, q, 2).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    texts = spark.createDataFrame([("a b",), ("a b",), (None,)], "t string")
    e = [tuple(r.embedding) for r in retrieval.embed(texts, "t").collect()]
    assert e[0] == e[1] != e[2] and len(e[0]) == 64


def test_caches(spark):
    rows = spark.createDataFrame([("a", 4), ("b", 12), ("c", 3)], "k string, n long")
    kept = caches.accepted(rows, F.col("n"), 10)
    assert {r.k for r in kept.collect()} == {"a", "c"}
    assert {r.k: r.hit for r in caches.lookup(rows, kept.select("k"), "k").collect()} == {"a": True, "b": False, "c": True}
    assert caches.context_capacity(10**12) == 50_000_000_000 and caches.context_capacity(100) == 50
    loads = spark.createDataFrame([("s", 1, "x"), ("s", 2, "x"), ("s", 3, "y")], "s string, t int, h string")
    assert [r.evicted for r in caches.evictions(loads, "s", "h", "t").orderBy("t").collect()] == [None, None, "x"]
    base = "word " * 600
    last = spark.createDataFrame([("m", base)], "model string, text string")
    for text, want in ((base + "more", 1), (base, 0), ("other " * 600, 0), (base[:30] + "z" * 3000, 0), (base[:2900], 0)):
        got = caches.append_only(spark.createDataFrame([("m", text)], "model string, text string"), last, "model")
        assert got.count() == want
    assert caches.hit_rate(loads.withColumn("hit", F.col("t") > 1), "s").first().hits == 2


def test_profiles(spark):
    rng = random.Random(1)
    rows = [(u, t, rng.uniform(0, 100)) for u in range(3) for t in range((5, 21, 90)[u])]
    df = spark.createDataFrame(rows, "u int, t int, x double")
    got = {r.u: r.average for r in profile.running_average(df, "u", F.col("x"), "t").collect()}
    arrays = df.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("a"))
    folded = {r.u: r.v for r in arrays.select("u", profile.fold_average(F.transform("a", lambda s: s["x"])).alias("v")).collect()}
    for u in range(3):
        v = 0.0
        for n, x in enumerate(x for w, _, x in rows if w == u):
            v += (x - v) / (min(n, 20) + 1)
        assert got[u] == pytest.approx(v) == pytest.approx(folded[u])


def test_answers(spark):
    docs = spark.createDataFrame([("s", 1, "We see that it. No."), ("s", 2, "Nothing here."), ("t", 3, "NONE")], "source string, doc_id long, text string")
    found = qa.map_phase(docs, 50, lambda p: qa.extract_sentence(p, "that"), "source", "doc_id")
    assert [tuple(r) for r in found.collect()] == [("s", 1, 0, "We see that it")]
    assert {r.source: r.n_facts for r in qa.answer_all(docs, found, "source", "doc_id", "chunk_index").collect()} == {"s": 1, "t": 0}
    assert [r.calls for r in qa.turn_labels(spark.createDataFrame([(1, 0), (1, 2)], "c int, t int"), "c", "t").orderBy("t").collect()] == [2, 1]
    assert [r.calls for r in qa.turn_labels(spark.createDataFrame([(1, 0), (1, 2)], "c int, t int"), "c", "t", "raw").collect()] == [2, 2]
    same = spark.createDataFrame([("p",), ("p",), ("q",)], "piece string")
    assert qa.distinct_pieces(same).count() == 2
    graph = spark.createDataFrame([("a", None), ("b", "a"), ("c", "a"), ("c", "b")], "node string, needs string")
    assert {r.node: r.level for r in qa.dependency_levels(spark, graph).collect()} == {"a": 0, "b": 1, "c": 2}
    lines = spark.createDataFrame([(1, 0, '{"response": "a", "eval_count": 1}'), (1, 1, " "), (1, 2, '{"thinking": "t", "response": "b", "eval_count": 9}')], "k int, n int, j string")
    assert tuple(qa.fold_stream(lines, "k", "n", "j").first()) == (1, "ab", "t", 9, 2)


def test_generators(spark):
    class Fake:
        def generate(self, prompt, context=None):
            return {"response": prompt.upper()}

    parts = []
    assert qa.generate_streaming(Fake(), "hi", None, parts.append)["response"] == "HI" and parts == ["HI"]
    asked = spark.createDataFrame([("a",), ("b",)], "p string").select(qa.ask_column(Fake())("p").alias("r"))
    assert sorted(r.r for r in asked.collect()) == ["A", "B"]


def test_workspaces(spark):
    w = spark.createDataFrame([("b", ["x", "y"]), ("a", ["z"])], "name string, paths array<string>")
    w = workspaces.save(w, spark.createDataFrame([("b", ["q"])], "name string, paths array<string>"))
    assert {r.name: list(r.paths) for r in w.collect()} == {"a": ["z"], "b": ["q"]}
    rest, there = workspaces.delete(w, "a")
    assert there and rest.count() == 1 and not workspaces.delete(rest, "a")[1]
    listed = spark.createDataFrame([("z",)], "path string")
    assert [tuple(r) for r in workspaces.missing_paths(w, listed).collect()] == [("b", "q")]


def make_zip(path, *entries):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in entries:
            z.writestr(name, body)


def test_zips_and_corpora(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "never")
    make_zip(tmp_path / "one.ZIP", ("a.txt", "alpha"), ("../evil.txt", "x"), ("/abs.txt", "x"), ("nested.zip", inner.getvalue()))
    (tmp_path / "b.txt").write_text("beta")
    paths = [str(tmp_path / "b.txt"), str(tmp_path / "one.ZIP")]
    assert [(r.pos, r.name) for r in files.expand_zips(files.read_files(spark, paths)).orderBy("pos", "name").collect()] == [(0, "b.txt"), (1, "a.txt")]
    ab, ba = (load_text(spark, p, 4096).first() for p in (paths, paths[::-1]))
    assert ab.doc_hash == ba.doc_hash and ab.text == "=== b.txt ===\nbeta\n\n=== a.txt ===\nalpha" and list(ab.names) == ["b.txt", "a.txt"] and ab.fits_in_one_chunk
    assert files.hashed_set(files.expand_zips(files.read_files(spark, paths))) == ab.doc_hash
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception):
        load_text(spark, [str(tmp_path / "bad.txt")], 4096).collect()
    with pytest.raises(ValueError):
        load_text(spark, [], 4096)


def test_ask_document(spark, tmp_path):
    (tmp_path / "big.txt").write_text("filler words here. " * 800 + "we know that needle is it. " + "more words. " * 800)
    out = ask_document(spark, [str(tmp_path / "big.txt")], "where is the needle?", context=1024)
    assert out["used_map_reduce"] and len(out["sources"]) == 1 and "needle" in out["answer"]
    with pytest.raises(ValueError):
        ask_document(spark, [str(tmp_path / "big.txt")], "summarize")


def test_conversion_failures_are_rows(spark):
    df = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"y"))], "path string, content binary")

    def convert(path, content):
        if path == "b":
            raise RuntimeError("broken")
        return [("one", 1), ("two", None)]

    assert [tuple(r) for r in files.convert_files(df, convert).orderBy("path", "pos").collect()] == [("a", 0, 1, "one", None), ("a", 1, None, "two", None), ("b", None, None, None, "RuntimeError: broken")]


def test_external(spark, monkeypatch, tmp_path):
    monkeypatch.delenv("DOCLING_BIN", raising=False)
    monkeypatch.chdir(tmp_path)
    assert external.resolve_converter("x") == "x" and external.resolve_converter() == "docling"
    monkeypatch.setenv("DOCLING_BIN", "/opt/d")
    assert external.resolve_converter() == "/opt/d"
    models = external.models_table(spark, json.loads('{"models": [{"name": "m", "size": 5}]}'))
    assert external.weight_bytes(models, "m") == 5
    with pytest.raises(LookupError):
        external.weight_bytes(models, "n")


def test_html(spark):
    html = "<html><head><title>T &amp; U</title><style>p{}</style><script>var t='</p>';</script></head><body><!-- no <p>x</p> --><p>a <b>b</b>\n c</p><ul><li>x</li><li> </li></ul>&lt;y&gt;</body></html>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    assert [tuple(r) for r in page_items(df).orderBy("pos").collect()] == [(1, 0, "T & U"), (1, 1, "a b c"), (1, 2, "x"), (1, 3, "<y>")]


def test_upsert(spark):
    old = spark.createDataFrame([("m", 1, "a"), ("m", None, "b"), ("n", 1, "c")], "model string, ctx int, v string")
    new = spark.createDataFrame([("m", None, "z"), ("o", 2, "y")], "model string, ctx int, v string")
    assert {tuple(r) for r in caches.upsert(old, new, "model", "ctx").collect()} == {("m", 1, "a"), ("n", 1, "c"), ("m", None, "z"), ("o", 2, "y")}


def test_profile_of_a_call_log(spark):
    rows = [("k", 0, "answer", 9, 1.0, 9, 1.0, 9.0), ("k", 1, "prime", 1000, 1000.0, 10, 1000.0, 2000.0), ("k", 2, "answer", 5, 10.0, 12, 20.0, 70.0), ("k", 3, "reduce", 2000, 1000.0, 10, 500.0, 0.0), ("x", 0, "answer", 1, 1.0, 1, 1.0, 1.0)]
    log = spark.createDataFrame(rows, "key string, seq int, label string, prompt_eval_count long, prompt_eval_ms double, eval_count long, eval_ms double, wall_ms double")
    assert [tuple(r) for r in profile.profiles(log, "key", "seq").collect()] == [("k", 1500.0, 15.0, 12.0, 40.0, 2, 1)]


def test_swap_prediction(spark):
    from lectern.functions import models as M

    n = lambda x: F.lit(float(x))
    context = F.array(*(F.lit(k) for k in range(4))).cast("array<bigint>")
    ask = lambda c, s: spark.range(1).select(M.predict_swap(n(500), n(2), c, n(1e9), n(1), n(10), n(5), n(1), F.lit(s)).alias("d")).first().d
    assert ask(context, 1).chose_swap and ask(context, 0) is None and ask(F.lit(None).cast("array<bigint>"), 1) is None


def test_prefix_pairs(spark):
    """Each earlier different text counts, whatever stands between, against all pairs in Python."""
    head = "h" * 120
    texts = [head + "a" * 200, head + "b" * 60, head + "a" * 200, head + "c" * 300, head + "a" * 200 + "x", head + "b" * 60 + "yy", head + "a" * 150 + "é" * 9, head, "h" * 99, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set()
    for k, new in enumerate(texts):
        for j, old in enumerate(texts[:k]):
            n = len(os.path.commonprefix([new or "", old or ""]))
            if new != old and n >= 100 and n >= 0.5 * len(old):
                want.add((k, j, n))
    got = [tuple(r) for r in caches.prefix_pairs(docs, "doc_id", 100).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {(4, 0, 320), (5, 1, 180)} <= want


def test_offload_ties(spark, tmp_path):
    """Every user gets a row, ties round to even, as in the reference."""
    spark.range(128).select(F.col("id").alias("user_id")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: r.warning for r in catalogue.QUERIES["offload_warning"](spark, str(tmp_path)).collect()}
    want = {k: f"only {k / 128 * 100:.0f}% of m is resident" if k / 128 < 0.97 else None for k in range(128)}
    assert got == want and "only 12%" in got[16]


def test_dependency_levels(spark, tmp_path):
    """Long chains, joints, unreached nodes, cycles; conversations of over 100 turns and with gaps."""
    chain = [(k, k - 1 if k else None) for k in range(300)]
    more = [(1000, 299), (1000, 5), (1001, 1000), (1002, 1001), (1002, 0), (1003, 1002), (2000, 2001), (2001, 2000), (2002, 2000), (2003, 9999)]
    got = {r.node: r.level for r in qa.dependency_levels(spark, spark.createDataFrame(chain + more, "node long, needs long")).collect()}
    assert got == {k: k for k in range(300)} | {1000: 300, 1001: 301, 1002: 302, 1003: 303}
    with pytest.raises(ValueError):
        qa.dependency_levels(spark, spark.createDataFrame([(0, None), (1, 0), (1, 2), (2, 1)], "node long, needs long"))
    rows = [(1, t) for t in range(250)] + [(2, 0), (2, 1), (3, 0), (3, 4)]
    spark.createDataFrame(rows, "conv_id long, turn int").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {tuple(r) for r in catalogue.QUERIES["dependency_depth"](spark, str(tmp_path)).collect()} == {(1, 249), (2, 1), (3, 4)}


def test_recursive_reduce(spark):
    long = ". ".join(f"fact {k} that counts {'x' * (k % 7)}" for k in range(60))
    df = spark.createDataFrame([("a", long), ("b", "short")], "source string, facts string")
    done = {r.source: r for r in qa.recursive_reduce(df, "source", 200, lambda p: qa.extract_sentence(p, "that")).collect()}
    assert done["b"].rounds == 0 and done["a"].rounds >= 1 and len(done["a"].facts) < len(long)
