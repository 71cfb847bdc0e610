"""The store by buckets, ingest with a converter, exactly-once streams, and the parse cache."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lectern.operators import store
from lectern.operators.parse_cache import ParseCache
from lectern.plans.ingest import ingest_folder, ingest_stream, load_documents, load_text
from lectern.sources import files


def rows(spark, n, text="v1"):
    ids = spark.range(n).select(F.format_string("doc-%d", "id").alias("doc_path"))
    chunks = ids.select("doc_path", F.posexplode(F.array(F.concat(F.lit(text), "doc_path"), F.lit("two"))).alias("chunk_index", "text"))
    chunks = chunks.select("doc_path", F.col("chunk_index").cast("long").alias("chunk_index"), F.lit(None).cast("int").alias("page"), "text", F.array(F.lit(1.0).cast("float")).alias("embedding"))
    return chunks, ids.select("doc_path", F.lit(1).cast("long").alias("mtime"), F.lit(2).cast("long").alias("size"), F.lit(3).cast("long").alias("last_ingested_at"))


def test_a_batch_rewrites_its_buckets_alone(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    assert s.replace(*rows(spark, 1000)) == 1000
    assert (s.version, s.manifest.next_id, s.chunks().count(), s.meta().count()) == (1000, 2000, 2000, 1000)
    assert s.chunks().select("chunk_id").distinct().count() == 2000
    before, old = s.manifest, s.chunks()
    chunks, meta = rows(spark, 1, "v2")
    assert s.replace(chunks, meta) == 1
    changed = [b for b in range(64) if s.manifest.buckets[b] != before.buckets[b]]
    assert len(changed) == 1
    assert {r.text for r in s.chunks().where("doc_path = 'doc-0'").collect()} == {"v2doc-0", "two"} and s.chunks().count() == 2000
    assert sorted(r.chunk_id for r in s.chunks().where("doc_path = 'doc-0'").collect()) == [2000, 2001]
    assert {r.text for r in old.where("doc_path = 'doc-0'").collect()} == {"v1doc-0", "two"}  # readers keep their files
    again = store.Store(spark, f"file://{tmp_path}/s")
    assert again.manifest == s.manifest and again.document("doc-7").count() == 1 and again.document("nope").count() == 0
    gone = spark.createDataFrame([("doc-7",), ("doc-7",), ("nope",), (None,)], "doc_path string")
    assert again.remove(gone) == 1 and again.version == 1002 and again.chunks().count() == 1998
    assert len([b for b in range(64) if again.manifest.buckets[b] != s.manifest.buckets[b]]) == 1


def test_documents_without_chunks_and_empty_buckets(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s", buckets=2)
    chunks, meta = rows(spark, 3)
    s.replace(chunks.limit(0), meta)
    assert (s.version, s.chunks().count(), s.meta().count()) == (3, 0, 3)
    assert s.remove(meta) == 3 and s.meta().count() == 0 and set(s.manifest.buckets) == {""}
    s.replace(chunks, meta)
    assert s.chunks().count() == 6 and s.version == 9


def test_a_batch_counts_once(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    assert s.replace(*rows(spark, 3), batch=("w", 0)) == 3
    again = store.Store(spark, f"file://{tmp_path}/s")
    assert again.replace(*rows(spark, 3, "other"), batch=("w", 0)) == 0 and again.manifest == s.manifest
    assert again.replace(*rows(spark, 3), batch=("x", 0)) == 3 and again.version == 6
    chunks, meta = rows(spark, 0)
    assert again.replace(chunks, meta, batch=("w", 1)) == 0 and again.applied("w", 1)


def convert(path, content):
    if b"broken" in content:
        raise ValueError("can't read it")
    parts = content.decode().split("|")
    return [(t, k + 1) for k, t in enumerate(parts)]


def test_folder_with_a_converter(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, body in (("a[1].txt", "one|two"), ("b{x}*?.txt", "three"), ("c.txt", "broken"), ("d\\e.txt", "four|five|six"), ("sp ace.txt", "seven")):
        (folder / name).write_text(body)
    s = store.Store(spark, f"file://{tmp_path}/s")
    report = {os.path.basename(r.doc_path): (r.skipped_unchanged, r.chunks_stored, r.error) for r in ingest_folder(spark, str(folder), s, 400, converter=convert, at_once=2).collect()}
    assert len(report) == 5 and report["a[1].txt"] == (False, 2, None) and report["c.txt"] == (False, 0, "ValueError: can't read it")
    assert s.version == 4 and s.chunks().count() == 7
    assert sorted((r.page, r.text) for r in s.chunks().where("doc_path like '%a[1].txt'").collect()) == [(1, "one"), (2, "two")]
    second = ingest_folder(spark, str(folder), s, 400, converter=convert).collect()
    assert s.version == 4 and sorted(r.skipped_unchanged for r in second) == [False] + [True] * 4  # what failed is tried again
    (folder / "c.txt").write_text("fine now")
    ingest_folder(spark, str(folder), s, 400, converter=convert)
    assert s.version == 5 and s.chunks().count() == 8


def test_files_that_are_no_text(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "bad.bin").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "in" / "good.txt").write_text("good")
    s = store.Store(spark, f"file://{tmp_path}/s")
    report = ingest_folder(spark, str(tmp_path / "in"), s).orderBy("doc_path").collect()
    assert [bool(r.error) for r in report] == [True, False] and s.version == 1
    assert ingest_folder(spark, str(tmp_path / "in"), s, prune=True).count() == 2


def test_a_stream_that_fails_after_its_commit(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text(f"text {k}")
    place, args = f"file://{tmp_path}/s", (str(tmp_path / "in"),)

    class Dying(store.Store):
        def replace(self, *a, **k):
            super().replace(*a, **k)
            raise RuntimeError("killed after the commit")

    with pytest.raises(Exception):
        ingest_stream(spark, *args, Dying(spark, place), f"{tmp_path}/ck", once=True).awaitTermination(120)
    s = store.Store(spark, place)
    first, ids = s.manifest, {(r.doc_path, r.chunk_id) for r in s.chunks().collect()}
    assert s.version == 3 and len(ids) == 3
    assert ingest_stream(spark, *args, s, f"{tmp_path}/ck", once=True).awaitTermination(120)
    assert s.manifest == first and {(r.doc_path, r.chunk_id) for r in s.chunks().collect()} == ids
    (tmp_path / "in" / "new.txt").write_text("later")
    assert ingest_stream(spark, *args, s, f"{tmp_path}/ck", once=True).awaitTermination(120)
    assert s.version == 4 and s.chunks().count() == 4


def test_documents_are_converted_once(spark, tmp_path):
    import zipfile

    calls = tmp_path / "calls"
    calls.mkdir()

    def counted(path, content):
        (calls / f"{os.path.basename(path)}-{os.urandom(4).hex()}").touch()
        return convert(path, content)

    (tmp_path / "a.txt").write_text("one|two")
    (tmp_path / "same.txt").write_text("one|two")
    (tmp_path / "c.txt").write_text("broken")
    (tmp_path / "e.txt").write_text("")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in.txt", "six")
    paths = [str(tmp_path / n) for n in ("a.txt", "c.txt", "z.zip", "same.txt", "e.txt")]
    cache = ParseCache(spark, f"file://{tmp_path}/cache")
    load = lambda c, p=paths: load_documents(spark, p, counted, c, 4096).first()
    one = load(cache)
    assert one.text == "=== a.txt ===\none\ntwo\n\n\n=== in.txt ===\nsix\n\n\n=== same.txt ===\none\ntwo\n\n\n=== e.txt ===\n"
    assert list(one.names) == ["a.txt", "c.txt", "in.txt", "same.txt", "e.txt"] and one.failed == 1 and one.fits_in_one_chunk
    n = len(os.listdir(calls))
    assert n == 4  # equal contents once
    again = ParseCache(spark, f"file://{tmp_path}/cache")
    assert load(again) == one and len(os.listdir(calls)) == n
    text = load_text(spark, [p for p in paths if "c.txt" not in p], 4096).first()
    assert text.doc_hash != one.doc_hash
    with pytest.raises(ValueError):
        load_documents(spark, [], counted, cache, 4096)


def test_parse_cache_keeps_the_most_recent_within_its_capacity(spark, tmp_path):
    cache = ParseCache(spark, f"file://{tmp_path}/c", capacity=100)
    put = lambda *rows: cache.put(spark.createDataFrame([(h, t, e) for h, t, e in rows], "file_hash string, text string, error string"))
    held = lambda c: {r.file_hash: (r.text, r.error, r.bytes) for r in c.entries().collect()}
    put(("a", "x" * 40, None))
    put(("b", "y" * 40, None), ("huge", "z" * 101, None), ("bad", None, "no"))
    assert set(held(cache)) == {"a", "b", "bad"} and held(cache)["bad"] == (None, "no", 0)
    cache.touch(spark.createDataFrame([("a",), ("unknown",)], "file_hash string"))
    log = cache.log
    put(("c", "é" * 20, None))  # 40 bytes: b goes, which was used longest ago
    assert cache.log != log and set(held(cache)) >= {"a", "c"} and "b" not in held(cache) and "unknown" not in held(cache)
    assert held(ParseCache(spark, f"file://{tmp_path}/c")) == held(cache)
    assert cache.compact(always=True) and "a" in held(cache)


def test_paths_are_taken_as_they_are(spark, tmp_path):
    for name in ("a[1].txt", "a1.txt", "{b,c}.txt"):
        (tmp_path / name).write_text(name)
    got = files.read_files(spark, [str(tmp_path / "a[1].txt"), str(tmp_path / "{b,c}.txt")]).orderBy("pos").collect()
    assert [bytes(r.content).decode() for r in got] == ["a[1].txt", "{b,c}.txt"]
    assert json.dumps(files.literal_path("a[1]*?{}")) == json.dumps(r"a\[1\]\*\?\{\}")
