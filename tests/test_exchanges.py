"""Bytes that scans and prefix comparisons exchange, and the latter's results."""

import io
import random
import string
import zipfile

from pyspark.sql import functions as F

from lectern.operators import caches, ordered, rope
from lectern.sources import files


def exchanged(spark, run):
    """Bytes that the stages of a run wrote to exchanges."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = lambda: {s.stageId(): s.shuffleWriteBytes() for s in (lambda x: [x.apply(k) for k in range(x.size())])(store.stageList(None, False, False, none, None))}
    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


def noise(rng, n):
    return "".join(rng.choices(string.ascii_letters + string.digits, k=n))


def test_scans_exchange_rows_once(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), k, noise(rng, 2000)) for k in range(500)]
    table = spark.createDataFrame(rows, "g string, k int, t string")
    for scan in (lambda: ordered.segmented_sum(table, F.char_length("t"), "g", "k"), lambda: ordered.segmented_last(table, {"seen": F.col("k")}, "g", "k")):
        assert exchanged(spark, lambda scan=scan: scan().write.format("noop").mode("overwrite").save()) < 1.3e6


def test_extended_exchanges_blocks_not_texts(spark):
    rng = random.Random(5)
    base = [noise(rng, 3000) for _ in range(40)]
    texts = {f"{k}-{v}": t + "x y " * 10 * v for k, t in enumerate(base) for v in range(8)}
    texts |= {"short": base[0][:90], "part": base[0][:130], "late": base[0][:1400] + noise(rng, 400), "same": base[0], "cut": base[0] + "x y"}
    pairs = [(f"{k}-{a}", f"{k}-{b}") for k in range(40) for a in range(8) for b in range(8) if a != b]
    pairs += [(a, b) for a in ("short", "part", "late", "same", "cut", "0-0", "0-3", "1-0", "absent") for b in ("short", "part", "late", "same", "cut", "0-0", "0-3") if a != b and (a, b) != ("0-3", "0-0") and (a, b) != ("0-0", "0-3")]
    table = spark.createDataFrame(list(texts.items()), "doc string, text string")
    asked = spark.createDataFrame(pairs, "new string, old string")
    got = []
    size = exchanged(spark, lambda: got.extend(tuple(r) for r in caches.extended(asked, table, "new", "old", 100, 0.5).collect()))
    want = set()
    for new, old in pairs:
        if new in texts and old in texts:
            a, b = texts[new], texts[old]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            if len(b) >= 100 and n >= max(100, len(b) * 0.5) and n < len(a):
                want.add((new, old, n, len(a) - n))
    assert set(got) == want and len(got) == len(want) > 1000
    assert size < sum(map(len, texts.values()))


def test_corpus_chunks_exchange_texts_twice(spark):
    rng = random.Random(7)
    rows = [("g", k, " ".join(noise(rng, 9) for _ in range(250))) for k in range(400)]
    table = spark.createDataFrame(rows, "g string, k int, t string")
    size = exchanged(spark, lambda: rope.split_corpus(table, "g", "k", most=800, text="t").write.format("noop").mode("overwrite").save())
    assert size < 2.5e6


def test_archives_are_made_and_read_in_one_pass(spark, tmp_path):
    """Files that a costly step makes are made once, and other files keep their rows."""
    made = spark.sparkContext.accumulator(0)

    def make(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, body in (("a.txt", "é"), ("d/", ""), ("n.ZIP", "x"), ("../b", "x"), ("e", "")):
            z.writestr(name, body)
    rows = [("/x/one.ZIP", 0, raw.getvalue()), ("/x/plain.txt", 1, b"t"), ("/x/none", 2, None), ("two.zip", 3, raw.getvalue())]
    table = spark.createDataFrame(rows, "path string, pos int, content binary").mapInArrow(make, "path string, pos int, content binary")
    got = {(r.path, r.pos, r.name, None if r.content is None else bytes(r.content)) for r in files.expand_zips(table).collect()}
    inside = [("a.txt", "é".encode()), ("e", b"")]
    assert got == {(p, k, *e) for p, k in (("/x/one.ZIP", 0), ("two.zip", 3)) for e in inside} | {("/x/plain.txt", 1, "plain.txt", b"t"), ("/x/none", 2, "none", None)}
    assert made.value == len(rows)
