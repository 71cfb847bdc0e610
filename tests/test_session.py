"""Context reuse of sessions agrees with a loop that carries the state from event to event."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import ordered, session


def test_segmented_last(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("ab"), k, rng.randint(0, 9) if rng.random() < 0.2 else None) for k in range(400)] + [(None, 1000, 5), (None, 1001, None)]
    got = ordered.segmented_last(spark.createDataFrame(rows, "g string, k int, v int").repartition(6), {"seen": F.col("v"), "at": F.when(F.col("v").isNotNull(), F.col("k"))}, "g", "k").collect()
    last, want = {}, {}
    for g, k, v in rows:
        want[g, k] = last.get(g, (None, None))
        if v is not None:
            last[g] = (v, k)
    assert {(r.g, r.k): (r.seen, r.at) for r in got} == want and len(got) == len(rows)


def loop(events, texts, mode, reuse=lambda at: True, least=20, share=0.5):
    cache, current, last, out = {}, {}, {}, {}
    for key, who, at, kind, doc in sorted(events, key=lambda e: e[2]):
        kept = cache.setdefault(key, set())
        now = current.get((key, who))
        if kind == "load":
            if now and now["doc"] != doc:
                kept.discard(now["doc"])
            current[key, who] = {"doc": doc, "warm": doc in kept, "active": False}
            continue
        if not now:
            out[at] = ("refused", "", None)
            continue
        doc, tier, left = now["doc"], "cold", None
        if mode != "raw":
            before = last.get(key)
            if now["active"]:
                tier = "memory"
            elif now["warm"]:
                tier = "cache" if mode == "swap" or reuse(at) else "cold"
            elif before is not None and before != doc and before in kept and texts.get(doc) is not None and texts.get(before) is not None:
                a, b = texts[doc], texts[before]
                n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                if n >= least and n >= len(b) * share and n < len(a):
                    tier, left = "prefix", len(a) - n
            if tier != "memory":
                last[key] = doc
            now["active"] = True
            kept.add(doc)
        out[at] = (tier, session.CALLS[tier], left)
    return out


@pytest.fixture(scope="module")
def story():
    rng = random.Random(3)
    base = ["".join(rng.choice("ab c") for _ in range(60)) for _ in range(3)]
    texts = {f"{b}-{v}": base[b] + " more" * v for b in range(3) for v in range(4)}
    texts |= {"edit": base[0][:30] + "#" + base[0][31:], "short": base[0][:10] + "!" * 60, "tiny": base[0][:25], "null": None, "far": base[0][:22] + "z" * 80}
    docs = list(texts) + ["unknown"]
    events, at = [], 0
    for _ in range(700):
        at += rng.randint(1, 3)
        key, who = ("m1" if rng.random() < 0.7 else "m2"), ("hot" if rng.random() < 0.5 else rng.choice("xyz"))
        doc = rng.choice(docs) if rng.random() < 0.3 else f"{at // 300 % 3}-{at // 40 % 4}"
        events.append((key, who, at, "load", doc) if rng.random() < 0.5 else (key, who, at, "ask", None))
    return events, texts


@pytest.mark.parametrize("mode", ["swap", "raw", "adaptive"])
def test_contexts(spark, story, mode):
    events, texts = story
    odd = [("m1", "x", 10**6, None, "0-0"), (None, "x", 10**6 + 1, "ask", None), ("m1", "x", 10**6 + 2, "other", None)]
    table = spark.createDataFrame([(*e, 1, 2) for e in events + odd], "key string, session string, at long, kind string, doc string, tier int, op int").repartition(5)
    known = spark.createDataFrame(list(texts.items()), "doc string, text string")
    reuse = F.col("at") % 2 == 0 if mode == "adaptive" else None
    got = session.resolve_contexts(table, known, mode, reuse, least=20).collect()
    want = loop(events, texts, mode, lambda at: at % 2 == 0)
    assert {r["at"]: (r.tier, r.labels, r.suffix_chars) for r in got} == want and len(got) == len(want)
    if mode == "swap":
        assert {x[0] for x in want.values()} == set(session.CALLS)


def resolve(spark, events, texts, mode="swap"):
    table = spark.createDataFrame(events, "key string, session string, at long, kind string, doc string")
    known = spark.createDataFrame(list(texts.items()), "doc string, text string")
    return [(r.labels) for r in session.resolve_contexts(table, known, mode).orderBy("at").collect()]


def grown(first, second, mode="swap"):
    """One document asked about, then another in a new session, as after a restart."""
    events = [("m", "s1", 1, "load", "a"), ("m", "s1", 2, "ask", None), ("m", "s2", 3, "load", "b"), ("m", "s2", 4, "ask", None)]
    return events, {"a": first, "b": second}, mode


def test_prefix_reuse_and_its_refusals(spark):
    text = "word " * 600
    cases = {
        "prefix-reprime,answer": grown(text, text + "and something new"),
        "prime,answer": grown(text, "quite another text " * 200),
    }
    for labels, case in cases.items():
        assert resolve(spark, *case) == ["prime,answer", labels]
    assert resolve(spark, *grown(text, text[:30] + "another " * 400)) == ["prime,answer", "prime,answer"]  # too little in common
    assert resolve(spark, *grown(text, text + "more", "raw")) == ["prime,answer", "prime,answer"]
    assert resolve(spark, *grown(text, text[:2500])) == ["prime,answer", "prime,answer"]  # nothing to add


def test_switching_documents_evicts(spark):
    events = [("m", "s", 1, "load", "a"), ("m", "s", 2, "ask", None), ("m", "s", 3, "ask", None), ("m", "s", 4, "load", "a"), ("m", "s", 5, "ask", None), ("m", "s", 6, "load", "b"), ("m", "s", 7, "load", "a"), ("m", "s", 8, "ask", None)]
    assert resolve(spark, events, {"a": "x", "b": "y"}) == ["prime,answer", "answer", "answer", "prime,answer"]


@pytest.mark.parametrize("mode", ["swap", "raw"])
def test_chunk_reuse(spark, mode):
    rng = random.Random(5)
    chunks = {f"d{k}": [rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 6))] for k in range(9)}
    asks = [("m1" if rng.random() < 0.7 else "m2", at, rng.choice(list(chunks))) for at in range(60)]
    got = session.chunk_reuse(spark.createDataFrame(asks, "key string, at long, doc string"), spark.createDataFrame([(d, h) for d, hs in chunks.items() for h in hs], "doc string, content_hash string"), mode).collect()
    seen, want = set(), {}
    for key, at, doc in asks:
        n = 0
        for h in chunks[doc]:
            n += mode == "swap" and (key, h) in seen
            seen.add((key, h))
        want[at] = (doc, len(chunks[doc]), n)
    assert {r["at"]: (r.doc, r.chunks, r.reused) for r in got} == want
