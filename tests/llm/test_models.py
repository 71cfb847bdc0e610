"""Quality scores by held-out accuracy, nearest neighbours by recall, and the pipeline."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import hashing, quality


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.97
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_folds(spark):
    rows = spark.createDataFrame([(k,) for k in range(50)] + [(None,)], "doc_id long").select("doc_id", quality.fold(F.col("doc_id")).alias("f")).collect()
    import zlib

    assert [r.f for r in rows] == [zlib.crc32(str(r.doc_id).encode()) % 3 if r.doc_id is not None else 0 for r in rows]


def test_held_out_labels_teach_nothing(spark, docs):
    import zlib

    ids = [k for k in range(60)]
    one = [(k, k % 2, 0) for k in ids]
    two = [(k, (k % 2) ^ (zlib.crc32(str(k).encode()) % 3 == 1), 0) for k in ids]
    a, b = (quality.classify(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).orderBy("doc_id").collect() for x in (one, two))
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_quality_odd_tables(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in quality.classify(docs, none).collect()} == {(0.5, 1)}
    assert quality.classify(empty, none).count() == 0
    assert quality.keep_good(docs, none).count() == docs.count()
    only = spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(1, 0, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, only).collect())
    assert quality.keep_good(docs, only).columns == docs.columns


def test_risk_falls_with_the_prior():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (400, 5)), rng.normal(-1, 1, (400, 5))
    mixed = np.concatenate([good[:200], bad[:200]])
    model = quality.fit(good[200:].astype(np.float32), mixed.astype(np.float32), 0.5)
    assert model.score(good).mean() > 0.8 and model.score(bad).mean() < 0.2


def test_risk_is_that_of_the_rows():
    """Value and gradient of the risk over moments against sums over rows, for several priors."""
    rng = np.random.default_rng(2)
    good, mixed = rng.normal(0.3, 1, (50, 4)), rng.normal(0, 2, (300, 4))
    p, u = quality.Moments.of(good), quality.Moments.of(mixed)
    assert (quality.Moments.unpack((p + u).pack()).second == (p + u).second).all()
    mean, scale = mixed.mean(0), mixed.std(0)
    a, b = p.scaled(mean, scale), u.scaled(mean, scale)
    loss = lambda z, y: ((1 - y * z) ** 2 / 4).mean()

    def plain(w, prior):
        zp, zu = (((x - mean) / scale) @ w[:-1] + w[-1] for x in (good, mixed))
        return prior * loss(zp, 1), loss(zu, -1) - prior * loss(zp, -1)

    for prior in (0.1, 0.5, 0.9):
        for _ in range(5):
            w = rng.normal(size=5)
            plus, minus, g_plus, g_minus = quality.risk(w, a, b, prior)
            assert (plus, minus) == pytest.approx(plain(w, prior))
            for j in range(5):
                e = np.eye(5)[j] * 1e-5
                up, down = plain(w + e, prior), plain(w - e, prior)
                assert ((up[0] - down[0]) / 2e-5, (up[1] - down[1]) / 2e-5) == pytest.approx((g_plus[j], g_minus[j]), abs=1e-6)


def test_more_of_a_prior_keeps_more():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(1, 1, (600, 5)), rng.normal(-1, 1, (600, 5))
    mixed = np.concatenate([good[300:], bad[:300]])
    kept = [(quality.fit(good[:300], mixed, prior).score(mixed) >= 0.5).mean() for prior in (0.2, 0.4, 0.6, 0.8)]
    assert kept == sorted(kept) and kept[0] < 0.45 < 0.55 < kept[-1]


def test_the_bracket_isnt_fitted_below_nothing():
    rng = np.random.default_rng(4)
    few, mixed = rng.normal(0.5, 1, (8, 40)), rng.normal(0, 1, (60, 40))
    p, u = quality.Moments.of(few), quality.Moments.of(mixed)
    model = quality.fit_moments(p, u, 0.6, decay=1e-4)
    a, b = p.scaled(model.mean, model.scale), u.scaled(model.mean, model.scale)
    loose = np.linalg.solve(b / 2 + 2e-4 * np.eye(41), 0.6 * a[-1] - b[-1] / 2)
    assert quality.risk(loose, a, b, 0.6)[1] < -0.5  # what the unbiased risk alone would do
    assert quality.risk(np.append(model.weights, model.bias), a, b, 0.6)[1] > -0.05


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.8])
def test_prior_from_unlabelled_scores(prior):
    rng = np.random.default_rng(5)
    n = 20_000
    scores = np.where(rng.random(n) < prior, rng.normal(1, 0.4, n), rng.normal(-1, 0.4, n))
    got = quality.estimate_prior(quality.histogram(scores), quality.histogram(rng.normal(1, 0.4, 500)))
    assert got == pytest.approx(prior, abs=0.05)


def test_negative_labels_teach_nothing(spark, docs):
    labels = [(k, k % 2, 0) for k in range(60)]
    other = [x for x in labels if x[1] == 1]
    a, b = (quality.classify(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).orderBy("doc_id").collect() for x in (labels, other))
    assert sorted(map(repr, a)) == sorted(map(repr, b))


# --- neighbours ----------------------------------------------------------------------------


def brute(rows, k):
    rows = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in rows:
        if i % 20 == 0:
            scored = sorted((-float((v * q).sum()), j) for j, v in rows if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16))
    rows = []
    for i in range(1200):
        v = centres[i % 8] + rng.normal(size=16) * 0.4 if i % 2 else rng.normal(size=16)
        rows.append((i, [float(np.float32(x)) for x in v * rng.uniform(0.5, 2)]))
    rows += [(2000 + k, rows[20][1]) for k in range(300)]  # a common vector
    rows += [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] + [1.0] * 15), (5060, [float("inf")] + [1.0] * 15), (5080, [None] + [1.0] * 15), (5100, [1.0] * 5), (5120, [])]
    return rows


def test_neighbours(spark, vectors):
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, rank int").repartition(3)
    got = {}
    for r in hashing.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    want = brute(vectors, 20)
    assert set(got) == set(want)
    exact = {i: np.array(v, float) for i, v in vectors if v}
    right = 0
    for q, found in got.items():
        assert [r for *_, r in found] == list(range(1, 21))
        assert [(-s, j) for j, s, _ in found] == sorted((-s, j) for j, s, _ in found)
        assert all(s == (exact[j] * exact[q]).sum() for j, s, _ in found)
        right += len({j for j, *_ in found} & {j for j, _ in want[q]})
    assert right / (20 * len(want)) >= 0.9


def test_recall_on_the_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    right = total = 0
    got = hashing.search(df, F.col("vec_id") % 20 == 0, need=200).toPandas().groupby("query_id").vec_id.apply(set)
    for q in ids[ids % 20 == 0]:
        s = (x * x[ids == q][0]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:20]
        right += len(set(ids[order]) & got[q])
        total += 20
    assert right / total >= 0.9


def test_every_code_in_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 256, (500, 16), np.uint8)
    codes[100:200] = codes[0]
    index = hashing.ByteIndex(codes)
    for q in (codes[0], codes[300] ^ np.uint8(1), rng.integers(0, 256, 16).astype(np.uint8)):
        far = np.bitwise_count(codes ^ q).sum(1)
        for need in (1, 50, 499, 5000):
            got = index.within(q, need)
            radius = far[got].max()
            assert set(got) == set(np.flatnonzero(far <= radius)) and len(got) >= min(need, 500)


@pytest.mark.parametrize("bits", [8, 16])
def test_substrings_of_either_length(bits):
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 256, (700, 32), np.uint8)
    codes[:300] = codes[0] ^ (rng.random((300, 32)) < 0.1).astype(np.uint8)
    index = hashing.ByteIndex(codes, bits)
    for q in (codes[0], codes[500], rng.integers(0, 256, 32).astype(np.uint8)):
        far = np.bitwise_count(codes ^ q).sum(1)
        seen = np.zeros(700, bool)
        for rows, d, radius in index.probe(q):
            assert not seen[rows].any() and (far[rows] == d).all()
            seen[rows] = True
            assert seen[far <= radius].all()


def clustered(n, clusters, seed=7, size=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, size))
    x = centres[rng.integers(0, clusters, n)] + rng.normal(scale=0.15, size=(n, size))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_few_rows_are_touched_where_neighbours_are_near():
    x = clustered(12_000, 200)
    largest = 1.0 + 1e-9
    coder = hashing.fit(x[:4000], largest)
    index, codes = hashing.ByteIndex(coder.codes(x, False), 16), coder.codes(x[:200], True)
    right = 0
    for j in range(200):
        rows, score = index.nearest(codes[j], 20, hashing.NEED, lambda r: x[r] @ x[j])
        exact = set(np.argsort(-(x @ x[j]), kind="stable")[:20].tolist())
        right += len(exact & set(rows[np.argsort(-score, kind="stable")[:20]].tolist()))
    assert right / (200 * 20) >= 0.9
    assert index.touched / (200 * len(x)) < 0.1


def test_several_blocks_and_query_groups(spark, monkeypatch):
    monkeypatch.setattr(hashing, "BLOCK", 1500)
    monkeypatch.setattr(hashing, "QUERIES", 60)
    monkeypatch.setattr(hashing, "SAMPLE", 1000)
    x = clustered(4000, 40, size=24)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = hashing.search(df, F.col("vec_id") % 20 == 0).toPandas().groupby("query_id").vec_id.apply(list)
    right = sum(len(set(got[q]) & set([j for j in np.argsort(-(x @ x[q]), kind="stable") if j != q][:20])) for q in range(0, 4000, 20))
    assert len(got) == 200 and all(len(v) == 20 for v in got) and right / (200 * 20) >= 0.9


@pytest.mark.parametrize("scale", [1e200, 1e-200])
def test_components_of_any_size(spark, scale):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8)) * scale
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = hashing.search(df, F.col("vec_id") == 0).orderBy("rank").collect()
    with np.errstate(over="ignore", invalid="ignore"):
        assert len(got) == 20 and all(r.score == (x[r.vec_id] * x[0]).sum() or math.isnan(r.score) for r in got)


def test_few_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert hashing.search(spark.createDataFrame([], kind), F.col("vec_id") >= 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0])], kind)
    assert hashing.search(one, F.col("vec_id") >= 0).count() == 0
    three = spark.createDataFrame([(0, [1.0, 2.0]), (0, [0.5, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)
    got = [tuple(r) for r in hashing.search(three, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 4.5), (0, 2, 2, 4.5)]


# --- pipeline ------------------------------------------------------------------------------


def test_pipeline(spark):
    from .brute import contamination, links, pseudonymise

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf)
        rows = [(r.doc_id, r.text) for r in now.collect()]
        if name == "quality":
            good = quality.classify(now, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1")
            want = {r.doc_id for r in good.collect()}
        elif name == "near_duplicates":
            want = {i for i, _, low, _ in links(rows) if i == low}
        elif name == "contamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            want = {r[0] for r in contamination(rows, items) if not r[-1]}
        else:
            want = {i for i, _ in rows}
        assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(want), name
        if name == "privacy":
            assert {r.doc_id: r.text for r in out.collect()} == {i: pseudonymise(t, "lectern")[0] for i, t in rows}
        if name != "encoding":
            assert out.columns == docs.columns
            now = out.cache()
    assert out.where("not exact").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == want


def test_pipeline_decides_by_each_rows_own_text(spark, tmp_path):
    """Repeated and null ids, and columns named like inner ones, against brute force."""
    from .brute import contamination, links

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(corpus_pipeline.STAGES)
    rng = np.random.default_rng(12)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))
    base, other, item = text(60), text(60), text(12)
    near = base.split()
    near[-1] = "zzzzz"
    rows = [(1, base), (1, other), (2, " ".join(near)), (3, other), (None, base), (None, text(30)), (None, None), (4, None), (5, ""), (5, ""), (6, f"{text(5)} {item}"), (6, text(20)), (None, f"{item} {text(3)}"), (7, base)]
    extra = ["_key1", "_key2", "_pii", "s1", "component"]
    docs = spark.createDataFrame([(*r, *[k] * len(extra)) for k, r in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{c} long" for c in extra)).repartition(3)
    items = [("i", item)]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    # Of each group of linked rows that with the smallest id stays, once; rows without words stay.
    found = stages["near_duplicates"](spark, docs, str(tmp_path))
    assert found.columns == docs.columns
    low = links(rows)
    groups = {}
    for k, (i, t) in enumerate(rows):
        if low[k][1]:  # it has shingles
            sets = {frozenset(tuple((t or "").split()[p : p + 5]) for p in range(max(1, len((t or "").split()) - 4)))}
            groups.setdefault(next(iter(sets)), []).append(k)
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in found.collect())
    clusters = []  # classes of equal sets, joined where they are near
    for s, members in groups.items():
        near_to = [c for c in clusters if any(100 * len(s & o) >= 75 * len(s | o) for o in c[0])]
        merged = ([s], list(members))
        for c in near_to:
            clusters.remove(c)
            merged = (merged[0] + c[0], merged[1] + c[1])
        clusters.append(merged)
    want = [(i, t) for k, (i, t) in enumerate(rows) if not low[k][1]]
    for _, members in clusters:
        ids = [rows[k][0] for k in members]
        best = min(((i is None, i or 0) for i in ids))
        want.append((None if best[0] else best[1], None))
    assert sorted((i is None, i or 0) for i, _ in want) == sorted(x[:2] for x in kept)
    for _, members in clusters:
        assert sum((r[2] in {rows[k][1] for k in members}) for r in kept) == 1

    clean = stages["contamination"](spark, docs, str(tmp_path))
    hit = contamination(rows, items)
    assert clean.columns == docs.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in clean.collect()))) == sorted(map(repr, (r for r, h in zip(rows, hit) if not h[-1])))
    assert stages["privacy"](spark, docs, str(tmp_path)).columns == docs.columns


def test_pipeline_odd_rows(spark, corpus, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name, df in (("documents", spark.createDataFrame([(i, t, "en", "s", 1) for i, t in corpus], "doc_id long, text string, lang string, source string, n_chars long")), ("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.doc_id == 508 for r in out) <= 1 and len({r.doc_id for r in out if r.doc_id is not None}) == sum(r.doc_id is not None for r in out)
    (spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
