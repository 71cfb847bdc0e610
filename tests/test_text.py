"""Text, vector and model functions against independent Python models and hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import models as M
from lectern.functions import text as T
from lectern.functions.identity import content_hash, context_key, set_hash
from lectern.functions.vectors import cosine


def split_model(text, most):
    if len(text) <= most:
        return [text.strip()]
    out, at = [], 0
    while at < len(text):
        if at + most >= len(text):
            piece, at = text[at:], len(text)
        else:
            window = text[at : at + most]
            cut = max((k for k in range(1, most) if window[k].isspace()), default=most)
            piece, at = window[:cut], at + cut
        if piece.strip():
            out.append(piece.strip())
    return out


@pytest.mark.parametrize("most", [2, 5, 40])
def test_bounded_split(spark, most):
    rng = random.Random(most)
    texts = ["".join(rng.choice("ab \n\té🙂　") for _ in range(rng.randint(0, 3 * most))) for _ in range(400)]
    texts += ["", " ", "   ", "word " * 50, "x" * 99]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    got = {r.k: list(r.p) for r in df.select("k", T.bounded_split(F.col("t"), most).alias("p")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == split_model(t, most), repr(t)
        assert all(len(p) <= most for p in got[k])


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_budgets(spark):
    assert one(spark, T.document_budget(F.lit(4096)), T.map_budget(F.lit(4096), F.lit(0.25)), T.map_budget(F.lit(128), F.lit(0.25)), T.token_estimate(F.lit("abc")), T.token_estimate(F.lit("x" * 11))) == (13104, 4096, 800, 1, 2)


def test_common_prefix(spark):
    rng = random.Random(2)
    pairs = [("", ""), ("a", ""), ("abc", "abd"), ("same", "same"), ("🙂é", "🙂è")] + [(("".join(rng.choice("ab") for _ in range(rng.randint(0, 30)))), "".join(rng.choice("ab") for _ in range(rng.randint(0, 30)))) for _ in range(100)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", T.common_prefix(F.col("a"), F.col("b")).alias("n")).collect():
        n = 0
        while n < min(len(r.a), len(r.b)) and r.a[n] == r.b[n]:
            n += 1
        assert r.n == n


def test_names(spark):
    assert one(spark, T.file_name(F.lit("a/b\\c.txt")), T.file_name(F.lit("a/")), T.file_stem(F.lit("x/ab.tar.gz")), T.workspace_name(F.lit("  my: ws!_1 ")), T.workspace_name(F.lit("x" * 200)), T.workspace_name(F.lit(" /. ")), T.workspace_name(F.lit("../../etc/passwd"))) == ("c.txt", "upload", "ab.tar", "my ws_1", None, None, "etcpasswd")


def test_questions(spark):
    assert one(spark, T.question_problem(F.lit("  ")), T.question_problem(F.lit("two　words")), T.question_problem(F.lit("who is it")), T.is_compound(F.lit("What is it? And who made it?")), T.is_compound(F.lit("What is it?"))) == ("empty", "too generic", None, True, False)
    assert one(spark, *(T.relevant(F.lit(x)) for x in ("NONE", "none", "NoNe", "", "NONE.", "x"))) == (False, False, False, False, True, True)


def test_identity(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",)], "h string")
    up, down = (df.orderBy(o).agg(set_hash(F.col("h")).alias("s")).first().s for o in (F.asc("h"), F.desc("h")))
    assert up == down and len(up) == 64
    assert one(spark, content_hash(F.lit("x")) == content_hash(F.lit("x").cast("binary")), context_key(F.lit("m"), F.lit(8), F.lit("h"))) == (True, "m|8|h")


def test_cosine(spark):
    v = lambda *x: F.array(*map(F.lit, x)).cast("array<float>")
    got = one(spark, cosine(v(1.0, 2.0), v(1.0, 2.0)), cosine(v(1.0, 0.0), v(0.0, 1.0)), cosine(v(1.0, 2.0), v(1.0)), cosine(v(0.0), v(1.0)), cosine(v(), v()), cosine(v(float("nan")), v(1.0)))
    assert got == (pytest.approx(1.0), 0, 0, 0, 0, 0)


def test_context_fit(spark):
    rows = [(8192, 15177374099, 163840, 22e9, 8192), (8192, 15177374099, 163840, 14e9, 4096), (393216, 15177374099, 163840, 2e9, 4096), (32768, 10**9, 36864, 80e9, 32768), (4000, 5, 0, 1e9, 4000), (2048, 10**9, 9, 1e9, 2048)]
    for ceiling, weights, kv, free, want in rows:
        assert one(spark, M.fit_context(F.lit(ceiling), F.lit(weights), F.lit(kv), F.lit(int(free)))) == (want,)
    assert one(spark, M.kv_bytes(F.lit(40), F.lit(8), F.lit(128)), M.fit_context(F.lit(7), F.lit(1), F.lit(1), F.lit(None).cast("bigint"))) == (163840, 7)
    assert one(spark, M.free_memory(F.lit("1000, 16000\n5, 6")), M.free_memory(F.lit("9, 4")), M.free_memory(F.lit("no card"))) == (15000 * 1048576, 0, None)


def test_modes(spark):
    with pytest.raises(ValueError):
        M.check_mode("fast")
    cases = [("raw", True, True, "cold"), ("swap", True, None, "reuse"), ("swap", False, True, "cold"), ("adaptive", True, True, "reuse"), ("adaptive", True, False, "cold"), ("adaptive", True, None, "cold")]
    for mode, cached, wins, want in cases:
        assert one(spark, M.resolution(F.lit(mode), F.lit(cached), F.lit(wins).cast("boolean"))) == (want,)
    swap, raw = M.swap_cost(F.lit(500), F.lit(2), F.lit(4.0), F.lit(1e9), F.lit(1.0), F.lit(10.0), F.lit(5.0), F.lit(1.0))
    assert one(spark, swap < raw) == (True,)


def test_answers(spark):
    a = lambda r, t: M.answer_text(F.lit(r), F.lit(t).cast("string"), T.utrim)
    got = one(spark, a(" yes ", "no"), a(" ", " hm "), a("", None), a("", " "))
    assert got[0] == "yes" and got[1].endswith("\n\nhm") and got[1].startswith("[the model ran out") and got[2:] == ("", "")
    assert one(spark, *(M.tier(F.lit(t), F.lit(r)) for t, r in ((0, 0), (3, 0), (3, 3), (7, 6)))) == ("cold", "cold", "adaptive-reuse", "adaptive-reuse-partial (6/7 chunks)")


def test_json_average(spark):
    got = one(spark, *(M.json_average(F.try_parse_json(F.lit(j))) for j in ("128", "[512, 512, 256]", "[1, \"x\", 2]", "[]", "\"a\"")))
    assert got[0] == 128 and got[1] == pytest.approx(426.67, abs=0.01) and got[2] == 1 and got[3:] == (None, None)
