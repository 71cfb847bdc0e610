"""Archives, chat formatting, pseudonyms."""

import datetime
import gzip
import hashlib
import re

import pytest
from . import brute
from .brute import archive
from pyspark.sql import functions as F

from lectern.llm import chat, pii
from lectern.llm import archive as ar


# --- archives ------------------------------------------------------------------------------


def test_pages(spark):
    big = "<p>" + "x" * 200 + "</p>"
    rows = [(5, "http://a/ b\n", big), (3, None, big), (9, "http://c", big), (1, "http://d", "tiny"), (2, "http://d", "tiny"), (4, "u", None), (6, "u", "é\r\n\r\nWARC/1.1\r\n" * 9), (None, "u", big), (7, "u", ""), (8, "u", "é" * 50), (10, "u", "é" * 50)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, refers_to long").drop("refers_to").repartition(3)
    got = ar.archive_pages(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(archive([(i, h) for i, _, h in rows]), key=repr)


def test_repeated_ids(spark):
    """Rows with one id and several payloads are records of their own, told apart by digest."""
    a, b, c = "a" * 150, "b" * 150, "c" * 150
    rows = [(1, a), (2, b), (5, a), (5, b), (6, a), (6, c), (2, b), (None, a), (None, a), (7, c), (7, None), (7, "x"), (8, "x")]
    df = spark.createDataFrame([(i, "u", h, 1, 1) for i, h in rows], "page_id long, url string, html string, digest long, first long").repartition(3)
    got = ar.archive_pages(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(archive(rows), key=repr)
    ids = [r.record_id for r in ar.archive_pages(df).where("page_id = 6").collect()]
    assert len(set(ids)) == 2


def test_pages_empty(spark):
    assert ar.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc_versions(version):
    doc = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>\n\nhttp://x 0.0.0.0\n</p>"
    data = ar.write_arc("t.arc", iter([(b"http://x/a", "20010203040506", "text/html", doc), (b"http://x/b", "2001", "text/plain", b"no head")]), version)
    one, two = ar.read_arc(data)
    assert (one.headers["url"], one.block, two.block) == ("http://x/a", doc, b"no head")
    made = [r for x in ar.convert_arc(data) for r in ar.read_warc(x + b"\r\n")]
    assert [r.headers["WARC-Type"] for r in made] == ["response", "resource"]
    assert made[0].headers["WARC-Date"] == "2001-02-03T04:05:06Z" and made[1].headers["WARC-Date"] == "2001-01-01T00:00:00Z"
    assert made[0].headers["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b"<p>\n\nhttp://x 0.0.0.0\n</p>").hexdigest()
    assert re.fullmatch("<urn:uuid:[0-9a-f-]{36}>", made[0].headers["WARC-Record-ID"])
    assert list(ar.convert_arc(data)) == list(ar.convert_arc(data))  # a repeated task writes the same


def test_arc_faults():
    data = ar.write_arc("t.arc", iter([(b"http://x", "20010203040506", "text/html", b"abcdef")]))
    cut = next(iter(ar.read_arc(data[:-4])))
    assert cut.truncated and b"WARC-Truncated: length" in next(iter(ar.convert_arc(data[:-4])))
    with pytest.raises(ValueError):
        list(ar.read_arc(b"http://x 1 2\nabc"))
    with pytest.raises(ValueError):
        list(ar.read_arc(data.replace(b"\n1 0 Reserved", b"\n7 0 Reserved")))


def test_gzip_members():
    one = ar.warc_record({"WARC-Type": "resource"}, b"x" * 300_000) + b"\r\n"
    data = gzip.compress(one) + gzip.compress(one.replace(b"x", b"y"))
    assert [r.block[:1] for r in ar.read_warc(data)] == [b"x", b"y"]


# --- chat ----------------------------------------------------------------------------------


def test_escapes_undo():
    for t in ("", "\\", "\\60;", "<|im_end|>", "<<|im_end|>>", "a</s>[INST] b [/INST]<s><s>", "<<SYS>>\\<</SYS>>", "\\\\<|im_start|>user\n"):
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)


def test_white_space_and_comments():
    run = lambda src, **v: chat.compile_template(src)(**v)[0]
    assert run("a {%- if true -%} b {%- endif %} c") == "ab c"
    assert run("a {{- 'x' -}} b{# note }} %} #} c {#- gone -#} d") == "axb cd"
    assert run("{{ '}}' }}{{ \"%}\" ~ '{{' }}{% if '%}' == '%}' %}y{% endif %}") == "}}%}{{y"
    assert run("{%- for x in xs -%}\n {{ x }} \n{%- endfor -%}\n", xs=[1, 2]) == "12"
    assert run("{{ 7 % 4 - 1 }}") == "2"


@pytest.mark.parametrize(
    "source",
    ["{{ '%999999999d' % 1 }}", "{{ 1 % 0 }}", "{{ " + "(" * 5000 + "1" + ")" * 5000 + " }}", "{% if true %}" * 3000 + "{% endif %}" * 3000, "{{ " + "not " * 9000 + "1 }}", "{{ " + "9" * 6000 + " }}", "{# open", "{{ 'open }}", "{% if true", "{{ 1 < 'a' }}", "{{ 1 | length }}", "{{ none + 1 }}", "{% endif now %}", "{% generation x %}{% endgeneration %}", "{{ " + "~".join(["'" + "x" * 1000 + "'"] * 2000) + " }}", "{% for x in 'abc' %}{% endfor %}", "{% set a = 4611686018427387904 %}{{ a + a }}", "{{ m[n] }}"],
)
def test_faults_are_template_errors(source):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source)(m={}, xs=[])


def test_templates_cannot_reserve_memory():
    rows = [{"role": "user", "text": "ab"}] * 60
    for source in ("{% set a = 'xxxxxxxx' %}" + "{% set a = a ~ a %}" * 60 + "{{ a }}", "{% for a in xs %}" * 5 + "x" + "{% endfor %}" * 5, "{% set a = xs[0].text %}{% for x in xs %}{{ a }}{{ a ~ a ~ a }}{% endfor %}" + "{% set a = a ~ a ~ a ~ a %}" * 40):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(source)(xs=rows)


def test_language():
    run = lambda src, **v: chat.compile_template(src)(**v)[0]
    assert run("{{ 1 + 2 }}{{ 'a' ~ 'b' | upper }}") == "3aB"
    assert run("{% for x in xs %}{{ loop.index }}{{ x.k }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[{"k": "a"}, {"k": "b"}]) == "1a,2b"
    assert run("{% set a = xs[1] %}{% if a == 'q' %}1{% elif a == 'r' %}2{% else %}3{% endif %}", xs=["p", "r"]) == "2"
    assert run("{{ 'y' if n > 1 and 'a' in 'cab' else 'n' }}", n=2) == "y"
    assert run("{{ none }}{{ missing['k'] }}", missing={}) == ""


def test_sandbox():
    for bad in ("{{ x.__class__() }}", "{{ x | eval }}", "{% import os %}", "{% for x in y %}", "{{ 'a }}", "{{ x( }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    with pytest.raises(chat.TemplateError):
        chat.compile_template("{{ x.__class__ }}")(x=object())
    with pytest.raises(chat.TemplateError):
        chat.compile_template("{{ nothing }}")()


def test_folding():
    folded = chat.fold(chat.parse("a{{ 'b' ~ (1 + 1) }}{% if 1 == 2 %}c{% else %}d{% endif %}"))
    assert folded == (chat.Emit(chat.Const("ab2d")),)
    with pytest.raises(chat.TemplateError):
        chat.compile_template("{{ 'a' + 1 }}")
    assert isinstance(chat.fold(chat.parse("{{ x ~ ('a' | upper) }}"))[0].expr.args[1], chat.Const)


def test_conversations(spark):
    rows = [(1, 0, "user", "hi <|im_end|>\n"), (1, 1, "assistant", "yes\\"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 3, "assistant", ""), (2, 5, "assistant", "[INST]"), (2, 4, None, "x"), (None, 1, "us\ner", "q"), (3, None, "system", "s")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted long").repartition(4)
    got = {r.conv_id: r for r in chat.digest_formatted(chat.format_conversations(df)).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(([t if t is not None else -1, a or "", b or ""] for c, t, a, b in rows if c == conv))
        turns = "".join(f"{a}\n{b}\n" for _, a, b in mine)
        loss = "".join(b for _, a, b in mine if a == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(turns.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    empty = chat.format_conversations(df.limit(0))
    assert chat.digest_formatted(empty).count() == 0


# --- pseudonyms ----------------------------------------------------------------------------

TEXTS = [
    "call +1 (017) 555-7713, 030-555-1234 or (212) 555-0000; mail the.9@mail9.example.com!!",
    "card 4952935900253052 and 4242 4242 4242 4242 and 3782-822463-10005, not 1234567890123456",
    "ip 97.51.17.173 but not 999.1.1.1 or 1.2.3.4.5",
    'token = "3b0b3c6a43eb78aa99cbd7049c572391524f37a8" TOKEN = "04DBEBAB91AB85687D33"!! password=135299847ac0e0f0dc api_key: Zz9_abcDEF12',
    "born 1984-02-29, not 1984-02-30; 29.02.1984 12/31/1999 31/12/1999; ssn 123-45-6789, not 000-12-3456",
    "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, not DE88370400440532013000",
    "License, version 3. CC BY-NC 4.0; nothing here at 10:30 on page 12",
    "",
    None,
]
CLEAN = ("not 1234567890123456", "not 999.1.1.1 or 1.2.3.4.5", "not 1984-02-30", "not 000-12-3456", "not DE88370400440532013000")


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, _swap long")


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0


def test_pseudonyms(spark, texts):
    got = {r.doc_id: r for r in pii.pseudonymise(texts, pii.key_table(spark, "k")).collect()}
    out = [got[k].text for k in range(len(TEXTS))]
    for value in ("555-7713", "555-1234", "the.9", "4952935900253052", "4242 4242", "97.51.17.173", "3b0b3c6a", "04DBEBAB", "135299847ac0e0f0dc", "Zz9_abcDEF12", "1984-02-29", "29.02.1984", "123-45-6789", "3704 0044", "12345698765432"):
        assert not any(value in (t or "") for t in out), value
    for kept in CLEAN:
        assert any(kept in (t or "") for t in out), kept
    assert out[6:] == TEXTS[6:] and [list(got[k].pii) for k in (6, 7, 8)] == [[], [], []]
    assert [len(a or "") for a in out] == [len(t or "") for t in TEXTS]
    shape = lambda t: re.sub("[0-9a-z]", "x", (t or "").lower())
    assert [shape(a) for a in out] == [shape(t) for t in TEXTS]
    assert all(luhn(x) for x in re.findall(r"card (\d{16})|(?:and )(\d{4} \d{4} \d{4} \d{4})", out[1])[0] if x)
    for d in re.findall(r"\d{4}-\d\d-\d\d", out[4].split(",")[0]):
        datetime.date.fromisoformat(d)
    assert got[0]._swap == 1


def test_same_values_link(spark):
    rows = [(1, "x 4952935900253052 y"), (2, "4952-9359-0025-3052"), (3, "A.B@Mail.Example.com"), (4, "a.b@mail.example.com"), (5, "1984-02-29"), (6, "29.02.1984")]
    out = [r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), pii.key_table(spark, "k")).orderBy("doc_id").collect()]
    digits = lambda t: re.sub(r"\D", "", t)
    assert digits(out[0]) == digits(out[1]) and out[2] == out[3]
    assert datetime.date.fromisoformat(out[4]) == datetime.datetime.strptime(out[5], "%d.%m.%Y").date()


def test_long_secrets(spark):
    """A secret of any length is replaced to its end."""
    value = "".join(pii.ALNUM[(k * k + k // 7) % 62] for k in range(20000))
    rows = [(n, f"x {label}{value[:n]} end") for n, label in ((512, "token="), (513, "token="), (1600, "private_key="), (20000, "secret: "))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    done = pii.pseudonymise(docs, pii.key_table(spark, "k"))
    for r, (n, text) in zip(done.orderBy("doc_id").collect(), rows):
        head = text.index(value[:8])
        assert (len(r.text), r.text[:head], r.text[-4:], list(r.pii)) == (len(text), text[:head], " end", ["secret"])
        assert not any(value[k : k + 12] in r.text for k in range(0, n - 12, 12))
    assert [r.text for r in pii.pseudonymise(done.drop("pii"), pii.key_table(spark, "k"), undo=True).orderBy("doc_id").collect()] == [t for _, t in rows]


def test_undo(spark, texts):
    key = pii.key_table(spark, "k")
    back = pii.pseudonymise(pii.pseudonymise(texts, key).drop("pii"), key, undo=True)
    assert [(r.text or "").lower() for r in back.orderBy("doc_id").collect()] == [(t or "").lower() for t in TEXTS]
    other = pii.pseudonymise(texts, pii.key_table(spark, "k2")).orderBy("doc_id").collect()
    assert other[1].text != pii.pseudonymise(texts, pii.key_table(spark, "k")).orderBy("doc_id").collect()[1].text


def test_permutations(spark):
    three = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    assert three.select(pii.feistel(F.col("v"), pii.DIGITS, F.lit("k"), "t").alias("p")).distinct().count() == 1000
    days = spark.range(pii.DAYS[0] * pii.DAYS[1]).select(pii.feistel_number(F.col("id"), *pii.DAYS, F.lit("k"), "t").alias("p"))
    assert tuple(days.agg(F.count_distinct("p"), F.min("p"), F.max("p")).first()) == (73000, 0, 72999)


def test_native(spark, texts, empty):
    done = pii.pseudonymise(texts, pii.key_table(spark, "very-secret"))
    shown = done._jdf.queryExecution().toString() + done._jdf.queryExecution().stringWithStats()
    assert not re.search("Python|Pandas|Arrow", shown) and "very-secret" not in shown
    assert pii.pseudonymise(empty, pii.key_table(spark, "k")).count() == 0


def test_against_plain_python(spark, texts, sf):
    """All documents of the smallest tables, and the odd texts, as plain Python replaces them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(texts.select((-F.col("doc_id") - 1).alias("doc_id"), "text"))
    rows = {r.doc_id: r for r in pii.pseudonymise(docs, pii.key_table(spark, "k")).collect()}
    some = 0
    for r in docs.collect():
        text, kinds = brute.pseudonymise(r.text, "k")
        assert (rows[r.doc_id].text, list(rows[r.doc_id].pii)) == (text, kinds), r.doc_id
        some += len(kinds)
    assert some > 40


def test_long_texts_of_every_mark(spark):
    """A megabyte of each mark, or of pairs of them, neither fails nor takes long."""
    units = ["@", ".", "a.", "1.", "a@", "@a.", "1-", "1 ", "+1 ", "(1", "A1", "AB12 ", "x.1", "token=", "'", "=", "-", "/", "1/", "12.", "é", "\n", "a@b.c1.", "a@b.co "]
    rows = [(k, u * (1_000_000 // len(u))) for k, u in enumerate(units)] + [(100, "x@" + "ab1." * 250_000 + "com end"), (101, "x@" + "ab1." * 250_000), (102, "a@" + "com." * 250_000 + "1")]
    done = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), pii.key_table(spark, "k"))
    got = {r.doc_id: r for r in done.collect()}
    assert all(len(got[k].text) == len(t) for k, t in rows)
    assert list(got[100].pii) == ["email"] and got[100].text[-8:] == ".com end" and list(got[101].pii) == []
    assert list(got[102].pii) == ["email"] and got[102].text[-6:] == ".com.1"
