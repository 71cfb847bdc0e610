"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

Emails, secrets, bank accounts, addresses, phone, card and social security numbers and dates are
found by one pattern, validated, and run through a keyed Feistel network over their own
characters. A value keeps its format (marks, length, check digits), equal values get equal
pseudonyms in every document, and whoever holds the key can undo them (emails come back in
lower case). Text between the matches stays byte for byte. Matches are rare, so the interpreted
expressions run rarely.

The key enters as the only cell of a table and is read by a scalar subquery, so it stands in no
plan, event log or UI page. Every loop of the pattern is possessive or bounded, and every step
over a value's characters is linear, so that texts of any length and shape are safe.

Defined results: a null text stays null with nothing found, an empty one stays empty; what looks
like a number or date but fails validation stays; an all-day permutation covers 1900-01-01 and
the 73,000 days from there, other dates stay; a value may by chance be its own pseudonym;
repeated rows are treated each; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
DIGITS, HEX, LOWER = "0123456789", "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz"
ALNUM = LOWER + LOWER[10:].upper()
#: Days from 1900-01-01 that dates are permuted among, as a product.
DAYS = (250, 292)

_TOP = r"[A-Za-z]{2,24}(?![A-Za-z0-9-])"

# Kinds in the order in which the pattern tries them. An address ends at its last label of 2 to 24
# letters; a greedy loop over labels would recurse for each of them.
PATTERNS = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:(?:\.(?!{_TOP})[A-Za-z0-9-]++)*+\.{_TOP})++",
    "secret": r"(?i:(?<![a-z0-9])(?:token|secret|passw(?:or)?d|passphrase|pwd|(?:api|access|auth|private)[_-]?key)\s{0,4}[=:]\s{0,4}[\"']?[a-z0-9+/_-]{8,}+)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "card": r"(?<![0-9A-Za-z])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5}|\d{13,19})(?![0-9A-Za-z])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "date": r"(?<![\d.-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d-])",
}
PATTERN = "|".join(PATTERNS.values())


def _kind(m: Column) -> Column:
    """The kind of a match, from its own characters (lookarounds no longer see the text)."""
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike("^[A-Za-z_-]+\\s*[=:]"), "secret")
        .when(m.rlike("^[A-Z]{2}"), "iban")
        .when(m.rlike("^(\\d{1,3}\\.){3}\\d{1,3}$"), "ip")
        .when(m.rlike("^(\\d{4}-\\d{2}-\\d{2}|\\d{2}\\.\\d{2}\\.\\d{4}|\\d{2}/\\d{2}/\\d{4})$"), "date")
        .when(m.rlike("^\\d{3}-\\d{2}-\\d{4}$"), "ssn")
        .when(m.rlike("^[+(]|^\\d{3}-\\d{3}-\\d{4}$"), "phone")
        .otherwise("card")
    )


def _indexes(n: Column) -> Column:
    return F.slice(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(1), n)


def _at(s: Column, j: Column | int, n: int = 1) -> Column:
    return F.substring(s, F.lit(j) if isinstance(j, int) else j, F.lit(n))


def _digest(key: Column, tweak: str, i: Column, half: Column) -> Column:
    """64 hex digits that the key, the kind, the round and the other half determine."""
    return F.sha2(F.concat(key, F.lit(f"|{tweak}|"), i.cast("string"), F.lit("|"), half).cast("binary"), 256)


def _add(half: Column, digest: Column, alphabet: str, sign: int) -> Column:
    """Characterwise sum with a key stream, modulo the size of the alphabet.

    The stream goes on for as long as the half: 16 characters for each numbered hash of the digest.
    """
    r = len(alphabet)

    def one(blocks: Column, c: Column, j: Column) -> Column:
        s = F.element_at(blocks, F.floor(j / 16).cast("int") + 1)
        d = F.conv(_at(s, F.pmod(j, F.lit(16)) * 4 + 1, 4), 16, 10).cast("int")
        k = F.instr(F.lit(alphabet), c) - 1
        return _at(F.lit(alphabet), F.pmod(k + d * sign, F.lit(r)) + 1)

    chars = F.filter(F.split(half, ""), lambda c: c != "")
    number = F.sequence(F.lit(0), F.floor(F.length(half) / 16).cast("int"))
    blocks = _once(digest, lambda d: F.transform(number, lambda b: F.sha2(F.concat(d, F.lit("|"), b.cast("string")).cast("binary"), 256)))
    return _once(blocks, lambda s: F.array_join(F.transform(chars, lambda c, j: one(s, c, j)), ""))


def feistel(value: Column, alphabet: str, key: Column, tweak: str, undo: bool = False) -> Column:
    """A keyed permutation of the strings over the alphabet that keeps their length."""
    u = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), u).alias("l"), F.substring(value, u + 1, F.length(value)).alias("r"))

    def forth(a: Column, i: Column) -> Column:
        return F.struct(a["r"].alias("l"), _add(a["l"], _digest(key, tweak, i, a["r"]), alphabet, 1).alias("r"))

    def back(a: Column, i: Column) -> Column:
        return F.struct(_add(a["r"], _digest(key, tweak, i, a["l"]), alphabet, -1).alias("l"), a["l"].alias("r"))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, back if undo else forth, lambda a: F.concat(a["l"], a["r"]))


def feistel_number(value: Column, a: int | Column, b: int | Column, key: Column, tweak: str, undo: bool = False) -> Column:
    """A keyed permutation of the numbers below a * b."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    start = F.struct(F.floor(value / b).cast("long").alias("x"), F.pmod(value, b).cast("long").alias("y"))

    def noise(i: Column, other: Column, size: Column) -> Column:
        return F.pmod(F.conv(_at(_digest(key, tweak, i, other.cast("string")), 1, 12), 16, 10).cast("long"), size)

    def step(s: Column, i: Column) -> Column:
        if undo:
            y = F.pmod(s["y"] - noise(i + 100, s["x"], b), b).cast("long")
            # The lambda variable y would be expanded twice; the struct keeps it once.
            inner = F.struct(s["x"].alias("x"), y.alias("y"))
            return F.transform(F.array(inner), lambda t: F.struct(F.pmod(t["x"] - noise(i, t["y"], a), a).cast("long").alias("x"), t["y"].alias("y")))[0]
        inner = F.struct(F.pmod(s["x"] + noise(i, s["y"], a), a).cast("long").alias("x"), s["y"].alias("y"))
        return F.transform(F.array(inner), lambda t: F.struct(t["x"].alias("x"), F.pmod(t["y"] + noise(i + 100, t["x"], b), b).cast("long").alias("y")))[0]

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, step, lambda s: s["x"] * b + s["y"])


def _once(value: Column, use) -> Column:
    """Bind a value to a lambda variable, so that an expression can use it often."""
    return F.transform(F.array(value), use)[0]


def _refill(shape: Column, chars: Column, alphabet: str) -> Column:
    """Put characters, one after the other, where the shape holds any of the alphabet."""
    between = F.split(shape, f"[{alphabet}]", -1)
    return F.array_join(F.zip_with(between, F.filter(F.split(chars, ""), lambda c: c != ""), lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")


def _only(value: Column, alphabet: str) -> Column:
    return F.translate(value, "".join(chr(c) for c in range(33, 127) if chr(c) not in alphabet) + " ", "")


def _permute(value: Column, alphabet: str, key: Column, tweak: str, undo: bool) -> Column:
    return _once(value, lambda v: _refill(v, feistel(_only(v, alphabet), alphabet, key, tweak, undo), alphabet))


def _luhn_sum(digits: Column) -> Column:
    """Sum for digits before the check digit, doubled from the last one on."""
    n = F.length(digits)

    def one(a: Column, j: Column) -> Column:
        d = _at(digits, n - j + 1).cast("int") * F.when(j % 2 == 1, 2).otherwise(1)
        return a + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(_indexes(n), F.lit(0), one)


def _with_check(body: Column) -> Column:
    return F.concat(body, F.pmod(F.lit(10) - F.pmod(_luhn_sum(body), F.lit(10)), F.lit(10)).cast("string"))


def _card(m: Column, key: Column, undo: bool) -> Column:
    def done(d: Column) -> Column:
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        new = _once(feistel(body, DIGITS, key, "card", undo), _with_check)
        return F.when(_with_check(body) == d, _refill(m, new, DIGITS)).otherwise(m)

    return _once(_only(m, DIGITS), done)


def _iban_rest(s: Column) -> Column:
    """Value modulo 97 of an account number in check order."""
    moved = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, F.lit(1), F.lit(4)))

    def one(a: Column, j: Column) -> Column:
        v = F.instr(F.lit(LOWER.upper()), _at(moved, j)) - 1
        return F.pmod(F.when(v > 9, a * 100 + v).otherwise(a * 10 + v), F.lit(97))

    return F.aggregate(_indexes(F.length(s)), F.lit(0), one)


def _iban(m: Column, key: Column, undo: bool) -> Column:
    def done(s: Column) -> Column:
        new = _permute(F.substring(s, F.lit(5), F.length(s)), DIGITS, key, "iban", undo)
        land = F.substring(s, F.lit(1), F.lit(2))
        fresh = _once(new, lambda b: F.concat(land, F.lpad((98 - _iban_rest(F.concat(land, F.lit("00"), b))).cast("string"), 2, "0"), b))
        return F.when((_iban_rest(s) == 1) & F.length(s).between(15, 34), _refill(m, fresh, LOWER.upper())).otherwise(m)

    return _once(F.translate(m, " ", ""), done)


def _ip(m: Column, key: Column, undo: bool) -> Column:
    """Octets keep their number of digits: each is a digit of a number in mixed radix."""

    def radix(x: Column) -> Column:
        return F.element_at(F.array(F.lit(10), F.lit(90), F.lit(156)), F.length(x)).cast("long")

    def low(x: Column) -> Column:
        return F.element_at(F.array(F.lit(0), F.lit(10), F.lit(100)), F.length(x)).cast("long")

    def done(p: Column) -> Column:
        size, base = [radix(p[k]) for k in range(4)], [low(p[k]) for k in range(4)]
        digit = [p[k].cast("long") - base[k] for k in range(4)]
        number = ((digit[0] * size[1] + digit[1]) * size[2] + digit[2]) * size[3] + digit[3]
        fine = F.forall(p, lambda x: F.length(x).between(1, 3) & (x.cast("int") <= 255) & ((F.length(x) == 1) | ~x.startswith("0")))
        moved = feistel_number(number, size[0] * size[1], size[2] * size[3], key, "ip", undo)

        def write(n: Column) -> Column:
            parts = [F.floor(n / (size[1] * size[2] * size[3])), F.pmod(F.floor(n / (size[2] * size[3])), size[1]), F.pmod(F.floor(n / size[3]), size[2]), F.pmod(n, size[3])]
            return F.concat_ws(".", *((d.cast("long") + b).cast("string") for d, b in zip(parts, base)))

        return F.when(fine, _once(moved, write)).otherwise(m)

    return _once(F.split(m, "\\."), done)


def _phone(m: Column, key: Column, undo: bool) -> Column:
    code = F.when(m.startswith("+"), F.regexp_extract(m, "^\\+\\d{1,3}(?=\\D)", 0)).otherwise("")
    return _once(code, lambda c: F.concat(c, _permute(F.substring(m, F.length(c) + 1, F.length(m)), DIGITS, key, "phone", undo)))


def _walk(start: Column, step, fine) -> Column:
    """Permute again and again until a value comes that may stand here: a permutation of those.

    Two in five values at least may, so that 64 steps miss one in 1e14; such a value stays.
    """
    seen = F.struct(start.alias("d"), F.lit(False).alias("ok"))
    move = lambda a, _: F.when(a["ok"], a).otherwise(_once(step(a["d"]), lambda n: F.struct(n.alias("d"), fine(n).alias("ok"))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), seen, move, lambda a: F.when(a["ok"], a["d"]).otherwise(start))


def _ssn(m: Column, key: Column, undo: bool) -> Column:
    fine = lambda d: ~d.rlike("^(000|666|9)|^...00|0000$")
    new = lambda d: _refill(m, _walk(d, lambda x: feistel(x, DIGITS, key, "ssn", undo), fine), DIGITS)
    return _once(_only(m, DIGITS), lambda d: F.when(fine(d), new(d)).otherwise(m))


def _date(m: Column, key: Column, undo: bool) -> Column:
    """Days after the twelfth stay after it, so that day and month are told apart as before."""
    kinds = {"yyyy-MM-dd": "^\\d{4}-", "dd.MM.yyyy": "^\\d{2}\\.", "MM/dd/yyyy": "^\\d{2}/", "dd/MM/yyyy": "^(1[3-9]|[23]\\d)/"}
    first, day = F.lit("1900-01-01").cast("date"), F.lit(None).cast("int")
    style = F.lit(None).cast("string")
    for form, shape in kinds.items():
        parts = [F.substring(m, F.lit(form.index(c) + 1), F.lit(len(c))) for c in ("yyyy", "MM", "dd")]
        here = m.rlike(shape)
        day = F.when(here, F.datediff(F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd"), first)).otherwise(day)
        style = F.when(here, F.lit(form)).otherwise(style)
    late = lambda n: F.dayofmonth(F.date_add(first, n.cast("int"))) > 12

    def moved(n: Column) -> Column:
        new = _walk(n, lambda x: feistel_number(x, *DAYS, key, "date", undo), lambda x: late(x) == late(n))
        return _once(F.date_add(first, new.cast("int")), written)

    def written(d: Column) -> Column:
        out = m
        for form in kinds:
            out = F.when(style == form, F.date_format(d, form)).otherwise(out)
        return out

    return _once(day.cast("bigint"), lambda n: F.when((n >= 0) & (n < DAYS[0] * DAYS[1]), moved(n)).otherwise(m))


def _email(m: Column, key: Column, undo: bool) -> Column:
    last = F.regexp_extract(m, "\\.[A-Za-z]+$", 0)
    return _once(last, lambda t: F.concat(_permute(F.lower(F.substring(m, F.lit(1), F.length(m) - F.length(t))), LOWER, key, "email", undo), F.lower(t)))


def _secret(m: Column, key: Column, undo: bool) -> Column:
    label = F.regexp_extract(m, "^[A-Za-z_-]+\\s*[=:]\\s*[\"']?", 0)

    def done(t: Column) -> Column:
        value = F.substring(m, F.length(t) + 1, F.length(m))
        low = _permute(F.lower(value), HEX, key, "secret", undo)
        hexed = F.when(value == F.lower(value), low).otherwise(F.upper(low))
        plain = value.rlike("^[0-9a-f]+$") | value.rlike("^[0-9A-F]+$")
        return F.concat(t, F.when(plain, hexed).otherwise(_permute(value, ALNUM, key, "secret", undo)))

    return _once(label, done)


_MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "phone": _phone, "card": _card, "ssn": _ssn, "date": _date}


def pseudonym(match: Column, key: Column, undo: bool = False) -> Column:
    """The pseudonym of one match of PATTERN (or the value behind one, if undo)."""
    kind, out = _kind(match), match
    for name, make in _MAKERS.items():
        out = F.when(kind == name, make(match, key, undo)).otherwise(out)
    return out


def key_table(spark: SparkSession, key: str) -> DataFrame:
    """A secret as a table of one cell."""
    return spark.sql("SELECT k FROM VALUES (?) AS t (k)", args=[key])


def pseudonymise(docs: DataFrame, key: DataFrame, text_col: str = "text", found_col: str = "pii", undo: bool = False) -> DataFrame:
    """Replace personal data in the text column; found_col gets the kinds replaced, in order.

    key: the secret as a table of one cell (key_table()).
    """
    text, names = F.col(text_col), []
    for held in ("_key", "_swap"):
        while held in docs.columns:
            held += "_"
        names.append(held)
    secret, done = F.col(names[0]), F.col(names[1])
    candidates = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    swap = F.transform(candidates, lambda m: F.struct(pseudonym(m, secret, undo).alias("new"), m.alias("old"), _kind(m).alias("kind")))
    # Most texts hold neither a digit, an @ nor a label, and stop at this test.
    swap = F.when(text.rlike("[0-9@]|(?i:key|token|secret|pass|pwd)"), swap).otherwise(F.array().cast("array<struct<new:string,old:string,kind:string>>"))
    marked = docs.withColumn(names[0], key.scalar()).withColumn(names[1], swap)
    pieces = F.split(text, PATTERN, -1)
    joined = F.array_join(F.zip_with(pieces, F.transform(done, lambda s: s["new"]), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    kinds = F.transform(F.filter(done, lambda s: s["new"] != s["old"]), lambda s: s["kind"])
    return marked.withColumns({text_col: F.when(F.size(done) > 0, joined).otherwise(text), found_col: F.coalesce(kinds, F.array().cast("array<string>"))}).drop(*names)
