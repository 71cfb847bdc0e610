"""Plain Python versions of the operators, written from their contracts alone."""

import datetime
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def links(docs):
    """[(id, text)] -> per row (shingles, component, links)."""
    sets = []
    for _, t in docs:
        w = SPACED.findall(fold(t))
        sets.append({tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set())
    root, n = list(range(len(docs))), [0] * len(docs)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                n[a] += 1
                n[b] += 1
                root[find(a)] = find(b)
    low = defaultdict(list)
    for k, (i, _) in enumerate(docs):
        if i is not None:
            low[find(k)].append(i)
    return [(i, len(sets[k]), min(low[find(k)], default=None), n[k]) for k, (i, _) in enumerate(docs)]


def substrings(docs, window=35):
    words = [SPACED.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[p : p + window]) for w in words for p in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(docs, words):
        gone = {q for p in range(len(w) - window + 1) if seen[tuple(w[p : p + window])] > 1 for q in range(p, p + window)}
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def contamination(docs, items, window=10):
    found = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(fold(t))
        if w and i is not None:
            k = min(window, len(w))
            for p in range(len(w) - k + 1):
                found[tuple(w[p : p + k])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, ids = ALNUM.findall(fold(t)), set(), set()
        for k in {len(x) for x in found}:
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in found:
                    ids |= found[tuple(w[p : p + k])]
                    hit.update(range(p, p + k))
        out.append((i, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return out


def archive(pages, least=100):
    bodies = [(i, (h or "").encode()) for i, h in pages]
    first = {}
    for i, b in bodies:
        if len(b) >= least and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, b in bodies:
        other = first.get(b)
        again = other is not None and i is not None and i > other
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", other if again else None))
    return out


# --- pseudonyms ----------------------------------------------------------------------------

_DIGITS, _HEX, _LOWER = "0123456789", "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz"
_ANY = _LOWER + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _noise(key, tweak, i, half):
    return sha(f"{key}|{tweak}|{i}|{half}")


def _shift(half, digest, alphabet):
    out = []
    for j, c in enumerate(half):
        block = sha(f"{digest}|{j // 16}")
        out.append(alphabet[(alphabet.index(c) + int(block[j % 16 * 4 : j % 16 * 4 + 4], 16)) % len(alphabet)])
    return "".join(out)


def _text_network(value, alphabet, key, tweak):
    left, right = value[: len(value) // 2], value[len(value) // 2 :]
    for i in range(8):
        left, right = right, _shift(left, _noise(key, tweak, i, right), alphabet)
    return left + right


def _number_network(n, a, b, key, tweak):
    x, y = n // b, n % b
    for i in range(8):
        x = (x + int(_noise(key, tweak, i, y)[:12], 16)) % a
        y = (y + int(_noise(key, tweak, i + 100, x)[:12], 16)) % b
    return x * b + y


def _fill(shape, new, alphabet):
    new = iter(new)
    return "".join(next(new) if c in alphabet else c for c in shape)


def _characters(value, alphabet, key, tweak):
    return _fill(value, _text_network("".join(c for c in value if c in alphabet), alphabet, key, tweak), alphabet)


def _luhn_digit(body):
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _date_parts(m):
    if m[4] == "-":
        return "%Y-%m-%d"
    return "%d.%m.%Y" if m[2] == "." else "%d/%m/%Y" if int(m[:2]) > 12 else "%m/%d/%Y"


def _one(m, key):
    """Kind and pseudonym of a match."""
    if "@" in m:
        top = m[m.rindex(".") :]
        return "email", _characters(m[: len(m) - len(top)].lower(), _LOWER, key, "email") + top.lower()
    label = re.match("[A-Za-z_-]+\\s*[=:]\\s*[\"']?", m)
    if label:
        value = m[label.end() :]
        for form, back in ((_HEX, str.lower), (_HEX.upper(), str.upper)):
            if all(c in form for c in value):
                return "secret", label[0] + back(_characters(value.lower(), _HEX, key, "secret"))
        return "secret", label[0] + _characters(value, _ANY, key, "secret")
    digits = "".join(c for c in m if c in _DIGITS)
    if re.match("[A-Z]{2}", m):
        s = m.replace(" ", "")
        if _mod97(s) != 1 or not 15 <= len(s) <= 34:
            return "iban", m
        body = _characters(s[4:], _DIGITS, key, "iban")
        return "iban", _fill(m, s[:2] + f"{98 - _mod97(s[:2] + '00' + body):02d}" + body, _LOWER.upper())
    if re.fullmatch("([0-9]{1,3}\\.){3}[0-9]{1,3}", m):
        parts = m.split(".")
        if any(int(x) > 255 or str(int(x)) != x for x in parts):
            return "ip", m
        size, low = [{1: 10, 2: 90, 3: 156}[len(x)] for x in parts], [{1: 0, 2: 10, 3: 100}[len(x)] for x in parts]
        n = 0
        for x, r, b in zip(parts, size, low):
            n = n * r + int(x) - b
        n = _number_network(n, size[0] * size[1], size[2] * size[3], key, "ip")
        out = []
        for r, b in zip(reversed(size), reversed(low)):
            out.append(str(n % r + b))
            n //= r
        return "ip", ".".join(reversed(out))
    if re.fullmatch("[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\\1[0-9]{4}", m):
        try:
            day = (datetime.datetime.strptime(m, _date_parts(m)).date() - datetime.date(1900, 1, 1)).days
        except ValueError:
            return "date", m
        if not 0 <= day < 73000:
            return "date", m
        start, new = datetime.date(1900, 1, 1), day
        while True:
            new = _number_network(new, 250, 292, key, "date")
            if ((start + datetime.timedelta(new)).day > 12) == ((start + datetime.timedelta(day)).day > 12):
                return "date", (start + datetime.timedelta(new)).strftime(_date_parts(m))
    if re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", m):
        bad = lambda d: re.match("000|666|9|...00|.....0000", d)
        if bad(digits):
            return "ssn", m
        new = _text_network(digits, _DIGITS, key, "ssn")
        while bad(new):
            new = _text_network(new, _DIGITS, key, "ssn")
        return "ssn", _fill(m, new, _DIGITS)
    if m[0] in "+(" or re.fullmatch("[0-9]{3}-[0-9]{3}-[0-9]{4}", m):
        code = re.match("\\+[0-9]{1,3}(?=[^0-9])", m)
        code = code[0] if code else ""
        return "phone", code + _characters(m[len(code) :], _DIGITS, key, "phone")
    if _luhn_digit(digits[:-1]) != digits[-1]:
        return "card", m
    body = _text_network(digits[:-1], _DIGITS, key, "card")
    return "card", _fill(m, body + _luhn_digit(body), _DIGITS)


_PERSONAL = re.compile(
    r"""(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])
    |(?<![A-Za-z0-9])(?i:token|secret|passw(?:or)?d|passphrase|pwd|(?:api|access|auth|private)[_-]?key)\s{0,4}[=:]\s{0,4}["']?[A-Za-z0-9+/_-]{8,}
    |(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])
    |(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])
    |(?<![0-9+])\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\([0-9]{3}\)[ ]?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])
    |(?<![0-9A-Za-z])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z])
    |(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])
    |(?<![0-9.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9-])""",
    re.X,
)


def pseudonymise(text, key):
    """Text and the kinds replaced in it."""
    kinds = []

    def swap(m):
        kind, new = _one(m[0], key)
        if new != m[0]:
            kinds.append(kind)
        return new

    return (None, []) if text is None else (_PERSONAL.sub(swap, text), kinds)


# --- words over a whole corpus ---------------------------------------------------------------


def ranking(docs, items, k=10):
    """[(id, text)], [(item, text)] -> {query number: [(item, rank, id, score)]}."""
    words = [(i, Counter(ALNUM.findall(fold(t)))) for i, t in docs]
    total, length = sum(bool(c) for _, c in words), sum(sum(c.values()) for _, c in words)
    df = Counter(w for _, c in words for w in c)
    out = {}
    for q, (item, text) in enumerate(items):
        scores = []
        for i, c in words:
            m = 100 - 90 + (90 * sum(c.values()) * total) // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(ALNUM.findall(fold(text))) if c[w])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out[q] = [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return out


def variants(docs, shortest=5, least=3):
    """[(id, text)] -> {word: (n, n_near, form, form_n, root)}, by comparing all pairs of words."""
    seen = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", fold(t)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            seen[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in seen.items() if len(w) >= shortest and c >= least}

    def one_edit(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: sorted((x for x in n if one_edit(w, x)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: near[w][0] if near[w] and n[near[w][0]] >= 2 * n[w] else None for w in n}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root(w)) for w in n}


def base_scores(docs):
    """[(id, text)] -> per row (id, held out, tokens, known, training tokens, base score)."""
    rows = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, [*SPACED.findall(fold(t)), None]) for i, t in docs]
    c = Counter(w for _, held, ws in rows if not held for w in ws)
    total, size = sum(c.values()), len(c)
    return [(i, held, len(ws), sum(c[w] > 0 for w in ws), total, sum(math.log10((c[w] + 1) / (total + size + 1)) for w in ws)) for i, held, ws in rows]
