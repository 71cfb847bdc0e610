"""Spelling variants grouped by full neighbourhood generation.

Every word of the vocabulary emits all different strings that one deletion, one replacement or
one insertion over the observed alphabet makes of it. Those that are words themselves are its
near words, found by a hash join with the vocabulary: no distance is ever computed.

A neighbourhood holds about 2 * length * alphabet strings. They are emitted as hashes first, each
from the running hash of its word, and a bitmap of the vocabulary's hashes lets pass what may be a
word; only that is spelled out and joined. The bitmap has a bounded size and no false negatives:
when a vocabulary outgrows it, more strings are joined and the result stays the same.

Words hold code points up to U+00FF only, so that each is one byte of Latin-1 inside the kernel.

Defined results: a null text has no words; a null id counts as an empty one in the hash that
decides about deletions; repeated rows count each; no word qualifies: an empty result; words of
any length take part, their neighbourhoods cut into pieces of bounded size; other columns are
neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, utf8_parts
from .kernel import mix, powers, ragged

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
#: Strings of a neighbourhood that one step holds; words of one task of the emitting stage.
STEP, EACH = 1 << 20, 1 << 13
#: Largest bitmap, in bits.
LOG2_BITS = 26
_SEED = 41
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WEIGHTS = np.random.Generator(np.random.PCG64(_SEED)).integers(1, 2**64, 256, np.uint64, endpoint=False) | np.uint64(1)


def observed_words(docs: DataFrame, drop_one_in: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word: the lower-cased runs of letters of whole texts, one code point deleted where the hash of id and run says so."""
    text = F.col(text_col)
    # lower() of pure ASCII folds A-Z alone.
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(folded, F.lit(RUN), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    return hashed.select(F.when(F.col("h") % drop_one_in == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """word and n, its occurrences, of the words that are long and frequent enough."""
    long = words.where(F.char_length("word") >= shortest)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def alphabet(words: DataFrame) -> bytes:
    """The different code points of the vocabulary: at most 166, as Latin-1."""
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct()
    return "".join(sorted(r.c for r in letters.collect())).encode("latin-1")


class Words:
    """A text column as Latin-1 bytes with bounds, and the running hash of each word."""

    def __init__(self, col: pa.Array):
        raw, offsets = utf8_parts(col)
        size = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # code points before each byte
        self.bounds = size[offsets]
        self.data = np.frombuffer(raw.tobytes().decode().encode("latin-1"), np.uint8)
        self.length = np.diff(self.bounds)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of weight * base**place: up to each place of a word, and of whole words."""
        p, _ = powers(_SEED, int(self.length.max(initial=0)) + 2)
        place = np.arange(len(self.data)) - np.repeat(self.bounds[:-1], self.length)
        with np.errstate(over="ignore"):
            run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_WEIGHTS[self.data] * p[place], dtype=np.uint64)))
            before = run[:-1] - np.repeat(run[self.bounds[:-1]], self.length)
            return before, run[self.bounds[1:]] - run[self.bounds[:-1]]


def _bits(n: int) -> int:
    return min(LOG2_BITS, max(12, int(n * 32).bit_length()))


def _first(h: np.ndarray, log2_bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - log2_bits)).astype(np.int64)


def _second(h: np.ndarray, log2_bits: int) -> np.ndarray:
    return (mix(h) & np.uint64((1 << log2_bits) - 1)).astype(np.int64)


def bitmap(words: DataFrame, log2_bits: int) -> np.ndarray:
    """Two bits for each word's hash, or'ed together by the executors."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << (log2_bits - 6), np.int64)
        for batch in batches:
            h = Words(batch.column(0)).hashes()[1]
            for s in (_first(h, log2_bits), _second(h, log2_bits)):
                np.bitwise_or.at(own, s >> 6, np.int64(1) << (s & 63))
        used = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(own[used])], ["w", "b"])

    marked = words.select("word").mapInArrow(mark, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(1 << (log2_bits - 6), np.int64)
    for r in marked.toArrow().to_batches():
        out[r.column(0).to_numpy(zero_copy_only=False)] = r.column(1).to_numpy(zero_copy_only=False)
    return out


def _passes(bits: np.ndarray, h: np.ndarray, log2_bits: int) -> np.ndarray:
    """Indexes of the hashes that the bitmap holds; the second bit is looked at where the first is set."""
    s = _first(h, log2_bits)
    at = np.flatnonzero((bits[s >> 6] >> (s & 63)) & 1)
    s = _second(h[at], log2_bits)
    return at[(bits[s >> 6] >> (s & 63)) & 1 == 1]


def neighbourhood(words: Words, letters: np.ndarray, keep, step: int = STEP) -> Iterator[tuple[np.ndarray, ...]]:
    """All different strings that one edit makes of each word, those that `keep` passes by their hashes.

    Yields place (in the flat letters), word, letter and kind (0 deletes the letter at the place,
    1 replaces it, 2 inserts before it, 3 appends). Of edits that make equal strings the first is taken: a
    letter equal to the one before it isn't deleted, and none is inserted after its like.
    """
    before, whole = words.hashes()
    size, a = words.length, len(letters)
    p, inv = powers(_SEED, int(size.max(initial=0)) + 2)
    base, back = p[1], inv[1]
    owner = np.repeat(np.arange(len(size)), size)
    data, start = words.data, words.bounds[:-1]
    first = np.arange(len(data)) == start[owner] if len(data) else np.zeros(0, bool)
    weight = _WEIGHTS[letters]
    each = max(1, step // (2 * a + 1))
    with np.errstate(over="ignore"):
        for lo in range(0, len(data), each):
            q = np.arange(lo, min(lo + each, len(data)))
            c, w, head = data[q], owner[q], first[q]
            previous = data[np.maximum(q - 1, 0)]
            power, total = p[q - start[w]], whole[w]
            own = _WEIGHTS[c] * power
            d = np.flatnonzero(head | (c != previous))
            h = before[q[d]] + (total[d] - before[q[d]] - own[d]) * back
            d = d[keep(h)]
            yield q[d], w[d], c[d], np.zeros(len(d), np.int8)
            added = weight[None, :] * power[:, None]
            i, j = np.divmod(keep((added + (total - own)[:, None]).ravel()), a)
            ok = c[i] != letters[j]
            i, j = i[ok], j[ok]
            yield q[i], w[i], letters[j], np.ones(len(i), np.int8)
            i, j = np.divmod(keep((added + (before[q] + (total - before[q]) * base)[:, None]).ravel()), a)
            ok = head[i] | (previous[i] != letters[j])
            i, j = i[ok], j[ok]
            yield q[i], w[i], letters[j], np.full(len(i), 2, np.int8)
        for lo in range(0, len(size), max(1, step // max(a, 1))):  # after the last letter
            w = np.arange(lo, min(lo + max(1, step // max(a, 1)), len(size)))
            w = w[size[w] > 0]
            last = words.bounds[1:][w] - 1
            i, j = np.divmod(keep((whole[w][:, None] + weight[None, :] * p[size[w]][:, None]).ravel()), max(a, 1))
            ok = data[last[i]] != letters[j]
            i, j = i[ok], j[ok]
            yield last[i] + 1, w[i], letters[j], np.full(len(i), 3, np.int8)


def spell(words: Words, place: np.ndarray, word: np.ndarray, letter: np.ndarray, kind: np.ndarray) -> pa.Array:
    """The edited words as a text column."""
    start, size = words.bounds[:-1][word], words.length[word]
    front = place - start
    skip = (kind <= 1).astype(np.int64)  # letters of the word that the edit takes away
    put = (kind >= 1).astype(np.int64)  # and puts in
    length = size - skip + put
    out = np.empty(int(length.sum()), np.uint8)
    to = np.concatenate(([0], np.cumsum(length)))
    out[ragged(to[:-1], front)] = words.data[ragged(start, front)]
    rest = size - front - skip
    out[ragged(to[:-1] + front + put, rest)] = words.data[ragged(place + skip, rest)]
    out[(to[:-1] + front)[put == 1]] = letter[put == 1]
    wide = np.concatenate(([0], np.cumsum(1 + (out >> 7).astype(np.int64))))[to]
    text = out.tobytes().decode("latin-1").encode()
    return pa.Array.from_buffers(pa.large_string(), len(length), [None, pa.py_buffer(wide.astype(np.int64).tobytes()), pa.py_buffer(text)])


def near_words(words: DataFrame, letters: bytes, log2_bits: int, step: int = STEP) -> DataFrame:
    """word, n and near: the emitted strings that may be words, each once for a word."""
    spark = words.sparkSession
    sent = spark.sparkContext.broadcast((bitmap(words, log2_bits), np.frombuffer(letters, np.uint8)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, alphabet = sent.value
        for batch in batches:
            col, n = batch.column(0).cast(pa.large_string()), batch.column(1)
            flat = Words(col)
            for place, word, letter, kind in neighbourhood(flat, alphabet, lambda h: _passes(bits, h, log2_bits), step):
                # Pieces of bounded size, also where a word is very long.
                size = np.cumsum(flat.length[word] + 1)
                lo = 0
                while lo < len(word):
                    done = int(size[lo - 1]) if lo else 0
                    hi = max(lo + 1, int(np.searchsorted(size, done + (4 << 20), "right")))
                    part = slice(lo, hi)
                    at = pa.array(word[part])
                    yield pa.RecordBatch.from_arrays([col.take(at).cast(pa.string()), n.take(at), spell(flat, place[part], word[part], letter[part], kind[part]).cast(pa.string())], ["word", "n", "near"])
                    lo = hi

    return words.select("word", "n").mapInArrow(emit, "word string, n long, near string")


def roots(work: Workspace, forms: DataFrame) -> DataFrame:
    """word and root, the end of the chain of forms, for each word of (word, form), by pointer doubling.

    A form is at least twice as frequent as its word, so a chain is no longer than the binary
    logarithm of the largest count, and there are as many rounds as the logarithm of that. Words
    that have arrived are no longer joined, so a root of very many words is no hot key.
    """
    now = work.save(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while not (moving := now.where("open")).isEmpty():
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("open").alias("more"))
        step = moving.select("word", "root").join(ahead, "root", "left")
        step = step.select("word", F.coalesce("next", "root").alias("root"), F.coalesce("more", F.lit(False)).alias("open"))
        now = work.save(now.where("not open").unionByName(step))
    return now.select("word", "root")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3, factor: int = 2, drop_one_in: int = 97, step: int = STEP) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the vocabulary.

    A word's form is its most frequent near word (ties: the smallest in code-point order) when
    that is at least `factor` (2 or more) times as frequent; its root is the end of the chain.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more, or chains of forms needn't end")
    work = Workspace(docs.sparkSession, "spelling")
    words = work.save(vocabulary(observed_words(docs, drop_one_in, id_col, text_col), shortest, least))
    n = words.count()
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // EACH))
    spread = words.repartition(min(tasks, 1 << 20), "word")
    found = near_words(spread, alphabet(words), _bits(n), step)
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best")
    near = work.save(found.join(known, "near").groupBy("word", "n").agg(F.count("*").alias("n_near"), best))
    has = -F.col("best.n") >= factor * F.col("n")
    near = near.select("word", "n_near", F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.n")).alias("form_n"))
    ends = roots(work, near.where("form is not null").select("word", "form"))
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
