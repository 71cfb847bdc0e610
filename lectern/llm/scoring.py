"""Language-model scores of whole texts by causal self-attention over words.

A text is its words (A-Z lower-cased, cut at white space) and one end. The tree of the softmax goes
on to every word: the words most frequent in all training texts are leaves of the attention's two
levels, all others lie in classes of words spelled alike, which are such leaves too, and have their
add-one shares of their class, of which a word that the training texts lack has one. So each place
of a text is read and predicted in context, whatever its word. Counts, classes and weights come from
every training text: weights start from a model that one task trains on a bounded draw, then every
task trains a copy on all of its windows, and the copies are averaged.

Long texts are scored in overlapping windows, each token once. Counts of words come in two tiers:
frequent ones are broadcast, the others joined. The model's tokens and the frequent words are told
apart by 64-bit hashes, the others by their text.

Defined results: a null or empty text is the end alone; a null id hashes as an empty text; repeated
rows are scored and counted each; without training texts (N = V = 0) weights stay as drawn and the
base score is 0; other columns are neither read nor returned.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attention import POSITIONS, Model, Shape, Trainer, cut, keep_memory, start, windows
from .common import Workspace, binary_array, merge_tree, slices, utf8_parts
from .kernel import NOT_SPACE, mix, ragged, spans, word_hashes

#: Words of the broadcast tier at most; bytes of a step.
FREQUENT, SLICE = 1 << 17, 2 << 20
#: Windows of the first model's draw at most, its steps and the windows of a step.
DRAW, STEPS, BATCH = 3 << 13, 2000, 192
#: One in so many training windows trains the tasks' copies: all of them.
SHARE = 1
#: The end, and the first class of words that are no tokens by themselves.
END, RARE = 0, 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Six bits for each byte: a-z as A-Z, digits, bytes behind the first of a letter, full stop, comma, others. 0: no byte.
_CODE = np.full(256, 62, np.int32)
_CODE[0x61:0x7B] = _CODE[0x41:0x5B] = np.arange(1, 27)
_CODE[0x30:0x3A], _CODE[0x80:0xC0], _CODE[0x2E], _CODE[0x2C], _CODE[0xC0:] = 27, 28 + np.arange(64) % 32, 60, 61, 63
SPELLINGS = 1 << 18


class Table:
    """Values of 64-bit keys: sorted keys, and where those with the same upper bits begin."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, default: int):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values, self.default = keys[order], values[order], default
        self.shift = np.uint64(64 - max(4, len(keys).bit_length() + 3))
        slots = (self.keys >> self.shift).astype(np.int64)
        self.first = np.searchsorted(slots, np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)
        self.most = int(np.diff(self.first).max(initial=0))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys >> self.shift).astype(np.int64)
        out, at = np.full(len(keys), self.default, self.values.dtype), self.first[slot]
        live = np.flatnonzero(at < self.first[slot + 1])
        for _ in range(self.most):
            hit = self.keys[at[live]] == keys[live]
            out[live[hit]] = self.values[at[live[hit]]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < self.first[slot[live] + 1]]
        return out


def hashes_of(words: list[str]) -> np.ndarray:
    """The hashes of whole words, as spelled() gives them."""
    data, offsets = utf8_parts(pa.array(words, pa.string()))
    return word_hashes(data, offsets[:-1], offsets[1:], False)


def spelled(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a text column, starts, ends and hashes (A-Z as a-z) of its words, and the rows' bounds."""
    data, offsets = utf8_parts(col)
    start, end, rows = spans(data, offsets, NOT_SPACE)
    return data, start, end, word_hashes(data, start, end, True), rows


def cut_out(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Words of the bytes, with A-Z as a-z."""
    bounds = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    raw = _LOWER[data[ragged(start, end - start)]]
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(raw.tobytes())])


def different(col: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of a text column, the number of each word in it, and the rows' bounds."""
    data, start, end, hashes, rows = spelled(col)
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    return cut_out(data, start[first], end[first]), number, rows


def words_of(col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    words, number, rows = different(col)
    return words.to_pylist(), number, rows


def spellings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number below SPELLINGS for each word (A-Z as a-z), from its first two bytes and its last one."""
    second = np.where(end - start > 1, _CODE[data[np.minimum(start + 1, end - 1)]], 0)
    return (_CODE[data[start]] << 12) | (second << 6) | _CODE[data[end - 1]]


class Tokens:
    """Words as the model's tokens: the end, classes of words spelled alike, then the most frequent words.

    hashes, n: of the words that are tokens; counts, different: occurrences and number of all other
    training words by spelling.
    """

    def __init__(self, hashes: np.ndarray, n: np.ndarray, ends: int, counts: np.ndarray, different: np.ndarray, size: int):
        k = class_count(size)
        self.hashes, self.n, self.classes = hashes, n, k
        self.of_spelling = RARE + spelling_classes(counts, k)
        rare, kinds = (np.bincount(self.of_spelling, x, RARE + k)[RARE:] for x in (counts, different))
        self.counts = np.zeros(size)
        self.counts[END], self.counts[RARE : RARE + k] = ends, rare
        self.counts[RARE + k : RARE + k + len(n)] = n
        self.share = np.log10(rare + kinds + 1)
        self.token = Table(hashes, np.arange(RARE + k, RARE + k + len(n), dtype=np.int32), RARE)

    def __call__(self, hashes: np.ndarray, spelling: np.ndarray | None) -> np.ndarray:
        found = self.token(hashes)
        return found if spelling is None else np.where(found == RARE, self.of_spelling[spelling], found)


def spelling_classes(counts: np.ndarray, k: int) -> np.ndarray:
    """A class below k for each spelling: ranges of about equal counts, as many as heavy spellings leave.

    Spellings without a count go with the one beside them that begins alike further.
    """
    seen, lo, hi = np.flatnonzero(counts), 1, 64 * k
    if not len(seen):
        return np.zeros(len(counts), np.int32)
    middle = (np.cumsum(counts) - counts / 2)[seen] / counts.sum()
    cut = lambda parts: np.cumsum(np.append(False, np.diff((middle * parts).astype(np.int64)) > 0))
    while hi - lo > 1:
        m = (lo + hi) // 2
        lo, hi = (m, hi) if cut(m)[-1] < k else (lo, m)
    every = np.arange(len(counts))
    after = np.searchsorted(seen, every)
    before, after = np.maximum(after - 1, 0), np.minimum(after, len(seen) - 1)
    return cut(lo)[np.where(every ^ seen[before] < every ^ seen[after], before, after)].astype(np.int32)


def class_count(size: int) -> int:
    """Classes among so many tokens."""
    return max(1, size // 2 - 1)


def sequences(hashes: np.ndarray, rows: np.ndarray, tokens: Tokens, spelling: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sources, targets and bounds of the rows' sequences, each with an end; without spellings all classes are the first."""
    to = rows + np.arange(len(rows))
    inside = np.ones(int(to[-1]), bool)
    inside[to[1:] - 1] = False
    target = np.full(len(inside), END, np.int32)
    target[inside] = tokens(hashes, spelling)
    source = np.empty_like(target)
    source[1:] = target[:-1]
    source[to[:-1]] = END
    return source, target, to


def _held(id_col: str, folds: int, out: int):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == out


def word_counts(texts: DataFrame) -> DataFrame:
    """word and n over a column `text`; the ends of texts count under the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            words, number, _ = different(batch.column(0))
            n = np.bincount(number, minlength=len(words)).astype(np.int64)
            words = pa.concat_arrays([words.cast(pa.string()), pa.array([""])])
            yield pa.RecordBatch.from_arrays([words, pa.array(np.append(n, batch.num_rows))], ["word", "n"])

    return texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def model_tokens(counts: DataFrame, size: int) -> Tokens:
    """The model's tokens, from the table of words: the most frequent ones, and classes of all the others."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_parts(batch.column(0))
            at = offsets[:-1], offsets[1:]
            yield pa.RecordBatch.from_arrays([pa.array(word_hashes(data, *at, False).view(np.int64)), pa.array(spellings(data, *at)), batch.column(1)], ["hash", "spelling", "n"])

    words = counts.where("word <> ''").select("word", "n").mapInArrow(read, "hash long, spelling int, n long")
    top = words.orderBy(F.desc("n"), "hash").limit(size - 1 - class_count(size)).toArrow()
    ends = counts.where("word = ''").agg(F.sum("n")).collect()[0][0] or 0
    # At most one row for each spelling, whatever the table holds.
    found = words.groupBy("spelling").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()
    own, n = top.column("spelling").to_numpy(), top.column("n").to_numpy()
    all_n, all_v = (np.bincount(found.column("spelling").to_numpy(), found.column(c).to_numpy(), SPELLINGS) for c in ("n", "v"))
    return Tokens(top.column("hash").to_numpy().view(np.uint64), n, ends, all_n - np.bincount(own, n, SPELLINGS), all_v - np.bincount(own, minlength=SPELLINGS), size)


def frequent_words(counts: DataFrame, limit: int) -> tuple[list[str], np.ndarray]:
    """Words and counts above the lowest count that at most `limit` short words reach."""
    short = counts.where(F.octet_length("word") <= 64)
    steps = short.groupBy(F.floor(F.log2("n") * 8).alias("step")).count().orderBy(F.desc("step")).collect()
    least, total = None, 0
    for r in steps:
        total += r["count"]
        if total > limit:
            break
        least = r.step
    if least is None:
        return [], np.empty(0, np.int64)
    top = short.where(F.floor(F.log2("n") * 8) >= least).toArrow()
    return top.column("word").to_pylist(), top.column("n").to_numpy()


def _mix_windows(target: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """A hash of each window's tokens, so that a draw depends on no order and no partition."""
    places = np.random.Generator(np.random.PCG64(77)).integers(1, 2**64, target.shape[1], np.uint64, endpoint=False)
    with np.errstate(over="ignore"):
        return mix(((target + 1).astype(np.uint64) * places * wanted).sum(axis=1, dtype=np.uint64))


def _training(batches: Iterator[pa.RecordBatch], tokens: Tokens, shape: Shape, share: float, order: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows side by side, those whose hashes lie in the first share of the range; order: with their hashes."""
    for batch in slices(batches, "text", SLICE):
        *at, hashes, rows = spelled(batch.column(0))
        source, target, bounds = sequences(hashes, rows, tokens, spellings(*at))
        first, owner, context = windows(bounds, shape.window, shape.window)
        for a in range(0, len(first), 4096):
            part = slice(a, a + 4096)
            s, t, w = cut(source, target, bounds, first[part], owner[part], context[part], shape.window)
            h = _mix_windows(t, w) / 2.0**64 if order or share < 1 else np.zeros(len(t))
            kept = (h < share) | (share >= 1)
            if kept.any():
                yield s[kept].astype(np.int16), t[kept].astype(np.int16), w[kept], h[kept]


def _some(texts: DataFrame, share: float, spread: float) -> tuple[DataFrame, float]:
    """Texts of which windows are drawn, by their hashes, and the share of each one's windows.

    A draw of windows is a draw of `spread` times as many texts and of fewer windows in each, so
    that the other texts needn't be encoded for it.
    """
    part = min(1.0, share * spread)
    kept = texts.select("text") if part == 1 else texts.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(part * (1 << 30)))
    return kept, share / part


def train(texts: DataFrame, tokens: Tokens, shape: Shape, draw: int = DRAW, steps: int = STEPS, share: int = SHARE) -> np.ndarray:
    """The model's weights from the column `text` of training rows."""
    spark = texts.sparkSession
    flat, n = start(shape, tokens.counts), int(tokens.counts.sum())
    if not n:
        return flat
    sent = spark.sparkContext.broadcast((tokens, flat))
    some, part = _some(texts, min(1.0, draw * shape.window / n), 8)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, t, w, h in _training(batches, sent.value[0], shape, part, True):
            yield pa.RecordBatch.from_arrays([binary_array([x.tobytes()]) for x in (s, t, w, h)], ["s", "t", "w", "h"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[np.frombuffer(x.as_py(), kind) for x in b.column(k)] for b in batches for k, kind in enumerate((np.int16, np.int16, bool, float))]
        s, t, w, h = (np.concatenate([x for g in got[k::4] for x in g] or [np.empty(0, kind)]) for k, kind in enumerate((np.int16, np.int16, bool, float)))
        if len(h):
            s, t, w = (x.reshape(-1, shape.window) for x in (s, t, w))
            order = np.lexsort((s[:, 0], *t[:, :4].T, h))  # windows of equal targets may follow different words
            s, t, w = s[order], t[order], w[order]
            keep_memory()
            trainer, rng = Trainer(Model(shape, sent.value[1].copy()), 0.012), np.random.Generator(np.random.PCG64(9))
            todo = min(steps, 8 * -(-len(s) // BATCH))
            for k in range(todo):
                i = rng.integers(0, len(s), BATCH)
                trainer.step(s[i], t[i], w[i], min(1.0, (k + 1) / 50) * (1 - 0.9 * k / todo))
            yield pa.RecordBatch.from_arrays([binary_array([trainer.model.flat.tobytes()])], ["part"])

    drawn = some.mapInArrow(pick, "s binary, t binary, w binary, h binary")
    made = drawn.repartition(1).mapInArrow(first, "part binary").collect()
    if not made:
        return flat
    ours, fraction = _some(texts, 1.0 / share, 1)
    warm = spark.sparkContext.broadcast(np.frombuffer(bytes(made[0].part), np.float32))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        trainer, done, held = Trainer(Model(shape, warm.value.copy()), 0.001), 0, []
        for s, t, w, _ in _training(batches, sent.value[0], shape, fraction, False):
            held.append((s, t, w))
            s, t, w = (np.concatenate(x) if len(held) > 1 else x[0] for x in zip(*held))
            full = len(s) - len(s) % BATCH
            for k in range(0, full, BATCH):
                trainer.step(s[k : k + BATCH], t[k : k + BATCH], w[k : k + BATCH], min(1.0, (trainer.steps + 1) / 20))
            done, held = done + full, [(s[full:], t[full:], w[full:])]
        if held and len(held[0][0]):
            trainer.step(*held[0], min(1.0, (trainer.steps + 1) / 20))
            done += len(held[0][0])
        if done:
            yield pa.RecordBatch.from_arrays([binary_array([np.append(trainer.model.flat.astype(np.float64) * done, done).tobytes()])], ["part"])

    def merge(parts: Iterator[bytes]) -> bytes:
        total = np.zeros(shape.size + 1)
        for p in parts:
            total += np.frombuffer(p, np.float64)
        return total.tobytes()

    found = merge_tree(ours.mapInArrow(own, "part binary"), merge)
    if not found:
        return warm.value.copy()
    total = np.frombuffer(found, np.float64)
    return (total[:-1] / total[-1]).astype(np.float32)


_workers: dict[str, tuple] = {}


def score_texts(docs: DataFrame, shape: Shape, tokens: Tokens, flat: np.ndarray, tier: tuple[list[str], np.ndarray], stride: int) -> DataFrame:
    """doc_id, held_out, n_tokens, score and base, and the words whose counts the tier lacks: score and base
    hold the logarithms of counts of the other words, and of nothing else that a count divides."""
    spark, key = docs.sparkSession, uuid.uuid4().hex
    # The tokens' counts too, so that each word of the join is a rare one.
    hashes, first = np.unique(np.concatenate((hashes_of(tier[0]), tokens.hashes)), return_index=True)
    known = Table(hashes, np.concatenate((tier[1], tokens.n))[first], 0)
    sent = spark.sparkContext.broadcast((tokens, flat, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _workers:
            keep_memory()
            _workers.clear()
            tokens, flat, counts = sent.value
            _workers[key] = tokens, Model(shape, flat.copy()).freeze(), counts
        tokens, model, counts = _workers[key]
        end = int(tokens.counts[END])
        for batch in slices(batches, "text", SLICE):
            data, begin, stop, hashes, rows = spelled(batch.column(batch.schema.get_field_index("text")))
            source, target, bounds = sequences(hashes, rows, tokens, spellings(data, begin, stop))
            first, owner, context = windows(bounds, shape.window, stride)
            total, step = np.zeros(batch.num_rows), max(1, POSITIONS // shape.window)
            for a in range(0, len(first), step):
                part = slice(a, a + step)
                s, t, w = cut(source, target, bounds, first[part], owner[part], context[part], shape.window)
                total += np.bincount(np.repeat(owner[part], w.sum(axis=1)), model.score(s, t, w), batch.num_rows)
            c = counts(hashes)
            row = np.repeat(np.arange(batch.num_rows), np.diff(rows))
            more = np.log10(c + 1.0)
            kind = target[target != END] - RARE
            rare = kind < tokens.classes
            base = np.bincount(row, more, batch.num_rows) + math.log10(end + 1)
            share = np.bincount(row[rare], more[rare] - tokens.share[kind[rare]], batch.num_rows)
            missed = np.flatnonzero(c == 0)
            lacks = np.concatenate(([0], np.cumsum(c == 0)))[rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("doc_id")),
                    batch.column(batch.schema.get_field_index("held_out")),
                    pa.array(np.diff(rows) + 1),
                    pa.array(np.bincount(row[c > 0], minlength=batch.num_rows) + (end > 0)),
                    pa.array(base),
                    pa.array(total / math.log(10) + share),
                    pa.ListArray.from_arrays(pa.array(lacks.astype(np.int32)), cut_out(data, begin[missed], stop[missed]).cast(pa.string())),
                ],
                ["doc_id", "held_out", "n_tokens", "known", "base", "score", "words"],
            )

    return docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, words array<string>")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, out: int = 2, shape: Shape | None = None, stride: int | None = None, draw: int = DRAW, steps: int = STEPS, share: int = SHARE, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every text.

    Rows whose crc32 of the id as text leaves the remainder `out` by `folds` teach nothing.
    """
    shape = shape or Shape(window=16)
    stride = stride or shape.window * 5 // 6
    work = Workspace(docs.sparkSession, "scores")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _held(id_col, folds, out).alias("held_out"), F.col(text_col).alias("text"))
    texts = rows.where("not held_out")
    counts = work.save(word_counts(texts))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).collect()[0]
    tokens = model_tokens(counts, shape.tokens)
    flat = train(texts, tokens, shape, draw, steps, share)
    tier = frequent_words(counts.where("word <> ''"), frequent)
    # Row numbers are fixed by the table that they are written to.
    scored = score_texts(rows, shape, tokens, flat, tier, stride).withColumn("row", F.monotonically_increasing_id())
    scored = work.save(scored)
    rest = scored.select("row", F.explode("words").alias("word")).join(counts, "word")
    rest = rest.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count("*").alias("found"))
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    return scored.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0).cast("long"))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
