"""Quality classification by positive-unlabelled learning.

A linear scorer z over byte and word statistics of whole texts minimises the non-negative
unbiased risk of trusted positives and unlabelled text, with the squared loss (1 - yz)**2 / 4. For
that loss both parts of the risk are functions of first and second moments, which are summed over
all texts map-side, so that no unlabelled text is left out and every step of the descent sees all
of them. The class prior is estimated from unlabelled scores: the least ratio of the shares of
unlabelled and of positive texts above a threshold, each fold's positives judged by the model of
the other. Labels of the negative class teach nothing: neither fit, prior, scale nor threshold.

Positives are a bounded draw of labelled rows (POSITIVES, by a keyed hash of the id).

Defined results: null and empty texts get the score of a text without bytes; repeated rows get
equal scores, and a labelled id that repeats teaches once, by its smallest text; ids labelled
twice with different values teach nothing; without any positive text every score is 0.5;
language, source, id and labels never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, integers, merge_tree, slices, text_column
from .kernel import NOT_SPACE, mix, spans, word_hashes

POSITIVES = 8_000
#: Bins of a histogram of scores between -EDGE and EDGE; share of the positives that a threshold of the prior keeps at least.
BINS, EDGE, KEPT = 4096, 4.0, 0.3
_BYTES = 1 << 20
_BIGRAMS = 256


def _classes() -> np.ndarray:
    """Byte classes: each ASCII mark is its own, letters, digits and the rest share."""
    out = np.zeros(256, np.int64)
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    for k, b in enumerate(marks):
        out[b] = k
    n = len(marks)
    for k, (lo, hi) in enumerate([(65, 90), (97, 122), (48, 57), (32, 32), (10, 10), (128, 191), (192, 255)]):
        out[lo : hi + 1] = n + k
    out[:32] = np.where(out[:32] == 0, n + 7, out[:32])
    return out


_CLASS = _classes()
_N_CLASS = int(_CLASS.max()) + 1
N_FEATURES = 2 * _N_CLASS + _BIGRAMS + 10


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics for each whole text, from its UTF-8 bytes."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    cls = np.bincount(row * _N_CLASS + _CLASS[data], minlength=n * _N_CLASS).reshape(n, _N_CLASS)
    two = data.astype(np.int64)
    two[:-1] = (two[:-1] * 31 + two[1:] * 7) % _BIGRAMS
    two %= _BIGRAMS
    gram = np.bincount(row * _BIGRAMS + two, minlength=n * _BIGRAMS).reshape(n, _BIGRAMS)
    start, end, bounds = spans(data, offsets, NOT_SPACE)
    words = np.diff(bounds)
    length = end - start
    owner = np.repeat(np.arange(n), words)
    total = np.maximum(words, 1)
    h = word_hashes(data, start, end, True)
    with np.errstate(over="ignore"):
        keyed = mix(h + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keyed, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = keyed[order][1:] != keyed[order][:-1]
    distinct = np.bincount(owner[order][new], minlength=n)
    last = data[end - 1] if len(end) else np.empty(0, np.uint8)
    marked = (last < 128) & ~np.isin(last, np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ,.", np.uint8))
    upper = (data[start] >= 65) & (data[start] <= 90) if len(start) else np.empty(0, bool)
    mean = np.bincount(owner, length, n) / total
    again = np.zeros(len(h), bool)  # a word that follows itself
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    echo = np.bincount(owner, again, n) / total
    stats = np.stack(
        [
            np.log1p(words),
            distinct / total,
            mean,
            np.sqrt(np.maximum(np.bincount(owner, length.astype(float) ** 2, n) / total - mean**2, 0)),
            np.bincount(owner, marked, n) / total,
            np.bincount(owner, upper, n) / total,
            np.log1p(size),
            (words == 0).astype(float),
            echo,
            np.sqrt(echo),
        ],
        1,
    )
    per = cls / np.maximum(size, 1)[:, None]
    return np.concatenate([per, np.sqrt(per), np.sqrt(gram / np.maximum(size, 1)[:, None]), stats], 1).astype(np.float32)


@dataclass
class Moments:
    """Number of rows, their sum, and the sum of their products."""

    n: float
    first: np.ndarray
    second: np.ndarray

    @staticmethod
    def none(size: int = N_FEATURES) -> Moments:
        return Moments(0.0, np.zeros(size), np.zeros((size, size)))

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        x = x.astype(np.float64)
        return Moments(float(len(x)), x.sum(0), x.T @ x)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.first + other.first, self.second + other.second)

    def pack(self) -> bytes:
        return np.concatenate([[self.n], self.first, self.second.ravel()]).tobytes()

    @staticmethod
    def unpack(part: bytes) -> Moments:
        flat = np.frombuffer(part)
        d = int(round((-1 + np.sqrt(4 * len(flat) - 3)) / 2))
        return Moments(float(flat[0]), flat[1 : d + 1], flat[d + 1 :].reshape(d, d))

    def scaled(self, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Mean products of the standardised rows, each with a last entry of one."""
        m = self.first / self.n
        c = (m - mean) / scale
        s = (self.second / self.n - np.outer(m, mean) - np.outer(mean, m) + np.outer(mean, mean)) / np.outer(scale, scale)
        return np.block([[s, c[:, None]], [c[None, :], np.ones((1, 1))]])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def decide(self, x: np.ndarray) -> np.ndarray:
        """z: positive for good texts, about twice the probability less one."""
        return ((x - self.mean) / self.scale) @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(4 * self.decide(x), -30, 30)))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """prior * R_p(+) and R_u(-) - prior * R_p(-) of weights over mean products, with their gradients."""
    pw, uw = p @ w, u @ w
    plus = prior * (1 - 2 * pw[-1] + w @ pw) / 4
    minus = (1 + 2 * uw[-1] + w @ uw) / 4 - prior * (1 + 2 * pw[-1] + w @ pw) / 4
    return plus, minus, prior * (pw - p[-1]) / 2, (uw + u[-1]) / 2 - prior * (pw + p[-1]) / 2


def fit_moments(positive: Moments, unlabelled: Moments, prior: float, steps: int = 600, decay: float | None = None, rate: float = 0.01) -> Model:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) and a ridge.

    Where the bracket falls below zero its gradient is turned round, so that the risk of the
    negative class can't be fitted to less than nothing. The ridge falls with the number of positives.
    """
    mean = unlabelled.first / unlabelled.n
    scale = np.sqrt(np.maximum(np.diag(unlabelled.second) / unlabelled.n - mean**2, 0)) + 1e-3
    p, u = positive.scaled(mean, scale), unlabelled.scaled(mean, scale)
    ridge = np.full(len(p), 8 / np.sqrt(positive.n) if decay is None else decay)
    ridge[-1] = 0
    # The descent starts at the minimum without the bracket, drawn back to where the bracket is nothing.
    w = np.linalg.lstsq(u / 2 + np.diag(2 * ridge), prior * p[-1] - u[-1] / 2, rcond=None)[0]
    w = next(k * w for k in np.linspace(1, 0, 201) if k == 0 or risk(k * w, p, u, prior)[1] >= 0)
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, steps + 1):
        _, minus, g_plus, g_minus = risk(w, p, u, prior)
        g = (g_plus + g_minus + 2 * ridge * w) if minus >= 0 else -g_minus
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, **options) -> Model:
    """fit_moments() on rows."""
    return fit_moments(Moments.of(positive), Moments.of(unlabelled), prior, **options)


def histogram(z: np.ndarray) -> np.ndarray:
    at = np.clip((z + EDGE) * (BINS / (2 * EDGE)), 0, BINS - 1)
    return np.bincount(at.astype(np.int64), minlength=BINS)


def estimate_prior(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from two histograms of scores.

    Above any threshold the unlabelled share is at least the prior times the positive share, and
    equal where no negative reaches it. The threshold is the one at which that bound, with the
    sampling error of the positive share, is least.
    """
    u, p = (np.cumsum(h[::-1]) / max(h.sum(), 1) for h in (unlabelled, positive))
    ok = p >= KEPT
    if not ok.any():
        return 0.5
    u, p = u[ok], p[ok]
    error = np.sqrt((1 - p + 1 / max(positive.sum(), 1)) / (p * max(positive.sum(), 1)))
    best = int(np.argmin(u / p * (1 + error)))
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; a null id falls into 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in slices(batches, "text", _BYTES):
        yield batch, features(*text_column(batch, "text"))


def _sum(parts: Iterator[bytes]) -> bytes:
    total = None
    for p in parts:
        total = Moments.unpack(p) if total is None else total + Moments.unpack(p)
    return total.pack()


def _moments(docs: DataFrame) -> Moments:
    """Moments over all rows of a column `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _features(batches):
            total = Moments.of(x) if total is None else total + Moments.of(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.pack()], pa.binary())], ["part"])

    found = merge_tree(docs.select("text").mapInArrow(run, "part binary"), _sum)
    return Moments.unpack(found) if found else Moments.none()


def _histograms(docs: DataFrame, models: list[Model]) -> list[np.ndarray]:
    """One histogram of scores over all rows of a column `text` for each model."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sent.value), BINS), np.int64)
        for _, x in _features(batches):
            total += np.stack([histogram(m.decide(x)) for m in sent.value])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    def merge(parts: Iterator[bytes]) -> bytes:
        return sum(np.frombuffer(p, np.int64) for p in parts).tobytes()

    found = merge_tree(docs.select("text").mapInArrow(run, "part binary"), merge)
    return list(np.frombuffer(found, np.int64).reshape(len(models), BINS)) if found else [np.zeros(BINS, np.int64) for _ in models]


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Fit on positives outside fold 1, about `positives` of them at most, and on all texts unlabelled."""
    work = Workspace(docs.sparkSession, "quality")
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1))
    good = known.groupBy("doc_id").agg(F.min("y").alias("y")).where("y = 1").select("doc_id")
    n = good.count()
    if not n:
        return None
    part = int(min(1.0, positives / n) * (1 << 30))
    good = good.where(F.pmod(F.xxhash64("doc_id", F.lit(2024)), F.lit(1 << 30)) < part)
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # Broadcast: about `positives` ids at most.
    drawn = text.join(F.broadcast(good), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    drawn = work.save(drawn.select((fold(F.col("doc_id")) == 0).alias("zero"), F.coalesce("text", F.lit("")).alias("text")))
    halves = [drawn.where("zero"), drawn.where("not zero")]
    sums = [_moments(h) for h in halves]
    positive, unlabelled = sums[0] + sums[1], _moments(text)
    if not positive.n:
        return None
    if min(s.n for s in sums) < 2:
        halves, sums = [drawn, drawn], [positive, positive]
    models = [fit_moments(s, unlabelled, 0.5) for s in sums]
    # Each half's positives are judged by the model that the other half made.
    seen = [_histograms(halves[1 - k], [m])[0] for k, m in enumerate(models)]
    priors = [estimate_prior(u, p) for u, p in zip(_histograms(text, models), seen)]
    return fit_moments(positive, unlabelled, float(np.mean(priors)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted for every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches, "text", _BYTES):
            s = model.score(features(*text_column(batch, "text"))) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([pa.array(integers(batch, "doc_id"), pa.int64()), pa.array(s)], ["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs, with all their columns, that classify() would give predicted = 1."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches, text_col, _BYTES):
            good = model.score(features(*text_column(batch, text_col))) >= 0.5 if model else np.ones(batch.num_rows, bool)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
