"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Chosen with least, ratio and penalty of ``fit`` by ``cross_validated`` on training rows alone.
SIZES = (5, 7, 9)
#: Of odd multipliers for 64-bit n-gram hashes; one table for the bytes.
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 22


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts in one array, each between line ends, and where each starts."""
    data = np.frombuffer(b"\n" + b"\n".join(t.lower() for t in texts) + b"\n", np.uint8)
    return data, np.cumsum([0] + [len(t) + 1 for t in texts])


def _grams(data: np.ndarray, sizes: tuple[int, ...]) -> Iterator[np.ndarray]:
    """For each size, the hash of the n-gram at every place; no n-gram spans two texts' worth of meaning, as a line end parts them."""
    b, h = _BYTE[data], None
    for n in range(1, max(sizes) + 1):
        h = b.copy() if h is None else h[:-1] * _STEP + b[n - 1 :]
        if n in sizes:
            x = h ^ (h >> np.uint64(29))
            x *= np.uint64(0xBF58476D1CE4E5B9)
            yield x ^ (x >> np.uint64(32))


@dataclass
class Model:
    """Hashes of the chosen n-grams (sorted), their weights, the intercept."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...] = SIZES

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The chance of label 1 for each whole text; each n-gram counts once in a text."""
        z = np.full(len(texts), self.bias)
        if len(self.hashes) and texts:
            has = np.zeros(1 << _SLOTS, bool)
            has[self.hashes >> np.uint64(64 - _SLOTS)] = True
            for lo, hi in C.slices(texts):
                row, feature = self.found(texts[lo:hi], has)
                np.add.at(z, row + lo, self.weights[feature])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def found(self, texts: list[bytes], has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, n-gram) pairs."""
        data, first = _joined(texts)
        pairs = []
        for h in _grams(data, self.sizes):
            at = np.flatnonzero(has[h >> np.uint64(64 - _SLOTS)])
            k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            ok = self.hashes[k] == h[at]
            pairs.append((np.searchsorted(first, at[ok], side="right") - 1) * len(self.hashes) + k[ok])
        p = np.unique(np.concatenate(pairs))
        p = p[p < len(texts) * len(self.hashes)]
        return p // len(self.hashes), p % len(self.hashes)


def fit(texts: list[bytes], labels: list[int], sizes: tuple[int, ...] = SIZES, least: int = 2, ratio: float = 1.5, steps: int = 300, penalty: float = 3e-4) -> Model:
    """Naive Bayes log-count ratios of the n-grams in ``least`` or more texts; those of ``ratio`` or more, scaled by
    their ratio, are the features of a logistic regression with an L2 penalty.  N-grams that lean to label 0 are left
    out: a long text holds hundreds, which would outweigh a toxic passage in it.

    Without texts of both labels there are no features and the score is the share of label 1, 0 without any text.
    """
    y = np.array(labels, float)
    none = Model(np.empty(0, np.uint64), np.empty(0), 0.0, sizes)
    if not len(y) or y.min() == y.max():
        none.bias = 500.0 if len(y) and y[0] else -500.0
        return none
    # counts by slot first; only n-grams of slots that lean to label 1 are held in the second pass
    slots = np.zeros((2, 1 << _SLOTS), np.int32)
    for t, label in zip(texts, labels):
        slots[int(label)][np.unique(np.concatenate([h >> np.uint64(64 - _SLOTS) for h in _grams(_joined([t])[0], sizes)]))] += 1
    lean = np.log((slots[1] + 0.5) / (y.sum() + 1)) - np.log((slots[0] + 0.5) / (len(y) - y.sum() + 1))
    ok = (slots.sum(0) >= least) & (lean >= 0.8 * ratio)
    del slots, lean
    kept = []
    for t in texts:
        kept.append(np.unique(np.concatenate([h[ok[h >> np.uint64(64 - _SLOTS)]] for h in _grams(_joined([t])[0], sizes)])))
    flat, rows = np.concatenate(kept), np.repeat(np.arange(len(kept)), [len(h) for h in kept])
    hashes, at = np.unique(flat, return_inverse=True)
    n1 = np.bincount(at, weights=y[rows], minlength=len(hashes))
    n = np.bincount(at, minlength=len(hashes))
    r = np.log((n1 + 0.5) / (y.sum() + 1)) - np.log((n - n1 + 0.5) / (len(y) - y.sum() + 1))
    pick = np.flatnonzero((n >= least) & (r >= ratio))
    if not len(pick):
        p = y.mean()
        none.bias = float(np.log(p / (1 - p)))
        return none
    to = np.full(len(hashes), -1)
    to[pick] = np.arange(len(pick))
    use = to[at] >= 0
    rows, cols, r = rows[use], to[at][use], r[pick]
    w, b = np.zeros(len(pick)), 0.0
    m, v, m0, v0 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    x = r[cols]
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(rows, weights=x * w[cols], minlength=len(y)), -50, 50)))
        d = (p - y) * each
        g, g0 = np.bincount(cols, weights=d[rows] * x, minlength=len(w)) + penalty * w, d.sum()
        m, v, m0, v0 = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * m0 + 0.1 * g0, 0.999 * v0 + 0.001 * g0 * g0
        c1, c2 = 1 - 0.9**k, 1 - 0.999**k
        w -= 0.05 * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        b -= 0.05 * (m0 / c1) / (np.sqrt(v0 / c2) + 1e-9)
    return Model(hashes[pick], w * r, float(b), sizes)


def cross_validated(texts: list[bytes], labels: list[int], settings: list[dict], folds: int = 3, seed: int = 1) -> list[tuple[float, float, float]]:
    """For each of ``settings`` of ``fit``: area under the curve, share of label 1 at 0.5 or more, and of label 0, over
    ``folds`` of the given texts, each scored by a model that has not seen it.  Equal texts are in one fold."""
    y = np.array(labels)
    fold = np.array([zlib.crc32(t, seed) % folds for t in texts])
    out = []
    for given in settings:
        s = np.empty(len(y))
        for k in range(folds):
            seen, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            s[own] = fit([texts[i] for i in seen], y[seen].tolist(), **given).scores([texts[i] for i in own])
        rank = np.empty(len(s))
        v, at, n = np.unique(s, return_inverse=True, return_counts=True)
        rank = (np.cumsum(n) - (n - 1) / 2)[at]  # ties share their mean rank
        pos, neg = y.sum(), len(y) - y.sum()
        auc = (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)
        out.append((float(auc), float((s[y == 1] >= 0.5).mean()), float((s[y == 0] >= 0.5).mean())))
    return out


def training_rows(docs: DataFrame, labels: DataFrame, max_each: int = 2500) -> tuple[list[bytes], list[int]]:
    """The texts and labels that ``train`` learns from, one row for each doc_id."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    spread = F.xxhash64("doc_id")
    chosen = [known.filter(f"toxic = {v}").orderBy(spread, "doc_id").limit(max_each) for v in (0, 1)]
    chosen = chosen[0].union(chosen[1])  # of 2 * max_each short rows at most
    rows = C.pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("t"))
    rows = rows.withColumn("t", F.col("t").cast("binary")).orderBy("doc_id").toPandas()
    return [bytes(x) for x in rows.t], rows.toxic.tolist()


def train(docs: DataFrame, labels: DataFrame, max_each: int = 2500) -> Model:
    """Fits on at most ``max_each`` labelled texts of each label, those of the least xxhash64(doc_id): a documented bound.

    Only rows whose crc32(doc_id as text) mod 5 is not 0 are learned from.  Labels with nulls are left out; a doc_id
    labelled both ways counts as toxic; of rows with equal ids the least text is learned, and only that one, chosen
    before anything comes to the driver.
    """
    return fit(*training_rows(docs, labels, max_each))


def _score(batches: Iterator[pa.RecordBatch], model: Model, text_at: int, keep: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        s = model.scores(C.binary(b.column(text_at)))
        if keep:
            yield b.filter(pa.array(s < 0.5))
        else:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).  The score depends on the whole
    text alone.  A null or empty text gets the score of a text without features; a null doc_id is not held out."""
    own = C.map_arrow(C.pick(docs, "doc_id", "text"), partial(_score, model=model, text_at=1, keep=False), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return own.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a score under 0.5, whole and with all of their columns."""
    return C.map_arrow(docs, partial(_score, model=model, text_at=docs.columns.index("text"), keep=True), docs.schema)
