"""Naive Bayes support vectors: a linear classifier of text quality.

A text is the set of its hashed n-grams: words, word pairs, and one to three word shapes in
a row (letters and digits collapsed by class, so that "WORD!!" and "word***" are seen
whatever the word), plus a mark for a word said three times in a row. Each indicator is
scaled by its class log-count ratio r = ln((p / |p|) / (q / |q|)), p and q being smoothed
counts of labelled texts of either class that hold the n-gram; vectors are scaled to unit
length, and an L2-regularised hinge loss is minimised by dual coordinate descent. A logistic
curve turns margins into probabilities; it is fitted on rows that the descent has not seen, with
their own counts taken out of the ratios, so their margins are as those of unseen texts.

The counts cover every labelled training row. The descent and the curve use a sample of at
most FIT_ROWS labelled training rows, the first by the hash of doc_id: the bound that keeps
the driver's work constant, and the same sample however the rows are dealt over partitions.
Labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansieve.llm.common import cut, ship

BITS = 20
FIT_ROWS = 6_000
#: labels of at most so many rows (about 60 bytes each, so 60 MB) go to every task; more are joined by a shuffle
BROADCAST_LABELS = 1_000_000
SMOOTH, COST, EPOCHS, CUTOFF = 1.0, 1.0, 15, 0.7

_SHAPES = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)
)
_RUNS = re.compile(rb"a{2,}|A{2,}|0{2,}")
_SEED = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)]


def _codes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _SEED[kind % 4] + np.uint64(kind)
    return ((h ^ (h >> np.uint64(32))) * _SEED[(kind + 1) % 4]) >> np.uint64(64 - BITS)


def features(raw: bytes | None) -> np.ndarray:
    """Sorted distinct buckets of the n-grams of a text; empty for null and blank texts."""
    words = raw.split() if raw else []
    if not words:
        return np.zeros(0, np.int64)
    w = _codes(words)
    s = _codes(_RUNS.sub(lambda m: m[0][:1], raw.translate(_SHAPES)).split())
    m = np.uint64(0x9FB21C651E98DF25)
    parts = [_bucket(w, 0), _bucket(w[:-1] * m + w[1:], 1), _bucket(s, 2)]
    pairs = s[:-1] * m + s[1:]
    parts += [_bucket(pairs, 3), _bucket(pairs[:-1] * m + s[2:], 4)]
    if len(w) > 2 and bool(((w[2:] == w[1:-1]) & (w[1:-1] == w[:-2])).any()):
        parts.append(_bucket(np.ones(1, np.uint64), 5))
    return np.unique(np.concatenate(parts)).astype(np.int64)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, raw, good of the rows that may be learned from; an id with several labels is left out if they differ."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4
    marks = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
        .agg(F.min("quality").alias("good"), F.max("quality").alias("_top")).where("good = _top").drop("_top").where(fold != 2)
    )
    marks = cut(marks)
    if marks.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    return docs.select("doc_id", F.col("text").cast("binary").alias("raw")).join(marks, "doc_id")


def class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Labelled texts of either class that hold each bucket; 2^BITS sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for raw, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[int(good == 1)][features(raw)] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.record_batch({"bucket": pa.array(at, pa.int32()), "bad": pa.array(counts[0][at]), "good": pa.array(counts[1][at])})

    sums = (
        rows.select("raw", "good").mapInArrow(run, "bucket int, bad long, good long")
        .groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    )
    out = np.zeros((2, 1 << BITS))
    t = sums.toArrow()
    at = t["bucket"].to_numpy()
    out[0][at], out[1][at] = t["bad"].to_numpy(), t["good"].to_numpy()
    return out[1], out[0]


def fit_sample(rows: DataFrame, size: int = FIT_ROWS) -> list[tuple[np.ndarray, int]]:
    """Features and class (1, -1) of at most `size` rows: the first by the hash of doc_id, its value and the text's hash."""
    n = rows.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # a tenth more than is asked for, so that the order decides and not the share
    part = place < int((1 << 30) * min(1.0, 1.1 * size / max(n, 1)))
    order = ["place", "doc_id", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(r).astype(np.int32) for r in batch.column(3).to_pylist()]
            yield pa.record_batch([*batch.columns[:3], pa.array(found, pa.list_(pa.int32())), batch.column(4)], names=[*order, "f", "good"])

    asked = rows.where(part).select(place.alias("place"), "doc_id", F.xxhash64("raw").alias("digest"), "raw", F.col("good").cast("int").alias("good"))
    table = asked.mapInArrow(run, "place long, doc_id long, digest long, f array<int>, good int").orderBy(*order, "good").limit(size).toArrow()
    f, good = table["f"].combine_chunks(), table["good"].to_pylist()
    return [(f[i].values.to_numpy(), 1 if good[i] == 1 else -1) for i in range(len(good))]


def dual_descent(xs: list[tuple[np.ndarray, np.ndarray]], ys: list[int], size: int, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """min |w|^2 / 2 + sum_i cost_i * hinge(y_i w.x_i) by coordinate descent in the dual.

    xs: (indices, values). The last weight is the bias. Classes share the cost equally, so the
    rarer class is not drowned.
    """
    w = np.zeros(size + 1)
    pos = max(1, sum(y > 0 for y in ys))
    neg = max(1, len(ys) - pos)
    caps = [cost * len(ys) / (2 * (pos if y > 0 else neg)) for y in ys]
    alpha = np.zeros(len(ys))
    norms = [float(v @ v) + 1.0 for _, v in xs]
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(ys)):
            at, v = xs[i]
            y = ys[i]
            gradient = y * (float(w[at] @ v) + w[-1]) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), caps[i])
            step = (new - alpha[i]) * y
            if step:
                w[at] += step * v
                w[-1] += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def logistic(margins: np.ndarray, ys: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))) by Newton steps with a small ridge and smoothed targets."""
    pos, neg = float((ys > 0).sum()), float((ys < 0).sum())
    target = np.where(ys > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    theta = np.array([1.0, 0.0])
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (p - target) + 1e-3 * theta
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        theta = theta - step
        if float(np.abs(step).max()) < 1e-8:
            break
    return float(theta[0]), float(theta[1])


class Model:
    def __init__(self, weights: np.ndarray, ratio: np.ndarray, bias: float, a: float, b: float):
        self.weights, self.ratio, self.bias, self.a, self.b = weights.astype(np.float32), ratio.astype(np.float32), bias, a, b

    def probability(self, raw: bytes | None) -> float:
        at = features(raw)
        r = self.ratio[at].astype(np.float64)
        length = float(np.sqrt(r @ r)) or 1.0
        m = float(r @ self.weights[at]) / length + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.a * m + self.b, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Without labels of both classes the model says the smoothed share of label 1 for all texts."""
    ship()
    rows = labelled(docs, labels)
    good, bad = class_counts(rows)
    p, q = good + SMOOTH, bad + SMOOTH
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[(good + bad) == 0] = 0.0
    sample = fit_sample(rows, fit_rows)
    size = 1 << BITS

    def vector(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = ratio[f]
        return f, r / (float(np.sqrt(r @ r)) or 1.0)

    def unseen(f: np.ndarray, y: int) -> tuple[np.ndarray, np.ndarray]:
        """The vector if the row had not been counted."""
        own = (len(f), 0) if y > 0 else (0, len(f))
        pf, qf = good[f] - (y > 0), bad[f] - (y < 0)
        r = np.log(((pf + SMOOTH) / (p.sum() - own[0])) / ((qf + SMOOTH) / (q.sum() - own[1])))
        r[(pf + qf) == 0] = 0.0
        return f, r / (float(np.sqrt(r @ r)) or 1.0)

    ys = [y for _, y in sample]
    if len(set(ys)) < 2:
        share = (sum(y > 0 for y in ys) + 1) / (len(ys) + 2)
        return Model(np.zeros(size), ratio, 0.0, 0.0, float(np.log(share / (1 - share))))
    seen, other = [i for i in range(len(ys)) if i % 5], [i for i in range(len(ys)) if i % 5 == 0]
    w = dual_descent([vector(sample[i][0]) for i in seen], [ys[i] for i in seen], size)
    xs = [unseen(*sample[i]) for i in other]
    margins = np.array([float(w[at] @ v) + w[-1] for at, v in xs])
    a, b = logistic(margins, np.array([ys[i] for i in other]))
    return Model(w[:-1], ratio, float(w[-1]), a, b)


def score(model: Model, text: Column) -> Column:
    """Probability of label 1, in [0, 1], of whole texts; null and empty texts get the curve's value at the bias."""
    ship()

    def run(raw: pd.Series) -> pd.Series:
        return pd.Series([model.probability(x) for x in raw], dtype="float64")

    return F.pandas_udf(run, "double")(text.cast("binary"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs.select("doc_id", "text"), labels)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4
    scored = docs.select("doc_id", (fold == 2).alias("held_out"), score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= CUTOFF, 1).otherwise(0))
