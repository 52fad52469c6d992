"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes.

Features are the hashed n-grams (``ORDERS``) of the characters of the lower-cased text
between two blanks, counted and divided by the text's length plus ``SMOOTH`` characters.
Each is scaled by the log-count ratio r of the two classes with add-one smoothing,
and a logistic regression with a quadratic penalty is fitted to the scaled features by
L-BFGS until no slope is above ``SLOPE``. The fit uses at most ``per_class`` labelled
texts of each class, of at most ``LONGEST`` characters each, in one task, and gives one weight for each bucket; scoring reads
every whole text.

Defined results: null and empty texts have no features and score by the intercept;
repeated rows are scored each; without labelled rows of both classes every score is
the share of label 1, or 0.5 if there are none; labels that are neither 0 nor 1, or
null, are ignored; other columns pass unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltgraph.llm.common import free_name
from quiltgraph.llm.sampling import labelled_sample, prior_shift

ORDERS = (4, 5, 6, 7)
BITS = 20
SMOOTH = 200  # characters added to a text's length
RATE = 1000  # the fit counts n-grams in so many characters
UNIT = 1 << 18  # packed weights are for n-grams in so many characters
ROUNDS = 500  # at most; SLOPE ends the fit before
SLOPE = 1e-4
PENALTY = 1e-3
MEMORY = 6  # steps that L-BFGS remembers
LEAST = 3  # sampled texts that must have a feature
CHUNK = 1 << 20  # characters hashed at a time
PART = 1 << 19  # features read at a time when fitting


def hashed(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams, CHUNK starts at a time; the pieces share what the longest n-gram needs."""
    low = f" {text.lower()} "
    for a in range(0, len(low), CHUNK):
        piece = np.frombuffer(low[a : a + CHUNK + max(ORDERS) - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
        h = piece
        for n in range(2, max(ORDERS) + 1):
            if len(piece) < n:
                break
            h = h[:-1] * np.uint32(0x01000193) + piece[n - 1 :] * np.uint32(0x9E3779B1)
            if n in ORDERS:
                x = h[:CHUNK] ^ (h[:CHUNK] >> np.uint32(15))
                yield (x * np.uint32(0x2C1B3C6D) + np.uint32(n * 0x85EB)) >> np.uint32(32 - BITS)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text, and how often each occurs."""
    if len(text) > CHUNK:
        n = np.zeros(1 << BITS, np.int64)
        for h in hashed(text):
            n += np.bincount(h, minlength=1 << BITS)
        found = np.flatnonzero(n).astype(np.uint32)
        return found, n[found]
    parts = list(hashed(text)) if text else []
    return np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint32), return_counts=True)


def features(text: str) -> np.ndarray:
    """The distinct buckets of a text."""
    return counted(text)[0]


class Scorer:
    """The sum of the weights of a text's n-grams, scaled by its length."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str) -> float:
        total = sum(float(self.weights.take(h).sum(dtype=np.float64)) for h in hashed(text)) if text else 0.0
        z = self.bias + total * UNIT / (len(text or "") + SMOOTH)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def minimum(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Where convex ``f``, which gives its value and slopes, is least: L-BFGS with halved steps."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(ROUNDS):
        if np.abs(g).max() < SLOPE:
            break
        d, used = -g, []
        for s, y, rho in reversed(past):
            a = rho * (s @ d)
            d -= a * y
            used.append(a)
        d *= 1 / (past[-1][2] * (past[-1][1] @ past[-1][1])) if past else 1 / max(1.0, np.abs(g).sum())
        for (s, y, rho), a in zip(past, reversed(used)):
            d += (a - rho * (y @ d)) * s
        step, slope = 1.0, float(g @ d)
        while True:
            new = x + step * d
            value_new, g_new = f(new)
            if value_new <= value + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, y = new - x, g_new - g
        if value_new >= value:
            break
        if s @ y > 1e-12:
            past = [*past[1 - MEMORY :], (s, y, 1 / float(s @ y))]
        x, value, g = new, value_new, g_new
    return x


def fit(texts: list[str], y: np.ndarray) -> tuple[np.ndarray, float]:
    """(weight of each bucket, intercept). Texts are hashed twice, so that only features that count are kept; PART of them are read at a time."""
    n, one = len(texts), 1 << BITS
    scale = RATE / (np.array([len(t) for t in texts]) + SMOOTH)
    p, q, has = np.ones(one), np.ones(one), np.zeros(one, np.int32)
    for text, label, part in zip(texts, y, scale):
        f, times = counted(text)
        (p if label == 1 else q)[f] += times * part
        has[f] += 1
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    r[has < min(LEAST, max(1, n // 4))] = 0.0
    name = np.flatnonzero(r)
    place = np.zeros(one, np.int32)
    place[name] = np.arange(len(name), dtype=np.int32)
    total = int(has[name].sum(dtype=np.int64))
    column, value = np.empty(total, np.int32), np.empty(total, np.float32)
    full, ends, at = [], [], 0
    for i, text in enumerate(texts):
        f, times = counted(text)
        kept = r[f] != 0
        to = at + int(kept.sum())
        if to > at:
            column[at:to], value[at:to] = place[f[kept]], times[kept] * scale[i]
            full.append(i)
            ends.append(to)
        at = to
    full, ends = np.array(full, np.int64), np.array(ends, np.int64)
    size = np.diff(ends, prepend=0)
    parts, at = [], 0  # (first row, end row, first feature, end feature)
    while at < len(full):
        low = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, low + PART, "right")))
        parts.append((at, to, low, int(ends[to - 1])))
        at = to
    scaled, k = r[name], len(name)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z, weight, g = np.full(n, x[k]), scaled * x[:k], np.zeros(k + 1)
        for i, j, low, high in parts:
            z[full[i:j]] += np.add.reduceat(weight[column[low:high]] * value[low:high], ends[i:j] - size[i:j] - low)
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        for i, j, low, high in parts:
            g[:k] += np.bincount(column[low:high], weights=np.repeat(error[full[i:j]], size[i:j]) * value[low:high], minlength=k)
        g[:k] = g[:k] * scaled / n + PENALTY * x[:k]
        g[k] = error.mean()
        return float((np.logaddexp(0, z) - y * z).mean() + PENALTY / 2 * (x[:k] @ x[:k])), g

    x = minimum(loss, np.zeros(k + 1))
    weights = np.zeros(one, np.float32)
    weights[name] = scaled * x[:k] * (RATE / UNIT)
    return weights, float(x[k])


def train(docs: DataFrame, labels: DataFrame, is_train: Column, label: str = "toxic", per_class: int = 1000) -> tuple[bytes, float]:
    """The model: packed weights (empty: none) and the intercept."""
    sample, shares = labelled_sample(docs, labels, label, is_train, per_class)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        y = pdf["y"].to_numpy(np.float64)
        counts = (int((y == 0).sum()), int((y == 1).sum()))
        if min(counts) == 0:
            return pd.DataFrame({"weights": [b""], "bias": [0.0]})
        weights, bias = fit(pdf["text"].tolist(), y)
        return pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias + prior_shift(shares, counts)]})

    # 2 * per_class texts at most meet in one task.
    model = sample.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lambda pdf: run(pdf), "weights binary, bias double").head()
    if model is None or not model.weights:
        return b"", math.log((shares[1] + 1e-9) / (shares[0] + 1e-9)) if sum(shares) else 0.0
    return bytes(model.weights), model.bias


def score(docs: DataFrame, model: tuple[bytes, float], text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for each whole text."""
    packed, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]  # 2 ** BITS floats
    schema = T.StructType([*docs.schema.fields, T.StructField(free_name(docs, out), T.DoubleType())])
    at, names = docs.columns.index(text), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.frombuffer(packed.value, np.float32) if packed.value else np.zeros(1 << BITS, np.float32)
        scorer = Scorer(weights, bias)
        for batch in batches:
            got = [scorer.score(x.as_py() or "") for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=names)

    return docs.mapInArrow(run, schema)


def predictions(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic", at: float = 0.5) -> DataFrame:
    model = train(docs, labels, ~held_out, label)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= at, 1).otherwise(0).alias("predicted"))
