"""Quality: averaged subword embeddings with a softmax, fitted by stochastic descent.

A word (a run without ASCII white space) stands for its own hashed vector and those of
the n-grams of one to three characters in it, the blanks at its ends included; a pair
of equal words side by side stands for one more, whatever the word. A document is
the mean of all these vectors; a linear layer and a softmax give the classes. Plain
numpy stochastic gradient descent learns both layers from at most ``per_class``
labelled texts of each class, of at most ``LONGEST`` characters each.

With two classes the logit is a mean of one number per feature, so scoring keeps
only those numbers, and hashes all words and n-grams of a piece of text at once. It
reads every whole text; one of more than ``CHUNK`` characters in pieces cut at blanks.

Defined results: null, empty and blank texts have no features and score by the
intercept; repeated rows are scored each; without labelled rows of both classes every
score is the share of label 1, or 0.5 if there are none; labels that are neither 0
nor 1, or null, are ignored; other columns pass unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiltgraph.llm.common import free_name
from quiltgraph.llm.sampling import labelled_sample, prior_shift

BITS = 18
WIDTH = 12
EPOCHS = 12
RATE = 2.0
SEED = 7
SAME = 1  # the bucket of a word like the one before
CHUNK = 1 << 20  # characters hashed at a time

_BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    out = np.full(2 * CHUNK + 3, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def features(piece: str) -> np.ndarray:
    """Buckets, with repeats, of the words of a piece and of their n-grams."""
    b = np.frombuffer(f" {piece} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    blank = (b == 32) | (b - np.uint32(9) < 5)
    b[blank] = 32
    spread = lambda h, n: ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n * 0x9E37)) >> np.uint32(32 - BITS)
    two = b[:-1] * np.uint32(0x01000193) + b[1:] * np.uint32(0x9E3779B1)
    three = two[:-1] * np.uint32(0x01000193) + b[2:] * np.uint32(0x9E3779B1)
    start, end = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1, np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * _POWER[: len(b)], dtype=np.uint64)])
    word = (sums[end] - sums[start]) * _INVERSE[start]
    word ^= word >> np.uint64(31)
    again = np.full(np.count_nonzero(word[1:] == word[:-1]), SAME, np.uint64)
    word = (word * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)
    return np.concatenate([spread(b * np.uint32(0x85EBCA6B), 1)[~blank], spread(two, 2)[~(blank[:-1] & blank[1:])], spread(three, 3)[~blank[1:-1]], word, again])


def pieces(text: str) -> Iterator[str]:
    a = 0
    while a < len(text):
        b = len(text)
        if b - a > CHUNK:
            b = text.rfind(" ", a, a + CHUNK) + 1 or a + CHUNK
        yield text[a:b]
        a = b


def fit(texts: list[str], y: np.ndarray) -> tuple[np.ndarray, float]:
    """(one number for each bucket, intercept): the logit is their mean plus the intercept."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    bags = []
    for text in texts:
        found = [features(x) for x in pieces(text)]
        ids, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        bags.append((ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    steps, done = EPOCHS * len(texts), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(texts)):
            ids, weight = bags[i]
            hidden = weight @ vectors[ids] if len(ids) else np.zeros(WIDTH, np.float32)
            z = hidden @ layer + bias
            e = np.exp(z - z.max())
            error = e / e.sum()
            error[int(y[i])] -= 1
            rate = RATE * (1 - done / steps)
            back = layer @ error
            layer -= rate * np.outer(hidden, error)
            bias -= 0.1 * rate * error
            if len(ids):
                vectors[ids] -= rate * weight[:, None] * back
            done += 1
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


class Scorer:
    def __init__(self, value: np.ndarray, bias: float):
        self.value, self.bias = value, bias

    def score(self, text: str) -> float:
        total, n = 0.0, 0
        for piece in pieces(text):
            ids = features(piece)
            total += float(self.value.take(ids).sum(dtype=np.float64))
            n += len(ids)
        z = self.bias + (total / n if n else 0.0)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def train(docs: DataFrame, labels: DataFrame, is_train: Column, label: str = "quality", per_class: int = 1000) -> tuple[bytes, float]:
    """The model: packed numbers of the buckets (empty: none) and the intercept."""
    sample, shares = labelled_sample(docs, labels, label, is_train, per_class)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        y = pdf["y"].to_numpy(np.int64)
        counts = (int((y == 0).sum()), int((y == 1).sum()))
        if min(counts) == 0:
            return pd.DataFrame({"value": [b""], "bias": [0.0]})
        value, bias = fit(pdf["text"].tolist(), y)
        return pd.DataFrame({"value": [value.tobytes()], "bias": [bias + prior_shift(shares, counts)]})

    # 2 * per_class texts at most meet in one task.
    model = sample.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lambda pdf: run(pdf), "value binary, bias double").head()
    if model is None or not model.value:
        return b"", math.log((shares[1] + 1e-9) / (shares[0] + 1e-9)) if sum(shares) else 0.0
    return bytes(model.value), model.bias


def score(docs: DataFrame, model: tuple[bytes, float], text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for each whole text."""
    packed, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]  # 2 ** BITS floats
    schema = T.StructType([*docs.schema.fields, T.StructField(free_name(docs, out), T.DoubleType())])
    at, names = docs.columns.index(text), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(np.frombuffer(packed.value, np.float32) if packed.value else np.zeros(1 << BITS, np.float32), bias)
        for batch in batches:
            got = [scorer.score(x.as_py() or "") for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=names)

    return docs.mapInArrow(run, schema)


def predictions(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality", at: float = 0.7) -> DataFrame:
    model = train(docs, labels, ~held_out, label)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= at, 1).otherwise(0).alias("predicted"))
