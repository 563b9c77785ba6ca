"""Quality classifier: supervised subword embeddings.

Hashed words, word pairs and character n-grams have learned vectors, whose mean over a document goes through a
linear softmax; both layers are trained together by stochastic gradient descent in numpy, one document a step.
A word that repeats the one before it makes the pair <same>, whatever the word. As the mean is linear, scoring
needs one number per bucket (vector times output weights), so a document costs one table lookup per feature
and never shuffles.

Training draws a bounded sample (features.learn) of labelled rows outside the held-out quarter, in one task. Labels
are judged by doc_id: if they contradict, the lowest quality counts.

Defined results: null and empty texts have no feature and get the score of the bias alone; texts of any length are
scored whole (features: parts of 4 MB); repeated rows are scored each; equal texts have equal scores; without any label
every score is 0.5; an empty table gives no rows; columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm import features as ft
from casegraph.llm import text as tx
from casegraph.llm.common import fresh, others, quoted, table

BITS = 17
DIM = 8
NGRAMS = (2, 3, 4)
EPOCHS = 6
RATE = 0.5
THRESHOLD = 0.7
BLOCK = 1 << 19  # bytes of text scored at a time


def occurrences(data: np.ndarray, at: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and buckets of all features of a block, one kind at a time: words, word pairs, character n-grams."""
    shift, last = np.uint64(64 - bits), np.zeros(0, np.uint64)
    for part, part_at in tx.word_parts(data, at, ~tx.BLANK):
        row, start, end = tx.words(part, part_at, ~tx.BLANK)
        h = tx.span_hashes(part, start, end)
        yield row, ((h * np.uint64(3)) >> shift).astype(np.int32)
        h, row = np.concatenate([last, h]), np.concatenate([np.zeros(len(last), row.dtype), row])  # the last word of the part before
        if len(h) > 1:
            inside = row[1:] == row[:-1]
            pair = np.where(h[1:] == h[:-1], np.uint64(0x5A5A5A5A5A5A5A5A), tx.mix64(h[:-1] * np.uint64(31) + h[1:]))
            yield row[1:][inside], (pair[inside] >> shift).astype(np.int32)
        last = h[-1:]
        del row, start, end, h
    for points, p_at, old in tx.point_parts(data, at, max(NGRAMS) - 1):
        for n in NGRAMS:
            yield ft.char_ngrams(points, p_at, n, bits, old)


def tally(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one text and their counts."""
    return ft.tallied(b for _, b in occurrences(text, np.array([0, len(text)])))


class Model:
    """One number per bucket and a bias: the difference of the two softmax inputs."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table.astype(np.float32), float(bias)

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(at) - 1
        total, count = np.zeros(n), np.zeros(n)
        for row, bucket in occurrences(data, at):
            total += np.bincount(row, self.table[bucket], n)
            count += np.bincount(row, minlength=n)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -30, 30)))


def train(docs: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """docs: buckets, their counts, label."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out = np.zeros((dim, 2), np.float32)
    bias = np.zeros(2, np.float32)
    docs = [d for d in docs if len(d[0])]
    steps = max(1, epochs * len(docs))
    for e in range(epochs):
        for k, d in enumerate(rng.permutation(len(docs))):
            u, c, label = docs[d]
            share = c / c.sum()
            lr = rate * (1 - (e * len(docs) + k) / steps)
            v = vectors[u]
            hidden = share @ v
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1  # gradient of the loss by the softmax input
            back = out @ p
            out -= lr * np.outer(hidden, p)
            bias -= lr * p * 0.1
            # Every vector takes its share of the step, scaled up as the mean makes it small.
            vectors[u] = v - (lr * len(u) ** 0.5) * share[:, None] * back
    w = out[:, 1] - out[:, 0]
    return Model(vectors @ w, bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, n: int = ft.SAMPLE_ROWS) -> Model:
    """Learn from labelled documents outside the held-out quarter."""
    marks = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("_quality"))

    def trained(taken: list) -> dict:
        model = train(taken)
        return {"weights": model.table.tobytes(), "bias": model.bias}

    got = ft.learn(docs.select("doc_id", "text"), marks, "_quality", tally, trained, "weights binary, bias double", n)
    return Model(np.frombuffer(got["weights"], np.float32), got["bias"]) if got else Model(np.zeros(1 << BITS), 0.0)


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs plus score and predicted; the text stays."""
    text = fresh(docs, "_text")
    rows = docs.select(*quoted(others(docs, "score", "predicted")), F.col("text").alias(text))
    out = ft.scored(rows, [("score", pa.float64(), "double")], lambda data, at: [model.score(data, at)], text, BLOCK)
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = ft.scored(docs, [("score", pa.float64(), "double")], lambda data, at: [model.score(data, at)], limit=BLOCK)
    return out.select("doc_id", ft.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
