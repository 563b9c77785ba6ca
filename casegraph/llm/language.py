"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of the hashed n-grams are counted over all documents outside the held-out quarter that have a
language, in Spark. The weights are trained by FTRL-proximal with an elastic net (l1 makes them sparse) on a bounded
sample of those (features.learn, in one task), and the probabilities are calibrated by a temperature fitted on a part
of the sample that the weights never saw. Scoring is one dense count per block of documents and never shuffles.

Defined results: null texts and texts without a letter are `und` with score 0; texts of any length are judged whole
(in parts, features.py); repeated rows are scored each; equal scores go to the first language by name; if there is no
language to learn, every text is `und`; an empty table gives no rows; columns named like a result are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm import features as ft
from casegraph.llm import text as tx
from casegraph.llm.common import fresh, others, quoted, table

BITS = 13
NGRAMS = (1, 2, 3)
BLOCK = 1 << 20
ROWS = 64  # rows of a dense block
_ASCII_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str) -> bool:
    """Whether a character is a letter by its Unicode category; numbers of any script are none."""
    return bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text)


def counts(data: np.ndarray, at: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Dense n-gram counts, one row per document of the block."""
    n = len(at) - 1
    out = np.zeros(n << bits, np.float32)
    for points, p_at, old in tx.point_parts(data, at, max(NGRAMS) - 1):
        upper = (points >= 65) & (points <= 90) | (points >= 0xC0) & (points <= 0xDE) & (points != 0xD7)
        points = points + np.where(upper, np.uint32(32), np.uint32(0))
        for k in NGRAMS:
            row, bucket = ft.char_ngrams(points, p_at, k, bits, old)
            out += np.bincount((row.astype(np.int64) << bits) + bucket, minlength=n << bits)
    return out.reshape(n, 1 << bits)


def tally(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one text and their counts."""
    row = counts(text, np.array([0, len(text)]))[0]
    used = np.flatnonzero(row)
    return used, row[used]


def _pieces(data: np.ndarray, at: np.ndarray):
    for a in range(0, len(at) - 1, ROWS):
        b = min(a + ROWS, len(at) - 1)
        yield data[at[a] : at[b]], at[a : b + 1] - at[a]


def document_frequencies(docs: DataFrame, bits: int = BITS) -> tuple[np.ndarray, int]:
    """In how many documents each bucket occurs, and how many documents there are; one vector per task is summed in Spark."""

    def run(batches):
        total, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            data, at = tx.buffers(batch.column("text"))
            n += len(batch)
            for a, b in tx.blocks(at, BLOCK):
                for piece in _pieces(data[at[a] : at[b]], at[a : b + 1] - at[a]):
                    total += (counts(*piece, bits) > 0).sum(0)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], n))], names=["bucket", "n"])

    df = np.zeros(1 << bits, np.int64)
    n = 0
    for r in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most 2**bits + 1 rows
        if r["bucket"] < 0:
            n = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return df, n


def tfidf(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(c) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, idf: np.ndarray, temperature: float = 1.0):
        self.languages, self.weights, self.bias, self.idf, self.temperature = languages, weights.astype(np.float32), bias, idf.astype(np.float32), temperature

    def logits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        parts = [tfidf(counts(*p), self.idf) @ self.weights + self.bias for p in _pieces(data, at)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)))

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = data.tobytes()
        letters = np.array([has_letter(whole[a:b].decode("utf-8", "replace")) for a, b in zip(at[:-1], at[1:], strict=True)], bool)
        if not self.languages:
            return np.full(len(at) - 1, "und", object), np.zeros(len(at) - 1)
        p = softmax(self.logits(data, at) / self.temperature)
        best = p.argmax(1)
        return np.where(letters, np.array(self.languages, object)[best], "und"), np.where(letters, p.max(1), 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.001, epochs: int = 4, seed: int = 11) -> Model:
    """FTRL-proximal, one document a step; every fifth row is left to the temperature. rows: buckets, their counts, language."""
    languages = sorted({v for _, _, v in rows})
    k, size = len(languages), len(idf)
    z, n, w = np.zeros((size, k)), np.zeros((size, k)), np.zeros((size, k))
    zb = nb = b = np.zeros(k)
    rng = np.random.default_rng(seed)
    x = []
    for used, count, v in rows:
        value = np.log1p(count) * idf[used]
        x.append((used, (value / max(np.sqrt((value * value).sum()), 1e-9)).astype(np.float32), languages.index(v)))
    fit, held = [d for i, d in enumerate(x) if i % 5], x[::5] if len(x) >= 10 else x

    def weights(z_, n_, l1_):
        return np.where(np.abs(z_) <= l1_, 0.0, -(z_ - np.sign(z_) * l1_) / ((beta + np.sqrt(n_)) / alpha + l2))

    for _ in range(epochs):
        for d in rng.permutation(len(fit)):
            used, value, label = fit[d]
            wu = weights(z[used], n[used], l1)
            p = softmax((value @ wu + b)[None])[0]
            p[label] -= 1
            g = value[:, None] * p
            sigma = (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / alpha
            z[used] += g - sigma * wu
            n[used] += g * g
            sb = (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha
            zb, nb = zb + p - sb * b, nb + p * p
            b = weights(zb, nb, 0.0)
    w = weights(z, n, l1)
    logits = np.array([value @ w[used] + b for used, value, _ in held]).reshape(-1, k)
    truth = np.array([label for _, _, label in held], int)
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() if len(truth) else 0 for t in grid]
    return Model(languages, w, b, idf, float(grid[int(np.argmin(loss))]))


def fit(docs: DataFrame, n: int = ft.SAMPLE_ROWS) -> Model:
    rows = docs.select("doc_id", "text", "lang").where(~ft.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, total = document_frequencies(rows)
    idf = np.log((1 + total) / (1 + df)) + 1

    def trained(taken: list) -> dict:
        m = train(taken, idf)
        return {"languages": m.languages, "weights": m.weights.tobytes(), "bias": m.bias.tobytes(), "temperature": m.temperature}

    got = ft.learn(rows, None, "lang", tally, trained, "languages array<string>, weights binary, bias binary, temperature double", n)
    if not got:
        return Model([], np.zeros((1 << BITS, 1)), np.zeros(1), idf)
    return Model(got["languages"], np.frombuffer(got["weights"], np.float32).reshape(1 << BITS, -1), np.frombuffer(got["bias"]), idf, got["temperature"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs plus lang_pred and score; the text stays."""
    text = fresh(docs, "_text")
    rows = docs.select(*quoted(others(docs, "lang_pred", "score")), F.col("text").alias(text))
    return ft.scored(rows, [("lang_pred", pa.string(), "string"), ("score", pa.float64(), "double")], model.predict, text, BLOCK)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    out = ft.scored(docs.select("doc_id", "text"), [("lang_pred", pa.string(), "string"), ("score", pa.float64(), "double")], model.predict, limit=BLOCK)
    return out.select("doc_id", ft.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
