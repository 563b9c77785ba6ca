"""Hashed n-gram features of whole texts, as code points in numpy, for the trained scorers.

Each function takes the bytes and offsets of a block of rows and returns, per feature occurrence, its row and
its bucket. Labels, language, source and doc_id never enter. Texts over 4 MB are taken in parts of that size; what runs over a
cut counts with the later part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from casegraph.llm import text as tx

HELD_OUT = 2  # remainder of crc32(doc_id) modulo 4 that is never learnt from
SAMPLE_ROWS = 4000
SAMPLE_FEATURES = 12_000_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def learn(
    docs: DataFrame, marks: DataFrame | None, label: str, tally: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], train: Callable[[list], dict], schema: str, n: int = SAMPLE_ROWS, most: int = SAMPLE_FEATURES
) -> Row | None:
    """What train returns for a sample of labelled texts of any length; None where nothing is labelled.

    docs: doc_id, text (and the label, if marks is None); marks: doc_id, label. The held-out quarter is never drawn.
    The bound: n rows (or one for each label, if there are more labels), equally many of each label where there are as
    many, chosen by hash; of those, in the order of the hash, as many as share `most` feature counts among the labels.
    Of several rows of one doc_id the one of the least digest is taken. tally gives the buckets and counts of one text.

    Texts stay where they are read: tasks turn the drawn ones into counts, and one task trains on those (8 bytes a
    count). The driver gets the model only.
    """
    thin = docs.where(~held_out(F.col("doc_id")))
    thin = thin.select("doc_id", label) if marks is None else thin.select("doc_id").join(marks, "doc_id")
    thin = thin.where(F.col(label).isNotNull()).withColumn("_h", F.md5(F.concat(F.lit("s"), F.col("doc_id").cast("string"))))
    labels = thin.select(label).distinct().count()
    if not labels:
        return None
    # Each task keeps no more than this many rows of a label before anything is shuffled.
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_h", "doc_id"))
    drawn = thin.withColumn("_r", rank).where(F.col("_r") <= max(1, n // labels)).groupBy("doc_id").agg(F.min(label).alias("_label"), F.min("_h").alias("_h"))
    rows = (docs if marks is not None else docs.where(F.col(label).isNotNull())).select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # n rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tx.buffers(batch.column("text"))
            got = [tally(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            packed = [pa.array([x[k].astype(t).tobytes() for x in got], pa.binary()) for k, t in ((0, np.int32), (1, np.float32))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "_label", "_h", "_d")], *packed], names=["doc_id", "_label", "_h", "_d", "buckets", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    of = drawn.schema["_label"].dataType.simpleString()
    counted = rows.select("doc_id", "_label", "_h", F.md5("text").alias("_d"), "text").mapInArrow(count, f"doc_id {kind}, _label {of}, _h string, _d string, buckets binary, counts binary")
    one = counted.repartition(1).sortWithinPartitions("_h", "doc_id", "_d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, used, last = [], {}, object()
        for batch in batches:
            for doc_id, mark, u, c in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "_label", "buckets", "counts")), strict=True):
                if doc_id == last or used.get(mark, 0) * labels > most:
                    continue
                last, u = doc_id, np.frombuffer(u, np.int32)
                used[mark] = used.get(mark, 0) + len(u)
                taken.append((u, np.frombuffer(c, np.float32), mark))
        yield pa.RecordBatch.from_pylist([train(taken)])

    return one.mapInArrow(run, schema).first()


def tallied(parts: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their counts over arrays of buckets."""
    got = [np.unique(p, return_counts=True) for p in parts]
    if len(got) == 1:
        return got[0]
    u, where = np.unique(np.concatenate([x for x, _ in got]), return_inverse=True)
    return u, np.bincount(where, np.concatenate([c for _, c in got]), len(u))


def scored(docs: DataFrame, columns: list[tuple[str, pa.DataType, str]], score, text_col: str = "text", limit: int = tx.BLOCK_BYTES) -> DataFrame:
    """docs with more columns from score(data, at) -> list of arrays; the text column itself goes."""
    from pyspark.sql import types as T

    kept = [c for c in docs.columns if c != text_col and c not in {n for n, _, _ in columns}]
    schema = T.StructType([docs.schema[c] for c in kept])
    for n, _, kind in columns:
        schema = schema.add(n, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tx.buffers(batch.column(text_col))
            made: list[list] = [[] for _ in columns]
            for a, b in tx.blocks(at, limit):
                for out, x in zip(made, score(data[at[a] : at[b]], at[a : b + 1] - at[a]), strict=True):
                    out.append(np.asarray(x))
            arrays = [pa.array(np.concatenate(x) if x else [], t) for x, (_, t, _) in zip(made, columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + arrays, names=schema.names)

    return docs.mapInArrow(run, schema)


def char_ngrams(points: np.ndarray, at: np.ndarray, n: int, bits: int, old: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of the runs of n code points that stay inside one row; where the first `old` points (of one row) have been
    counted before, of those that end after them."""
    if old >= n:
        points = points[old - n + 1 :]
        at = np.array([0, len(points)])
    if len(points) < n:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    h = points[: len(points) - n + 1].astype(np.uint64) + np.uint64(n << 40)
    for k in range(1, n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[k : len(points) - n + 1 + k]
    h = (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    ok = row[: len(h)] == row[n - 1 :]
    return row[: len(h)][ok], h[ok].astype(np.int32)
