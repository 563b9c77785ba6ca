"""Comparing documents pair by pair on their full shingle sets, without sending a text once for each partner."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm import text as tx
from casegraph.llm.common import materialise, small

SLICE = 512  # members that one head meets in a task


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and sorted distinct 64-bit shingle hashes; A-Z is lower-cased."""
    row, h = tx.hashed_words(data, at, ~tx.BLANK)
    return tx.distinct_by_row(*tx.shingles(row, h, len(at) - 1, width))


def sets_of(column: pa.Array, width: int) -> list[np.ndarray]:
    data, at = tx.buffers(column)
    out = []
    for a, b in tx.blocks(at):
        row, h = shingle_sets(data[at[a] : at[b]], at[a : b + 1] - at[a], width)
        out += np.split(h, np.searchsorted(row, np.arange(1, b - a)))
    return out


def with_heads(pairs: DataFrame) -> DataFrame:
    """pairs (a, b; materialised) as (head, member, slice): the head is the one of more pairs, its members are cut into slices."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    p = pairs.select("a", "b").join(ends.withColumnsRenamed({"id": "a", "n": "n_a"}), "a").join(ends.withColumnsRenamed({"id": "b", "n": "n_b"}), "b")
    first = F.col("n_a") >= F.col("n_b")
    p = p.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("head"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("member"), F.greatest("n_a", "n_b").alias("n"))
    return sliced(p)


def sliced(work: DataFrame) -> DataFrame:
    """work: head, member, n (members of the head), ...; n becomes slice."""
    return work.withColumn("slice", F.pmod(F.xxhash64("member"), F.ceil(F.col("n") / SLICE)).cast("int")).drop("n")


def against_heads(work: DataFrame, docs: DataFrame, width: int, tag: str | None = None) -> DataFrame:
    """Rows (head, slice, member, mark, tag, text): in each partition a head's text, then those of its members.

    work: head, member, slice and, if wanted, mark (boolean) and a number of the head's in the column that tag names.
    A head's text goes out once for each slice of its members, a member's once for each of its pairs; no task holds more
    than one head beside the batch it reads.
    """
    mark, number = F.col("mark") if "mark" in work.columns else F.lit(False), F.col(tag) if tag else F.lit(0)
    work = materialise(work.select("head", "member", "slice", mark.alias("mark"), number.cast("int").alias("tag")))
    ids = materialise(work.select(F.explode(F.array("head", "member")).alias("doc_id")).distinct())
    texts = docs.select("doc_id", "text").join(small(ids), "doc_id", "left_semi")
    heads = work.select("head", "slice", "tag").distinct().join(texts.withColumnRenamed("doc_id", "head"), "head")
    heads = heads.select("head", "slice", F.lit(None).cast("long").alias("member"), F.lit(False).alias("mark"), "tag", "text")
    members = work.join(texts.withColumnRenamed("doc_id", "member"), "member").select("head", "slice", "member", "mark", "tag", "text")
    return heads.unionByName(members).repartition("head", "slice").sortWithinPartitions("head", "slice", F.col("member").asc_nulls_first(), "text")


def streamed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Iterator[tuple[tuple[int, int], int, bool, np.ndarray, np.ndarray]]]:
    """For each batch of against_heads: ((head, tag), member, mark, the head's set, the member's set)."""
    held = {"set": np.zeros(0, np.uint64)}

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for start in range(0, len(batch), 256):
            part = batch.slice(start, 256)
            for head, member, mark, tag, h in zip(*(part.column(c).to_pylist() for c in ("head", "member", "mark", "tag")), sets_of(part.column("text"), width), strict=True):
                if member is None:
                    held["set"] = h
                else:
                    yield (head, tag), member, mark, held["set"], h

    for batch in batches:
        yield rows(batch)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Shared values of two sorted arrays without repeats."""
    return len(np.intersect1d(a, b, assume_unique=True))
