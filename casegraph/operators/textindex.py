"""GR-11, IO-13, EV-4, CS-6 for many search terms: an inverted index of the runs of one to three characters of texts.

Which rows contain a term (whatever the case) is answered from the postings of its rarest runs, and verified on the rows they name; a term of
three characters or fewer is a run itself, and its postings are the answer. No term scans the texts; all terms of a table are one join. The index is
a stored table: a run is a number (the code points, 21 bits each), a row holds the keys of one run in a block of texts, and rows lie by a
hash of their run, so a search reads only the buckets that its terms need.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.functions.scratch import materialise

BUCKETS = 64
RAREST = 2  # runs of a term that a row must have before it is verified
BLOCK = 2 << 20  # characters whose runs a task sorts at once, or one text
FEW = 100_000  # narrow rows that are broadcast


def _postings_of(points: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs, where each one's rows begin (and the end), and rows: every run of the characters of n rows with the rows that have it."""
    seen = np.zeros(0x110001, bool)
    seen[points] = True
    letters = np.flatnonzero(seen).astype(np.int64)
    width, rows = int(len(letters)).bit_length(), max(1, int(n - 1).bit_length())
    place = np.zeros(0x110001, np.int64)
    place[letters] = np.arange(1, len(letters) + 1)
    c, at = place[points], row.astype(np.int64)
    two, three = at[1:] == at[:-1], at[2:] == at[:-2]
    pair = (c[:-1] << width) | c[1:]
    runs = np.concatenate([c, pair[two], ((pair[:-1] << width) | c[2:])[three]])
    rows_of = np.concatenate([at, at[1:][two], at[2:][three]])
    if 3 * width + rows > 63:  # too many letters for one number: runs are numbered first
        names, runs = np.unique(runs, return_inverse=True)
    else:
        names = None
    both = np.sort((runs << rows) | rows_of)
    both = both[np.diff(both, prepend=-1) != 0]
    runs, rows_of = both >> rows, both & ((1 << rows) - 1)
    first = np.flatnonzero(np.diff(runs, prepend=-1))
    run = runs[first] if names is None else names[runs[first]]
    back, mask = np.concatenate([[0], letters + 1]), (1 << width) - 1
    run = (back[run >> 2 * width] << 42) | (back[(run >> width) & mask] << 21) | back[run & mask]
    return run, np.append(first, len(runs)), rows_of


def _grams(rows: DataFrame) -> DataFrame:
    """run, keys: for each block of rows (key, text: lower case already) its runs of one, two and three characters with the rows that have them."""

    def run(batches):
        for batch in batches:
            keys, texts = batch.column("key"), batch.column("text").to_pylist()
            start = 0
            while start < len(texts):
                stop, size = start + 1, len(texts[start])
                while stop < len(texts) and size + len(texts[stop]) <= BLOCK:
                    size, stop = size + len(texts[stop]), stop + 1
                points = np.frombuffer("".join(texts[start:stop]).encode("utf-32-le", "surrogatepass"), "<u4")
                found, at, who = _postings_of(points, np.repeat(np.arange(stop - start), [len(t) for t in texts[start:stop]]), stop - start)
                held = pa.ListArray.from_arrays(pa.array(at, pa.int32()), keys.slice(start, stop - start).take(pa.array(who)))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), held], names=["run", "keys"])
                start = stop

    return rows.mapInArrow(run, f"run long, keys array<{rows.schema['key'].dataType.simpleString()}>")


def _lowered(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.where(F.length(text) > 0).select(F.col(key).alias("key"), F.lower(text).alias("text"))


def _bucket(run: Column) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(BUCKETS)).cast("int")


def _postings(path: str, rows: DataFrame, key: str) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()
    return rows.sparkSession.read.schema(f"run long, keys array<{kind}>, bucket int").parquet(f"{path}/postings")


def build(rows: DataFrame, path: str, key: str, text: str) -> None:
    """Store the index of rows (key, text): postings (run, keys) by bucket, sorted by run, and how many rows have each run."""
    held = _grams(_lowered(rows, key, text)).withColumn("bucket", _bucket(F.col("run")))
    held = held.repartition("bucket", F.pmod(F.xxhash64(F.get("keys", F.lit(0))), F.lit(4))).sortWithinPartitions("bucket", "run")
    held.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    _postings(path, rows, key).groupBy("run").agg(F.sum(F.size("keys")).alias("n")).write.parquet(f"{path}/counts")


def search(spark: SparkSession, path: str, rows: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key): the rows whose text contains a term, for all terms (term) at once. Null and empty terms find nothing.

    rows: those that the index was built of; only candidates' texts are looked at.
    """
    terms = terms.select("term").where("term IS NOT NULL AND term <> ''").distinct()
    need = _grams(_lowered(terms, "term", "term")).select(F.explode("keys").alias("term"), "run")
    size = F.length(F.lower("term"))
    length = F.when(F.col("run") < 1 << 21, 1).when(F.col("run") < 1 << 42, 2).otherwise(3)
    need = need.where(length == F.least(size, F.lit(3)))
    counts = spark.read.schema("run long, n long").parquet(f"{path}/counts")
    known = need.join(counts, "run", "left").select("term", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run").alias("r"))
    picked = known.groupBy("term").agg(F.slice(F.array_sort(F.collect_list("r")), 1, RAREST).alias("rs"))  # as many as the term is long
    picked = picked.where(F.forall("rs", lambda r: r["n"] > 0)).select("term", F.size("rs").alias("m"), F.explode("rs.run").alias("run"))
    picked = materialise(picked)
    buckets = [r[0] for r in picked.select(_bucket(F.col("run")).alias("b")).distinct().collect()]  # BUCKETS at most
    postings = _postings(path, rows, key).where(F.col("bucket").isin(buckets) if buckets else F.lit(False))
    met = _few(picked).join(postings.select("run", "keys"), "run").select("term", "m", F.explode("keys").alias(key))
    short = met.where(size <= 3).select("term", key).distinct()
    # A key of several rows can come more than once: it is verified then.
    likely = materialise(met.where(size > 3).groupBy("term", key).agg(F.count("*").alias("n"), F.first("m").alias("m")).where("n >= m").select("term", key))
    named = materialise(likely.select(key).distinct())
    texts = rows.select(key, text).join(_few(named), key, "left_semi").select(key, F.lower(text).alias("low"))  # once for a text
    found = _few(likely).join(texts, key).where(F.contains(F.col("low"), F.lower("term")))
    return short.unionByName(found.select("term", key).distinct())


def _few(df: DataFrame) -> DataFrame:
    """df (materialised), marked for broadcast where its counted rows are few."""
    return F.broadcast(df) if df.count() <= FEW else df
