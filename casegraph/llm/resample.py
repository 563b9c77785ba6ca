"""Target-distribution importance resampling: documents drawn by how much likelier a target corpus makes their n-grams.

 1. Counts of hashed word 1- to 3-grams (CRC-32 modulo `BUCKETS`) over all documents and all target texts: an array for each task,
    summed in Spark. The gain of a bucket is the log of its two smoothed shares' ratio.
 2. Array-scored weights: a document's weight is the sum of its n-grams' gains, from whole arrays of CRCs: those of words are
    joined into those of n-grams by tables for appended bytes, so no n-gram is ever a string.
 3. A Gumbel draw from a hash of the id makes the highest scores a sample without replacement.
 4. A quantile sketch brackets the cutoff; exact counts outside of the bracket validate it, or it is widened. Only the
    bracket is sorted (dealt by range, so in many tasks) to locate the cutoff exactly.
 5. What is above the cutoff is ranked by ranges: the place in a range plus the rows of the ranges before.

Texts never shuffle; scores (a thin row for each document) are written once. The driver gets an array of `BUCKETS` gains, the
sketch's two quantiles, counts, and a row count for each range.

Defined results: null and empty texts have no words and weigh 0; texts of any length are counted whole; a null id hashes as an
empty one and is ordered last among equal scores; repeated rows are drawn each, as many as the number drawn allows; equal scores go to the smaller id; without
target texts, or without documents, the smoothed shares are those of no counts; an empty table gives no rows; columns named like a
result are replaced.
"""

from __future__ import annotations

import math
import zlib

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegraph.llm import text as tx
from casegraph.llm.common import fresh, materialise, others, quoted, table
from casegraph.llm.features import scored

BUCKETS = 10_000
WIDTH = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
ACCURACY = 10_000  # of the sketch: its ranks err by rows / ACCURACY at most
RANGE_ROWS = 65_536
SHORT = 64  # words up to this many bytes take their tables by length


def _steps() -> np.ndarray:
    """The CRC-32 table of one byte, from its reflected polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> 1) ^ np.where(c & 1, np.uint32(0xEDB88320), np.uint32(0))
    return c


STEP = _steps()


def _appended(tables: np.ndarray) -> np.ndarray:
    return STEP[tables & 255] ^ (tables >> 8)


def _zeros() -> tuple[np.ndarray, np.ndarray]:
    """What appending zero bytes makes of each of a CRC's four bytes: by length up to SHORT + 1, and for powers of two."""
    one = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    short = [one]
    for _ in range(SHORT + 1):
        short.append(_appended(short[-1]))
    powers = [short[1]]
    for _ in range(39):
        powers.append(_apply(powers[-1], powers[-1]))
    return np.stack(short), np.stack(powers)


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


BY_LENGTH, BY_POWER = _zeros()


def followed(crc: np.ndarray, by: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of texts (crc) each followed by one whose CRC is `by` and whose bytes are `length`."""
    short = np.minimum(length, SHORT + 1)
    out = BY_LENGTH[short, 0, crc & 255] ^ BY_LENGTH[short, 1, crc >> 8 & 255] ^ BY_LENGTH[short, 2, crc >> 16 & 255] ^ BY_LENGTH[short, 3, crc >> 24]
    long = np.flatnonzero(length > SHORT + 1)
    if len(long):
        x, left = crc[long], length[long]
        for k in range(int(left.max()).bit_length()):
            x = np.where(left >> k & 1, _apply(BY_POWER[k], x), x)
        out[long] = x
    return out ^ by


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end], byte by byte over all words at once; long words one by one."""
    crc, length = np.full(len(start), 0xFFFFFFFF, np.uint32), end - start
    live = np.flatnonzero(length <= SHORT)
    k = 0
    while len(live):
        crc[live] = STEP[(crc[live] ^ data[start[live] + k]) & 255] ^ (crc[live] >> 8)
        k += 1
        live = live[length[live] > k]
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > SHORT):
        crc[i] = zlib.crc32(data[start[i] : end[i]])
    return crc


def features(data: np.ndarray, at: np.ndarray, buckets: int = BUCKETS, limit: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of words, and rows and buckets of their n-grams, part by part; each n-gram stands in the part of its last word."""
    crcs, lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for low, part_at in tx.word_parts(tx.LOWER[data], at, tx.WORDY, limit):
        row, start, end = tx.words(low, part_at, tx.WORDY)
        old = len(crcs)  # the last words of the part before
        crcs, lengths = np.concatenate([crcs, word_crcs(low, start, end)]), np.concatenate([lengths, end - start])
        row = np.concatenate([np.zeros(old, row.dtype), row])
        spaced = followed(np.full(len(crcs), zlib.crc32(b" "), np.uint32), crcs, lengths)  # of the word after a space
        grams, rows = [crcs[old:]], [row[old:]]
        gram = crcs
        for n in range(1, WIDTH):
            gram = followed(gram[:-1], spaced[n:], lengths[n:] + 1) if len(gram) > 1 else gram[:0]
            same = row[: len(gram)] == row[n : n + len(gram)]
            same[: max(0, old - n)] = False
            grams.append(gram[same])
            rows.append(row[: len(gram)][same])
        yield row[old:], np.concatenate(rows), np.concatenate(grams) % np.uint32(buckets)
        crcs, lengths = (crcs[1 - WIDTH :], lengths[1 - WIDTH :]) if len(at) == 2 else (crcs[:0], lengths[:0])


def counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts: one array for each task, summed in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, at = tx.buffers(batch.column(0))
            for a, b in tx.blocks(at):
                for _, _, bucket in features(data[at[a] : at[b]], at[a : b + 1] - at[a], buckets):
                    total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").where("text IS NOT NULL").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the ratio of a bucket's smoothed shares in target and source."""
    k = len(source)
    s, t = float(source.sum() + k), float(target.sum() + k)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text_col: str = "text") -> DataFrame:
    """docs without the text, with n_words, n_features and weight."""

    def score(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        n = len(at) - 1
        words, many, weight = (np.zeros(n, np.int64) for _ in range(3))
        for word_row, row, bucket in features(data, at, len(gain)):
            words += np.bincount(word_row, minlength=n)
            many += np.bincount(row, minlength=n)
            order = np.argsort(row, kind="stable")  # whole sums, by row
            total = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
            ends = np.searchsorted(row[order], np.arange(n + 1))
            weight += total[ends[1:]] - total[ends[:-1]]
        return [words, many, weight]

    return scored(docs, [("n_words", pa.int64(), "long"), ("n_features", pa.int64(), "long"), ("weight", pa.int64(), "long")], score, text_col)


def bracket(rows: DataFrame, k: int, n: int, accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """Bounds between which the k-th highest of n scores lies, and how many are above: from a quantile sketch, widened
    until the exact counts outside of it leave the k-th inside."""
    width = 2 / accuracy
    while True:
        share = 1 - k / n
        lo, hi = rows.agg(F.percentile_approx("score", F.array(*[F.lit(min(1.0, max(0.0, share + w))) for w in (-width, width)]), accuracy)).first()[0]
        if width >= 1:
            lo, hi = rows.agg(F.min("score"), F.max("score")).first()
        above, inside = rows.agg(F.count_if(F.col("score") > hi), F.count_if(F.col("score").between(lo, hi))).first()
        if above < k <= above + inside:
            return lo, hi, above
        width *= 4


def _ranged(rows: DataFrame, order: list, n: int, name: str) -> tuple[DataFrame, dict[int, int]]:
    """rows with their range and their place in it (from 1) in the given order, and the rows before each range."""
    dealt = materialise(rows.repartitionByRange(max(1, -(-n // RANGE_ROWS)), *order).withColumn(f"{name}_range", F.spark_partition_id()))
    before, total = {}, 0
    for at, many in sorted(dealt.groupBy(f"{name}_range").count().collect()):  # one row for each range
        before[at] = total
        total += many
    return dealt.withColumn(f"{name}_place", F.row_number().over(Window.partitionBy(f"{name}_range").orderBy(*order))), before


def draw(rows: DataFrame, k: int, n: int, id_col: str, live: str, uid: str, rank: str = "rank") -> DataFrame:
    """rows (score, and live for the n that can be drawn; uid tells rows apart) plus rank: 1 to k for the k highest."""
    if not k:
        return rows.withColumn(rank, F.lit(None).cast("long"))
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col(uid).asc()]
    lo, hi, above = bracket(rows.where(live), k, n)
    held = rows.where(live).where(F.col("score").between(lo, hi)).select("score", id_col, uid)
    held, before = _ranged(held, order, rows.where(live).where(F.col("score").between(lo, hi)).count(), "_b")
    at = max(r for r, b in before.items() if b < k - above)
    cut = held.where((F.col("_b_range") == at) & (F.col("_b_place") == k - above - before[at])).first()
    cut_id, own = F.lit(cut[id_col]), F.col(id_col)
    same = (own.isNull() & cut_id.isNull()) | F.coalesce(own == cut_id, F.lit(False))
    ahead = (own.isNotNull() & cut_id.isNull()) | F.coalesce(own < cut_id, F.lit(False))
    drawn = F.col(live) & ((F.col("score") > cut["score"]) | (F.col("score") == cut["score"]) & (ahead | same & (F.col(uid) <= cut[uid])))
    ranked, before = _ranged(rows.where(drawn), order, k, "_k")
    base = F.lit(0).cast("long")
    if len(before) > 1:
        offsets = rows.sparkSession.createDataFrame(list(before.items()), "_k_range int, _k_before long")
        ranked, base = ranked.join(F.broadcast(offsets) if len(before) <= 100_000 else offsets, "_k_range"), F.col("_k_before")
    ranked = ranked.withColumn(rank, F.col("_k_place") + base)
    return rows.where(~drawn).withColumn(rank, F.lit(None).cast("long")).unionByName(ranked.select(*quoted(rows.columns), F.col(rank).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, min_words: int = MIN_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """The columns of docs but the text, plus n_words, n_features, weight, score and rank (null: not drawn).

    target: text. percent of the documents of min_words words or more are drawn.
    """
    made = ("n_words", "n_features", "weight", "score", "rank")
    kept = [c for c in others(docs, *made) if c != "text"]
    names = {c: f"c{k}" for k, c in enumerate(kept)}  # no column of docs meets one made here
    gain = gains(counts(docs, buckets), counts(target, buckets))
    rows = weighed(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], "text"), gain)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(names["doc_id"]).cast("string"), F.lit(""))).cast("binary"), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    rows = rows.withColumn("score", F.col("weight") + F.floor(F.lit(-1000) * F.log(-F.log(share))))
    uid = fresh(rows, "uid")
    rows = materialise(rows.withColumn(uid, F.monotonically_increasing_id()).withColumn("live", F.col("n_words") >= min_words))
    n = rows.where("live").count()
    out = draw(rows, n * percent // 100, n, names["doc_id"], "live", uid).drop(uid, "live")
    return out.withColumnsRenamed({n: c for c, n in names.items()}).select(*quoted(kept), *made)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH bits AS (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(b)),
step AS (SELECT list(c ORDER BY b) AS step FROM bits),
texts AS (SELECT doc_id AS id, 's' AS side, text FROM documents UNION ALL SELECT item_id, 't', text FROM benchmark),
split AS (SELECT id, side, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (SELECT id, side, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT id, side, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM split, range(1, 4) r(n) WHERE len(w) >= n)),
hashed AS (SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(g)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT g FROM grams), step),
placed AS (SELECT id, side, bucket FROM grams JOIN hashed USING (g)),
held AS (SELECT b AS bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM range(10000) r(b) LEFT JOIN placed ON bucket = b GROUP BY b),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM held),
weight AS (SELECT id, sum(gain)::BIGINT AS weight, count(*) AS n FROM placed JOIN gain USING (bucket) WHERE side = 's' GROUP BY id),
scored AS (SELECT id AS doc_id, len(w) >= 20 AS live, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM split LEFT JOIN weight USING (id) WHERE side = 's'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY live ORDER BY score DESC, doc_id) AS r, count(*) FILTER (live) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN live AND r <= 5 * n // 100 THEN r END AS rank FROM ranked
"""
