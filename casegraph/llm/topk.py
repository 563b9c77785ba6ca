"""Exact top-k search: the k highest inner products of each query vector over all other vectors.

Queries are dealt into blocks and all vectors into shards of bounded size; each pair of a block and a shard is one tile,
a task's group of its own. A tile is a matrix product, taken in strips of queries, of which each query keeps its k best
by partial selection. The short lists of a query then meet in a tree, `FAN` tiles a step, so no group holds more than
`FAN` lists however many shards there are. What is shuffled is a block and a shard for each tile (some 5 MB for about a second
of products) and k entries for each query and shard; nothing is broadcast or collected, and blocks and shards keep their size as
the table grows.

Components are turned into floor(scale * x). Products are exact: in floats while every partial sum fits their mantissa,
else in 64-bit integers, else in whole numbers of any length.

Defined results: vectors that are null, or hold null or non-finite components (also after scaling), take no part; an empty
vector is one, and shorter vectors count as filled with zeros; a product beyond the range of a long counts as the end of that range;
equal scores go to the smaller id, a null id last, and are taken as often as there are rows; a null id is no query; rows
repeated in id and vector are told apart: each is a query, and a candidate of the others; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm.common import materialise, table

K = 20
QUERY_BLOCK = 4096
SHARD = 16384
STRIP = 256
FAN = 16
SCALE = 64
EVERY = 20
LONG = (1 << 63) - 1
LISTS = "query long, shard int, top array<struct<cost:long,no_id:boolean,id:long,copies:long>>"


def finite(vector: Column, scale: int) -> Column:
    """Whether a vector is there and all of its scaled components are finite numbers."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda e: F.coalesce(F.abs(e.cast("double") * scale) < float("inf"), F.lit(False))), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, scale: int, width: int | None = None) -> np.ndarray:
    """floor(scale * x) of a list column as whole doubles, one row a vector, filled with zeros to `width` or the longest."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.asarray(column.value_lengths(), np.int64) if len(column) else np.zeros(0, np.int64)
    flat = np.floor(np.asarray(column.flatten(), np.float64) * scale)
    width = int(n.max(initial=0)) if width is None else width
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    out[np.arange(width) < n[:, None]] = flat
    return out


def products(q: np.ndarray, c: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of whole doubles; most bounds every partial sum."""
    if most < 1 << 24:
        return q.astype(np.float32) @ c.astype(np.float32).T
    if most < 1 << 53:
        return q @ c.T
    if most < 1 << 62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = np.array([[int(x) for x in v] for v in q], object).reshape(q.shape) @ np.array([[int(x) for x in v] for v in c], object).reshape(c.shape).T
    return np.clip(whole, -LONG, LONG).astype(np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, equal ones by column; ordered."""
    n = scores.shape[1]
    if scores.dtype != np.int64:
        keys = scores.astype(np.float64) * n - np.arange(n)  # one key for score and place, exact below 2**53
        at = np.argpartition(-keys, k - 1, axis=1)[:, :k] if k < n else np.broadcast_to(np.arange(n), scores.shape)
        return np.take_along_axis(at, np.argsort(-np.take_along_axis(keys, at, 1), axis=1), 1)
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def _tile(k: int, scale: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Lists of one block of queries over one shard."""
        schema = pa.schema([("query", pa.int64()), ("shard", pa.int32()), ("top", pa.list_(pa.struct([("cost", pa.int64()), ("no_id", pa.bool_()), ("id", pa.int64()), ("copies", pa.int64())])))])
        if not len(left) or not len(right):
            return schema.empty_table()
        ids, none = np.asarray(right["id"].fill_null(0), np.int64), np.asarray(right["id"].is_null())
        order = np.lexsort((ids, none))  # places in the shard follow ids
        ids, none, uid, copies = ids[order], none[order], np.asarray(right["uid"], np.int64)[order], np.asarray(right["copies"], np.int64)[order]
        q, c = matrix(left["asked"], scale), matrix(right["vector"], scale)[order]
        width = max(q.shape[1], c.shape[1])
        q, c = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, c))
        most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, width)
        query, by_uid = np.asarray(left["query"], np.int64), np.argsort(uid)
        own = by_uid[np.minimum(np.searchsorted(uid, query, sorter=by_uid), len(uid) - 1)]
        own = np.where(uid[own] == query, own, -1)
        take, parts, ends = min(len(ids), k + 1), [], [np.zeros(1, np.int64)]
        for a in range(0, len(q), STRIP):
            scores = products(q[a : a + STRIP], c, most)
            if scores.dtype != np.int64 and (most + 1) * len(ids) >= 1 << 53:
                scores = scores.astype(np.int64)
            at = best(scores, take)
            score = np.take_along_axis(scores, at, 1).astype(np.int64)
            many = copies[at] - (at == own[a : a + STRIP, None])  # a row is no candidate of its own
            good = many > 0
            good &= np.cumsum(good, 1) <= k
            at, score, many = at[good], score[good], many[good]
            parts.append(pa.StructArray.from_arrays([pa.array(-score), pa.array(none[at]), pa.array(ids[at], mask=none[at]), pa.array(many)], names=["cost", "no_id", "id", "copies"]))
            ends.append(ends[-1][-1] + np.cumsum(good.sum(1)))
        top = pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.concat_arrays(parts))
        return pa.table([pa.array(query), pa.array(np.full(len(query), key[1].as_py(), np.int32)), top], names=["query", "shard", "top"]).cast(schema)

    return run


def _merged(lists: DataFrame, n: int, k: int) -> DataFrame:
    """The lists of each query over n shards, merged in a tree."""
    while n > 1:
        n = -(-n // FAN)
        lists = lists.groupBy("query", F.floor(F.col("shard") / FAN).cast("int").alias("shard")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    return lists


def search(vectors: DataFrame, is_query: Column | None = None, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, shard: int = SHARD) -> DataFrame:
    """query_id, rank, <id_col>, score: the k best candidates of each row for which is_query (over id_col) holds."""
    is_query = F.col(id_col) % EVERY == 0 if is_query is None else is_query
    rows = vectors.where(finite(F.col(vector_col), scale)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.groupBy("id", "vector", "asks").agg(F.count("*").alias("copies")).withColumn("uid", F.monotonically_increasing_id())
    rows = materialise(rows)
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    n_shards, n_blocks = max(1, -(-n // shard)), max(1, -(-asked // query_block))
    dealt = lambda m: F.pmod(F.xxhash64("uid"), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    blocks = rows.where("asks").select(F.col("uid").alias("query"), F.col("vector").alias("asked"), dealt(n_blocks).alias("block")).withColumn("shard", each(n_shards))
    shards = rows.select(*[F.col(c).alias(c) for c in ("uid", "id", "vector", "copies")], dealt(n_shards).alias("shard")).withColumn("block", each(n_blocks))
    lists = blocks.groupBy("block", "shard").cogroup(shards.groupBy("block", "shard")).applyInArrow(_tile(k, scale), LISTS)
    lists = _merged(lists, n_shards, k)
    found = lists.join(rows.where("asks").select(F.col("uid").alias("query"), F.col("id").alias("query_id"), F.col("copies").alias("asked")), "query")
    entries = F.slice(F.flatten(F.transform("top", lambda t: F.array_repeat(F.struct(t["id"].alias("id"), (-t["cost"]).alias("score")), F.least(t["copies"], F.lit(k)).cast("int")))), 1, k)
    found = found.select("query_id", F.posexplode(entries).alias("place", "entry"), "asked").withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "asked")))
    return found.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("entry.id").alias(id_col), F.col("entry.score").alias("score"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS u, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
p AS (SELECT q.u, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.u <> c.u WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY u ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM p) WHERE rank <= 20
"""
