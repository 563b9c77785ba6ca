"""Benchmark decontamination with suffix arrays over the training texts.

Each shard (a block of whole documents inside a task) is reduced to the positions at which a test passage
could start (its first two words stand side by side in some test item; its first word, where an item has
only one), and those suffixes are sorted into a suffix array, compared to the depth of one window. Every test
suffix is then binary-searched: the range of its window's first `width` words gives all places that hold it.
What the hits cover decides which documents are contaminated; neighbouring ones join into verbatim matches, with their places
(`matches`). The many places of a repeated passage are never multiplied with those of its document.

Documents never shuffle. The test items go to the tasks in blocks of bounded size (numbers only, no texts). One block is
one pass over the documents. A larger benchmark takes a pass for each block, one after another: each writes its matches,
which are few, and lets go of the block, so neither the driver nor a task ever holds more than one.

Words are compared by 64-bit hashes (text.word_hashes): a text word and one of v different test words fall together with a chance of v / 2**64.

Defined results: null and empty texts have no words; texts of any length are searched whole; an item without words has no
window; null item_ids are skipped; an item_id with several texts has the windows of all; repeated rows are judged each;
equal windows of several items are found for each; an empty benchmark hits nothing, empty documents give no rows; columns
named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegraph.llm import text as tx
from casegraph.llm.common import BROADCAST_ROWS, materialise, others, quoted, table

WIDTH = 13
BLOCK_MB = 8
SHARD = 1 << 20  # suffixes sorted at a time
RATIO = 20  # contaminated: hit words times this reach the number of words


class TestBlock:
    """The windows of some test items as sorted word numbers, and for each the items and places that have it."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str]], width: int):
        self.width, size = width, 4 * width
        data, at = tx.buffers(pa.array([t for _, t in items], pa.large_string()))
        row, hashes = tx.hashed_words(data[at[0] : at[-1]], at - at[0], tx.WORDY)
        self.vocab, ids = np.unique(hashes, return_inverse=True)
        count = np.bincount(row, minlength=len(items)) if len(items) else np.zeros(0, np.int64)
        n = np.minimum(count, width)  # words of an item's windows
        first, many = np.cumsum(count) - count, np.where(n > 0, count - n + 1, 0)
        item = np.repeat(np.arange(len(items)), many)
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start, length = first[item] + place, n[item]
        padded = np.concatenate([ids + 1, np.zeros(width, np.int64)]).astype(">u4")
        low = np.zeros((len(start), width), ">u4")
        for k in range(width):
            low[:, k] = np.where(length > k, padded[start + k], 0)
        low = np.ascontiguousarray(low).view(f"S{size}").ravel() if len(start) else np.zeros(0, f"S{size}")
        order = np.argsort(low, kind="stable")
        low, item, place, length = low[order], item[order], place[order], length[order]
        new = np.append(True, low[1:] != low[:-1]) if len(low) else np.zeros(0, bool)
        # Distinct windows; the items of each, once, and the first place of each in an item, as ranges.
        self.low, self.lengths = low[new], length[new]
        number = np.cumsum(new) - 1
        ids_of = np.array([i for i, _ in items], np.int64)
        order = np.lexsort((place, item, number))
        number, item, place = number[order], item[order], place[order]
        first_place = np.append(True, (number[1:] != number[:-1]) | (item[1:] != item[:-1])) if len(number) else np.zeros(0, bool)
        self.owner, self.owner_place = item[first_place], place[first_place]
        self.owners = np.searchsorted(number[first_place], np.arange(len(self.low) + 1))
        self.ids = ids_of
        # The window at each place of each item: where a match goes on.
        self.window_at = np.zeros(len(number), np.int64)
        self.begins = np.cumsum(many) - many
        self.window_at[self.begins[item] + place] = number
        self.places = many
        words = self.low.view(">u4").reshape(-1, width).astype(np.uint64) if len(self.low) else np.zeros((0, width), np.uint64)
        high = words.astype(">u4")
        for k in range(width):
            high[self.lengths <= k, k] = 0xFFFFFFFF
        self.high = np.ascontiguousarray(high).view(f"S{size}").ravel() if len(high) else self.low
        two = self.lengths > 1
        self.pairs = np.unique(words[two, 0] << np.uint64(32) | words[two, 1]) if width > 1 else np.zeros(0, np.uint64)
        self.singles = np.unique(words[~two, 0]).astype(np.uint32)

    def search(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of words of each row; word positions (over all rows) and window numbers of all hits."""
        row, h = tx.hashed_words(data, at, tx.WORDY)
        counts = np.bincount(row, minlength=len(at) - 1)
        none = np.zeros(0, np.int64)
        if not len(row) or not len(self.low):
            return counts, none, none
        k = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        ids = np.where(self.vocab[k] == h, k + 1, 0).astype(np.uint32)
        # One zero after each document keeps suffixes inside it.
        padded = np.zeros(len(ids) + len(at) + self.width, np.uint32)
        where = np.arange(len(ids)) + row
        padded[where] = ids
        pair = padded[where].astype(np.uint64) << np.uint64(32) | padded[where + 1]
        begins = np.isin(padded[where], self.singles) if len(self.singles) else np.zeros(len(ids), bool)
        if len(self.pairs):
            j = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            begins |= self.pairs[j] == pair
        suffix = np.flatnonzero(begins)
        if not len(suffix):
            return counts, none, none
        pos, window = [], []
        for a in range(0, len(suffix), SHARD):  # a shard's suffix array
            some = suffix[a : a + SHARD]
            keys = padded[where[some][:, None] + np.arange(self.width)].astype(">u4")
            keys = np.ascontiguousarray(keys).view(f"S{4 * self.width}").ravel()
            order = np.argsort(keys)
            keys = keys[order]
            lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
            found = hi - lo
            rank = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found) + np.repeat(lo, found)
            pos.append(some[order[rank]])
            window.append(np.repeat(np.arange(len(found)), found))
        return counts, np.concatenate(pos), np.concatenate(window)

    def cover(self, counts: np.ndarray, pos: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the hits cover, a maximal run each (row, place in the row, words), and the items they are of (row, item), once each; sorted.

        Work and memory follow the hits (one for each place and window length), not the places of an item that hold them.
        """
        if not len(pos):
            return np.zeros((0, 3), np.int64), np.zeros((0, 2), np.int64)
        first = np.concatenate([[0], np.cumsum(counts)])
        order = np.argsort(pos, kind="stable")
        pos, window = pos[order], window[order]
        row, end = np.searchsorted(first, pos, "right") - 1, np.maximum.accumulate(pos + self.lengths[window])
        head = np.flatnonzero(np.append(True, (pos[1:] > end[:-1]) | (row[1:] != row[:-1])))
        tail = np.append(head[1:], len(pos)) - 1
        runs = np.stack([row[head], pos[head] - first[row[head]], end[tail] - pos[head]], 1)
        pair = np.unique(row * len(self.low) + window)
        row, window = pair // len(self.low), pair % len(self.low)
        many = (self.owners[1:] - self.owners[:-1])[window]
        owner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.owners[window], many)
        return runs, np.unique(np.stack([np.repeat(row, many), self.ids[self.owner[owner]]], 1), axis=0)

    def matches(self, counts: np.ndarray, pos: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Verbatim matches, one a row: row, item, place in the item, place in the row, words; sorted by row and item.

        A match goes on as long as the item does as the row does; the next one begins at the first place of its window. So
        each hit is in one match for each item, wherever else in the item its window stands.
        """
        first = np.concatenate([[0], np.cumsum(counts)])
        many = (self.owners[1:] - self.owners[:-1])[window]
        owner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.owners[window], many)
        pos, window = np.repeat(pos, many), np.repeat(window, many)
        item, place = self.owner[owner], self.owner_place[owner]
        order = np.lexsort((pos, item))
        pos, window, item, place = pos[order], window[order], item[order], place[order]
        row = np.searchsorted(first, pos, "right") - 1
        out, last = [], None
        for r, i, q, p, w in zip(row.tolist(), item.tolist(), place.tolist(), pos.tolist(), window.tolist()):
            on = last[2] + 1 if last else 0
            if last and (r, i, p) == (last[0], last[1], last[3] + 1) and on < self.places[i] and self.window_at[self.begins[i] + on] == w:
                q = on
                out[-1][4] += 1
            else:
                out.append([r, self.ids[i], q, p - first[r], self.lengths[w]])
            last = (r, i, q, p)
        found = np.array(out, np.int64).reshape(-1, 5)
        return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def _blocks(benchmark: DataFrame, width: int, block_mb: float) -> Iterator[TestBlock]:
    """The items in blocks of bounded size, one at a time on the driver."""
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    block, size = [], 0
    for r in rows.toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if size > block_mb * 1e6:
            yield TestBlock(block, width)
            block, size = [], 0
    if block:
        yield TestBlock(block, width)


def _searched(docs: DataFrame, block: TestBlock, kept: list[str], text: str, verbatim: bool = False) -> DataFrame:
    """The columns kept of docs, n_words, `found` and `items`: runs of covered words (place, words) in one flat list, and the distinct
    items; verbatim: matches (item, place in the item, place in the document, words), and no items."""
    schema = T.StructType([docs.schema[c] for c in kept]).add("n_words", "long").add("found", T.ArrayType(T.LongType())).add("items", T.ArrayType(T.LongType()))

    def lists(parts: list[np.ndarray], ends: list[np.ndarray], wide: int) -> pa.ListArray:
        flat = np.concatenate([p[:, 1:].ravel() for p in parts]) if parts else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(ends) * wide, pa.int32()), pa.array(flat, pa.int64()))

    def run(batches):
        for batch in batches:
            data, at = tx.buffers(batch.column(text))
            n_words, found, items = [], [], []
            found_ends, item_ends = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
            for a, b in tx.blocks(at):
                counts, pos, window = block.search(data[at[a] : at[b]], at[a : b + 1] - at[a])
                got, of = (block.matches(counts, pos, window), np.zeros((0, 2), np.int64)) if verbatim else block.cover(counts, pos, window)
                n_words.append(counts)
                for part, parts, ends in ((got, found, found_ends), (of, items, item_ends)):
                    parts.append(part)
                    ends.append(ends[-1][-1] + np.searchsorted(part[:, 0], np.arange(b - a), "right"))
            counted = pa.array(np.concatenate(n_words) if n_words else [], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [counted, lists(found, found_ends, 4 if verbatim else 2), lists(items, item_ends, 1)], names=schema.names)

    return docs.mapInArrow(run, schema)


def _passes(docs: DataFrame, benchmark: DataFrame, width: int, block_mb: float, doc_id: str, text: str) -> DataFrame:
    """docs with n_words, `found` and `items` over all blocks."""
    kept = docs.columns
    blocks = _blocks(benchmark, width, block_mb)
    block, later = next(blocks, TestBlock([], width)), next(blocks, None)
    if later is None:
        return _searched(docs, block, kept, text)
    # Rows alike in doc_id and digest are alike in their matches.
    thin = docs.select(F.col(doc_id).alias("key_id"), F.md5(text).alias("key_text"), F.col(text).alias("text"))
    parts = []
    while block is not None:
        parts.append(materialise(_searched(thin, block, ["key_id", "key_text"], "text").where("size(found) > 0").drop("n_words").distinct()))
        block, later = later, next(blocks, None)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = materialise(every.groupBy("key_id", "key_text").agg(F.flatten(F.collect_list("found")).alias("found"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")))
    rows, size = every.agg(F.count("*"), F.coalesce(F.sum(F.size("found") + F.size("items")), F.lit(0))).first()
    every = F.broadcast(every) if rows <= BROADCAST_ROWS and size <= 10 * BROADCAST_ROWS else every
    counted = _searched(docs, TestBlock([], width), kept, text).drop("found", "items")
    on = F.col(doc_id).eqNullSafe(F.col("key_id")) & (F.md5(text) == F.col("key_text"))
    none = F.array().cast("array<long>")
    return counted.join(every, on, "left").select(*kept, "n_words", F.coalesce("found", none).alias("found"), F.coalesce("items", none).alias("items"))


def _covered(found: str):
    """Words that the runs of a flat list (place, words) cover."""
    each = F.transform(F.sequence(F.lit(0), F.size(found) - 2, F.lit(2)), lambda k: F.struct(F.get(found, k).alias("at"), F.get(found, k + 1).alias("n")))
    each = F.when(F.size(found) > 0, each).otherwise(F.array().cast("array<struct<at:bigint,n:bigint>>"))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("hit"))

    def add(s, m):
        end = m["at"] + m["n"]
        return F.struct(F.greatest(s["end"], end).alias("end"), (s["hit"] + F.greatest(F.lit(0).cast("long"), end - F.greatest(s["end"], m["at"]))).alias("hit"))

    return F.aggregate(F.array_sort(each), start, add, lambda s: s["hit"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, ratio: int = RATIO, block_mb: float = BLOCK_MB) -> DataFrame:
    """docs plus n_words, n_hit, items (ids of items that occur), contaminated."""
    made = ("n_words", "n_hit", "items", "contaminated")
    kept = others(docs, *made)
    names = {c: f"c{k}" for k, c in enumerate(kept)}  # no column of docs meets one made here
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    out = _passes(rows, benchmark, width, block_mb, names["doc_id"], names["text"])
    out = out.withColumns({"n_hit": _covered("found"), "items": F.array_sort("items")}).drop("found")
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (ratio * F.col("n_hit") >= F.col("n_words")))
    return out.withColumnsRenamed({n: c for c, n in names.items()}).select(*quoted(kept), *made)



def matches(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_mb: float = BLOCK_MB) -> DataFrame:
    """Verbatim matches of at least a window: doc_id, item_id, item_pos, doc_pos, n_words (positions in words)."""
    rows, out = docs.select("doc_id", "text"), None
    for block in _blocks(benchmark, width, block_mb):
        part = materialise(_searched(rows, block, ["doc_id"], "text", verbatim=True).where("size(found) > 0").select("doc_id", "found"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = _searched(rows.limit(0), TestBlock([], width), ["doc_id"], "text").select("doc_id", "found")
    found = out.withColumn("k", F.explode(F.sequence(F.lit(0), F.size("found") - 4, F.lit(4))))
    return found.select("doc_id", *[F.get("found", F.col("k") + j).alias(c) for j, c in enumerate(("item_id", "item_pos", "doc_pos", "n_words"))])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    digest = F.sha2(F.array_join(ids, ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
occ AS (SELECT doc_id, dg.n, i, item_id FROM dg JOIN win ON dg.g = win.g AND dg.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id
"""
