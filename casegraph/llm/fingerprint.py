"""Document fingerprints: MinHash signatures, their bands joined in Spark, Jaccard verified.

A signature holds, for each of many universal hash functions (multiply and add on 64 bits, upper half), the least
value over the document's shingles of five words (the whole sequence where there are fewer words; a text without
words has one fixed signature). The likeness of two fingerprints, the share of equal entries, estimates the Jaccard
index of the shingle sets. The signatures are computed by numpy inside tasks, block by block.

`near_heads` joins documents on bands of signature rows: equal sets fold into classes, each class meets the least class of
each of its buckets, and the pairs are verified on the full shingle sets. Links that this leaves out come from the groups of
`near_dedup`, in which what may come before the link found is tried in the order of ids.
`near_pairs` lists all pairs instead: all classes of a bucket meet, slice against slice.

`dealt` gives each document the text after it in doc_id order without a global sort: documents are dealt into ranges
of doc_id of about equal size, one to a task, and the head of each range also goes to the range before it. The ranges'
borders (one number for each 32 MB of texts) are all that the driver sees.

Defined results: null is an empty text; texts of any length are taken whole (a task holds one of them and the next);
repeated rows follow each other in text order, and rows that share a doc_id share the least class and link of theirs; rows
without doc_id go; the last document is followed by the first (a single one by itself); documents without words are in no
class; an empty table gives no rows; other columns are not returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegraph.llm import text as tx
from casegraph.llm.common import materialise, passing, table
from casegraph.llm.near_dedup import THRESHOLD as LINK
from casegraph.llm.near_dedup import may_link, near_duplicates, sketches
from casegraph.llm.pairs import against_heads, common, shingle_sets, sliced, streamed, with_heads

WIDTH = 5
PERMUTATIONS = 128
BANDS = 20  # of six entries: a pair of Jaccard 0.8 shares none with a chance of 0.002
RANGE_BYTES = 32 << 20
THRESHOLD = 0.8
SLICE = 2048  # classes of a bucket on one side of a block
_rng = np.random.default_rng(20240501)
_A = _rng.integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, 4096, dtype=np.uint64)


def signatures(row: np.ndarray, h: np.ndarray, n: int, permutations: int = PERMUTATIONS) -> np.ndarray:
    """One row of `permutations` 32-bit values for each of n documents, from the rows and hashes of their shingles."""
    out = np.full((n, permutations), 0xFFFFFFFF, np.uint32)
    if len(h):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        for k in range(permutations):
            v = ((h * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32)
            out[row[first], k] = np.minimum.reduceat(v, first)
    return out


def _signed(data: np.ndarray, at: np.ndarray, permutations: int, width: int) -> np.ndarray:
    row, h = tx.hashed_words(data, at, ~tx.BLANK)
    return signatures(*tx.shingles(row, h, len(at) - 1, width), len(at) - 1, permutations)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(1)


def borders(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> list[int]:
    """The first doc_id of each range, ascending. docs: doc_id, text."""

    def run(batches):
        size, last, out = 0, None, []
        for batch in batches:
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if doc_id != last and (last is None or size >= range_bytes):
                    out.append(doc_id)
                    size = 0
                size, last = size + n, doc_id
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["cut"])

    thin = docs.select("doc_id", F.octet_length("text").cast("long").alias("n")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return sorted(r["cut"] for r in thin.mapInArrow(run, "cut long").collect())


def range_of(doc_id, cuts: list[int]):
    """How many cuts lie at or below doc_id, less one: by halving, in an expression whose size does not grow with them."""
    all_cuts = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    below = lambda at, step: F.when(F.coalesce(F.get(all_cuts, at + step - 1) <= doc_id, F.lit(False)), at + step).otherwise(at)
    return F.aggregate(steps, F.lit(0), below) - 1


def dealt(docs: DataFrame, notes: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows (part, head, doc_id, note, text) in the order of tasks: a range's documents by doc_id, then the head of the next range.

    docs: doc_id, text (neither null); notes: doc_id, note: they come before the documents of their doc_id (text null).
    """
    cuts = borders(docs, range_bytes)
    spark = docs.sparkSession
    none = F.lit(None).cast(notes.schema["note"].dataType)
    rows = docs.select("doc_id", none.alias("note"), "text").unionByName(notes.select("doc_id", "note", F.lit(None).cast("string").alias("text")))
    rows = rows.select((range_of(F.col("doc_id"), cuts) if cuts else F.lit(0)).alias("part"), F.lit(False).alias("head"), "*")
    to = spark.createDataFrame([((k or len(cuts)) - 1, c) for k, c in enumerate(cuts)], "part int, doc_id long")
    heads = docs.join(F.broadcast(to), "doc_id").groupBy("part", "doc_id").agg(F.min("text").alias("text"))  # broadcast: one row for each 32 MB
    heads = heads.select("part", F.lit(True).alias("head"), "doc_id", none.alias("note"), "text")
    out = rows.unionByName(heads).repartitionById(max(1, len(cuts)), F.col("part"))
    return out.sortWithinPartitions("part", "head", "doc_id", F.col("text").asc_nulls_first())


def _edit(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half] if half else text


def fingerprints(docs: DataFrame, permutations: int = PERMUTATIONS, width: int = WIDTH, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id, near_id, near_jaccard, group_id.

    class_id: the least doc_id of the same shingle set; near_id, near_jaccard: the least earlier class that is linked with it; group_id: the
    least doc_id that links lead to.
    """
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id", "near_id", "near_jaccard", "group_id"]
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = near_heads(docs, permutations=permutations, width=width)
    notes = near.select("doc_id", F.struct("class_id", "near_id", "near_jaccard", "group_id").alias("note"))

    def made(ids, texts, told, after):
        """A block of documents, with the text after the last."""
        follow = [*texts[1:], after]
        edited = [_edit(a, b) for a, b in zip(texts, follow, strict=True)]

        def sign(x):
            data, at = tx.buffers(pa.array(x, pa.large_string()))
            return np.concatenate([_signed(data[at[a] : at[b]], at[a : b + 1] - at[a], permutations, width) for a, b in tx.blocks(at)])

        own, changed = sign([*texts, after]), sign(edited)
        text_of = lambda s: s.astype(">u4").tobytes().hex()
        columns = [ids, [len(t) for t in texts], [hashlib.sha256(e.encode()).hexdigest() for e in edited], [text_of(s) for s in own[:-1]], [text_of(s) for s in changed], likeness(own[:-1], changed), likeness(own[:-1], own[1:])]
        columns += [[t[k] for t in told] for k in range(4)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches):
        ids, texts, told, size, note = [], [], [], 0, (None, None)
        for batch in batches:
            for doc_id, head, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "head", "note", "text")), strict=True):
                if text is None:
                    if note[0] != doc_id:  # the least of several
                        note = doc_id, tuple(mark.values())
                    continue
                if ids and (size > tx.BLOCK_BYTES or head):
                    yield made(ids, texts, told, text)
                    ids, texts, told, size = [], [], [], 0
                if not head:
                    ids.append(doc_id)
                    texts.append(text)
                    told.append(note[1] if note[0] == doc_id else (None,) * 4)
                    size += len(text)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long, near_id long, near_jaccard double, group_id long"
    return dealt(docs, notes, range_bytes).mapInArrow(run, schema)


def banded(docs: DataFrame, permutations: int, bands: int, width: int) -> DataFrame:
    """doc_id, set_id, keys (a hash of each band of the signature) of the documents that have words."""
    rows = permutations // bands

    def run(batches):
        for batch in batches:
            data, at = tx.buffers(batch.column("text"))
            sets, keys = [], []
            for a, b in tx.blocks(at):
                row, h = shingle_sets(data[at[a] : at[b]], at[a : b + 1] - at[a], width)
                sig = signatures(row, h, b - a, permutations).astype(np.uint64)
                made = np.tile(np.arange(bands, dtype=np.uint64), (b - a, 1))
                for k in range(rows):
                    made = tx.mix64(made * np.uint64(0xD6E8FEB86659FD93) + sig[:, k : rows * bands : rows])
                keys.append(made.view(np.int64))
                cut = np.searchsorted(row, np.arange(b - a + 1)).tolist()
                sets += [hashlib.blake2b(h[x:y].tobytes(), digest_size=16).digest() if y > x else None for x, y in zip(cut[:-1], cut[1:], strict=True)]
            flat = np.concatenate(keys) if keys else np.zeros((0, bands), np.int64)
            lists = pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * bands, pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary()), lists], names=["doc_id", "set_id", "keys"])

    out = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "doc_id long, set_id binary, keys array<long>")
    return out.where("set_id IS NOT NULL")


def _verified(pairs: DataFrame, docs: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """a, b, jaccard of the pairs (a, b; materialised) that the full shingle sets link."""
    num, den = threshold

    def verify(batches):
        for rows in streamed(batches, width):
            got = []
            for (head, _), member, _, x, y in rows:
                same = common(x, y)
                union = len(x) + len(y) - same
                if union and den * same >= num * union:
                    got.append((min(head, member), max(head, member), same / union))
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "jaccard"])

    return against_heads(with_heads(pairs), docs, width).mapInArrow(verify, "a long, b long, jaccard double")


def _placed(members: DataFrame) -> DataFrame:
    """members (id, group) of groups of two or more with their place by id, from 0: by ranges, so that a group may lie over several tasks."""
    several = members.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    rows = materialise(members.join(several, "group").repartitionByRange("group", "id").withColumn("range", F.spark_partition_id()))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    offsets = rows.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("range").orderBy("group", "id")) + F.col("before")
    rows = materialise(rows.join(F.broadcast(offsets), "range").select("id", "group", at.alias("at")))
    return rows.join(rows.groupBy("group").agg(F.min("at").alias("first")), "group").select("id", "group", (F.col("at") - F.col("first")).alias("place"))


def near_heads(docs: DataFrame, threshold: tuple[int, int] = LINK, permutations: int = PERMUTATIONS, bands: int = BANDS, width: int = WIDTH) -> DataFrame:
    """doc_id, class_id (least doc_id of the same shingle set), near_id, near_jaccard, group_id for documents with words.

    near_id is the least earlier class whose Jaccard index is at least the threshold, else null; group_id the least doc_id reachable by
    such links (`near_dedup.near_duplicates`). Each class first meets the least class of each bucket that it is in. What comes before the
    link found there, or before the class itself, in its group is then tried in the order of ids, four times as many each round, until
    a link is found: the union of two sketches sorts out what is clearly apart, the rest is verified. In a group of near copies few
    classes come before the least link; a group in which all are far from the first ones takes the square of its classes, on disk.
    """
    with passing() as kept:
        signed = materialise(banded(docs, permutations, bands, width))
        classes = materialise(signed.groupBy("set_id").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys")))
        keyed = classes.select("id", F.explode("keys").alias("key"))
        heads = keyed.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head")
        met = materialise(keyed.join(heads, "key").where("id > head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct())
        links = materialise(_verified(met, docs, width, threshold))
        group = materialise(near_duplicates(docs, width, threshold).groupBy("doc_id").agg(F.min("component_id").alias("group")))
        placed = materialise(_placed(classes.select("id").distinct().join(group.withColumnRenamed("doc_id", "id"), "id")))
        of = placed.select("group", "place", F.col("id").alias("a"))
        least = links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("a")).join(of.withColumnsRenamed({"group": "of", "place": "upto"}), "a")
        todo = placed.join(least, "id", "left").select("id", "group", F.when(F.col("of") == F.col("group"), F.col("upto")).otherwise(F.col("place")).cast("int").alias("upto"))
        todo, sketched, done, step = materialise(todo.where("upto > 0")), None, 0, 1
        while not todo.isEmpty():  # ends: places run out
            tried = todo.select(F.col("id").alias("b"), "group", F.explode(F.sequence(F.lit(done), F.least("upto", F.lit(done + step)) - 1)).alias("place"))
            if sketched is None:
                sk = sketches(docs.join(placed.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), width)
                sketched = materialise(sk.where("n > 0").select(F.col("doc_id").alias("id"), "n", "sketch"))
            pairs = materialise(may_link(tried.join(of, ["group", "place"]).select("a", "b"), sketched, threshold).distinct())
            found = materialise(_verified(pairs, docs, width, threshold))
            links, done, step = links.unionByName(found), done + step, 4 * step
            todo = materialise(todo.join(found.select(F.col("b").alias("id")), "id", "left_anti").where(F.col("upto") > done))
        near = links.groupBy(F.col("b").alias("id")).agg(F.min(F.struct("a", "jaccard")).alias("near"))
        out = signed.select("doc_id", "set_id").join(classes.select("set_id", "id").join(near, "id", "left"), "set_id")
        out = out.groupBy("doc_id").agg(F.min(F.struct("id", "near")).alias("b")).join(group, "doc_id")
        out = materialise(out.select("doc_id", F.col("b.id").alias("class_id"), F.col("b.near.a").alias("near_id"), F.col("b.near.jaccard").alias("near_jaccard"), F.col("group").alias("group_id")))
        kept.append(out)
    return out


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD, permutations: int = PERMUTATIONS, bands: int = BANDS, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs of class representatives a < b with their Jaccard index, and each doc_id's class.

    A class holds the documents of equal shingle sets; its representative is its smallest doc_id. All pairs of classes
    that share a bucket in any band are verified, so the work grows with the square of a bucket's classes, as the
    pairs listed do.
    """
    with passing() as kept:
        signed = materialise(banded(docs, permutations, bands, width))
        # Aggregated and joined back: a hot set or bucket may be split over tasks.
        classes = materialise(signed.groupBy("set_id").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys")))
        members = materialise(signed.join(classes, "set_id").select("doc_id", F.col("id").alias("class_id")))
        keyed = classes.select("id", F.explode("keys").alias("key"))
        # Every pair of a bucket meets once, in the block of both slices: no task holds more than two slices.
        counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        keyed = materialise(keyed.join(counts, "key").withColumn("slices", F.ceil(F.col("n") / SLICE).cast("int")).withColumn("slice", F.pmod(F.xxhash64("id"), "slices").cast("int")))
        other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
        x = keyed.select("key", F.col("id").alias("a"), F.col("slice").alias("x"), other.alias("y"))
        y = keyed.select("key", "id", other.alias("x"), F.col("slice").alias("y"))
        met = materialise(x.join(y, ["key", "x", "y"]).where("a < id").select(F.col("a").alias("head"), F.col("id").alias("member")).distinct())
        work = sliced(met.join(met.groupBy("head").agg(F.count("*").alias("n")), "head"))

        def verify(batches):
            for rows in streamed(batches, width):
                got = [(head, member, (same := common(x, y)) / max(1, len(x) + len(y) - same)) for (head, _), member, _, x, y in rows]
                yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "jaccard"])

        pairs = against_heads(work, docs, width).mapInArrow(verify, "a long, b long, jaccard double").where(F.col("jaccard") >= threshold)
        pairs = materialise(pairs)
        kept += [pairs, members]
    return pairs, members


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
