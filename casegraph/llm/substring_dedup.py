"""Exact-substring dedup by suffix sorting, with sampled suffixes sorted externally and the others induced from them.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller doc_id. All texts
are judged as they came in, as UTF-8; matches never cross documents.

 0. Exact copies fold first, by digest: all of a later copy goes (if it is as long as a window), and it need not be
    looked at again, as the first copy holds the same windows under a smaller doc_id.
 1. Sampling. Every window of `length` bytes has an anchor: the least-hashed GRAM bytes inside it (the leftmost of
    equals). It depends on the window's bytes alone, so equal windows have equal anchors at equal offsets. Windows in
    a row with one anchor are a run.
 2. Documents are dealt once into chunks of bounded size. Chunks report the hashes of their anchors in packed blocks;
    anchors that one document alone has are out, which leaves the repeated parts of the corpus.
 3. Chunks give the distinct runs of the others: the bytes left and right of the anchor, with the smallest doc_id.
 4. The sampled suffixes (from the anchors on) are sorted by Spark's external sorter, which keeps sorted runs on disk
    and merges them by a priority queue, so shards may be far larger than memory. The tasks read them in order,
    and for each step to the left induce the order of the suffixes one byte longer: stable by that byte, with the
    common-prefix lengths carried along (one more than the range minimum where the byte is equal). Neighbours that
    share `length` bytes are equal windows; each class tells its smallest doc_id. An anchor that stands in very many
    places (`HOT`) is no group that one task could hold: its runs give their windows instead, by 128-bit digest, whose
    smallest doc_ids are found by aggregation.
 5. Chunks mark the bytes of every window that a smaller document has.

The texts are shuffled once (the steps of the plan share that exchange); what goes back and forth are anchor hashes and
the repeated runs. Longer documents than a block are cut into pieces that overlap by length - 1 bytes.

Runs and anchors are told apart by 64- and 48-bit hashes, windows of hot anchors by 128-bit digests. Two different anchors of
one hash only cost work; two of n different runs of a chunk fall together with a chance of n * n / 2**65.

Defined results: null is an empty text; texts of any length are judged whole; ties go to the smaller doc_id; texts shorter than `length` keep all; rows without doc_id count as the smallest
doc_id; equal doc_ids never remove one another; an empty table gives no rows; other columns are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm import text as tx
from casegraph.llm.common import corpus_bytes, materialise, table

LENGTH = 50
GRAM = 20
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 64 << 20
PIECE = 1 << 20
GROUP_ROWS = 100_000
HOT = 4096  # occurrences of an anchor above which its windows are aggregated
NONE = -(1 << 63)


class Pieces:
    """A chunk's texts in doc_id order, as pieces of bounded size: bytes, and per piece the documents in it."""

    def __init__(self, docs: pa.Table, length: int, copies: np.ndarray):
        docs = docs.select(["doc_id", "text"])
        docs = docs.filter(pa.array(~np.isin(docs.column("doc_id").to_numpy(), copies)))
        docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = docs.column("doc_id").to_numpy()
        self.data, self.at = tx.buffers(docs.column("text"))
        self.data, self.at = self.data[self.at[0] : self.at[-1]], self.at - self.at[0]
        self.length = length

    def __iter__(self) -> Iterator[tuple]:
        """Offset of each piece, then what runs() tells of it, with the rows of the chunk."""
        for a, b in tx.blocks(self.at, PIECE):
            lo, hi = int(self.at[a]), int(self.at[b])
            for start in range(lo, max(lo + 1, hi - self.length + 1), PIECE):
                end = min(hi, start + PIECE + self.length - 1) if hi - lo > PIECE else hi
                got = runs(self.data[start:end], np.clip(self.at[a : b + 1] - start, 0, end - start), self.length)
                if got is not None:
                    anchor, value, first, last, row = got
                    yield start, anchor, value, first, last, row + a
                if hi - lo <= PIECE:
                    break

    def bytes_of(self, start: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """64-bit hashes of the bytes of runs."""
        end = int(last.max()) + self.length
        return tx.span_hashes(self.data[start : start + end], first, last + self.length)


def runs(data: np.ndarray, at: np.ndarray, length: int):
    """(anchor, value, first, last, row) of the runs of windows: position and 48-bit hash of the anchor, first and last window, row."""
    n = len(data) - length + 1
    if n <= 0:
        return None
    power, inverse = tx._powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    h = (total[GRAM:] - total[:-GRAM]) * inverse[: len(data) - GRAM + 1]
    h = tx.mix64(h) & np.uint64(0xFFFFFFFFFFFFFF00)
    wide, covered = length - GRAM + 1, 1
    while covered < wide:
        step = min(covered, wide - covered)
        h = np.minimum(h[:-step], h[step:] + np.uint64(step))
        covered += step
    anchor = np.arange(n) + (h & np.uint64(255)).astype(np.int64)
    valid = np.ones(n, bool)  # not across the end of a row
    for back in range(1, length):
        cut = at[1:-1] - back
        valid[cut[(cut >= 0) & (cut < n)]] = False
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
    cuts = at[1:-1]
    new[cuts[cuts < n]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    good = valid[first]
    first, last = first[good], last[good]
    if not len(first):
        return None
    row = np.searchsorted(at, first, "right") - 1
    return anchor[first], h[first] >> np.uint64(16), first, last, row


def _pack(values: np.ndarray) -> bytes:
    """48-bit numbers as 6 bytes each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def _anchor_blocks(length: int, buckets: int):
    def run(docs: pa.Table, copies: pa.Table) -> pa.Table:
        chunk = docs.column("chunk")[0].as_py() if len(docs) else None
        values, rows = [], []
        for _, _, value, _, _, row in (pieces := Pieces(docs, length, _ids(copies))):
            values.append(value)
            rows.append(row)
        out = {"bucket": [], "chunk": [], "values": [], "several": [], "counts": []}
        if values:
            value, owner = np.concatenate(values), pieces.ids[np.concatenate(rows)]
            order = np.argsort(value, kind="stable")
            value, owner = value[order], owner[order]
            head = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            several = np.minimum.reduceat(owner, head) != np.maximum.reduceat(owner, head)
            count = np.diff(np.append(head, len(owner)))
            value = value[head]
            bucket = (value % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                out["bucket"].append(int(bucket[part[0]]))
                out["chunk"].append(chunk)
                out["values"].append(_pack(value[part]))
                out["several"].append(np.packbits(several[part]).tobytes())
                out["counts"].append(np.minimum(count[part], 1 << 30).astype("<u4").tobytes())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)})

    return run


def _ids(copies: pa.Table) -> np.ndarray:
    return np.array([i for i in copies.column("copy").to_pylist() if i is not None], np.int64)


def _shared(blocks: pa.Table) -> pa.Table:
    """Of a bucket, the values that more than one document has, for each chunk that has them; hot: those of very many places."""
    values = [_unpack(v) for v in blocks.column("values").to_pylist()]
    several = [np.unpackbits(np.frombuffer(s, np.uint8), count=len(v)).astype(bool) for s, v in zip(blocks.column("several").to_pylist(), values, strict=True)]
    u, where, n = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    places = np.bincount(where, np.concatenate([np.frombuffer(c, "<u4") for c in blocks.column("counts").to_pylist()]), len(u))
    shared = np.union1d(u[n > 1], np.concatenate([v[s] for v, s in zip(values, several, strict=True)]))
    many = u[places > HOT]
    kept = []
    for c, v in zip(blocks.column("chunk").to_pylist(), values, strict=True):
        v = v[np.isin(v, shared, assume_unique=True)]
        hot = np.isin(v, many, assume_unique=True)
        kept += [(c, _pack(part), h) for part, h in ((v[~hot], False), (v[hot], True)) if len(part)]
    return pa.table({"chunk": pa.array([c for c, _, _ in kept], pa.int64()), "values": pa.array([v for _, v, _ in kept], pa.binary()), "hot": pa.array([h for _, _, h in kept], pa.bool_())})


_RUN = pa.schema([("chunk", pa.int64()), ("run_id", pa.int64()), ("right", pa.binary()), ("left", pa.binary()), ("near", pa.int32()), ("least", pa.int64()), ("hot", pa.bool_())])


def _repeated_runs(length: int):
    """The distinct runs of a chunk with shared anchors: right (from the anchor on), left (before it), near (offset of the anchor in the last window)."""

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        parts = []
        packed = [(_unpack(v), h) for v, h in zip(shared.column("values").to_pylist(), shared.column("hot").to_pylist(), strict=True) if v is not None]
        if len(docs) and packed:
            chunk = docs.column("chunk")[0].as_py()
            wanted, often = np.concatenate([v for v, _ in packed]), np.repeat([h for _, h in packed], [len(v) for v, _ in packed])
            order = np.argsort(wanted)
            wanted, often = wanted[order], often[order]
            pieces = Pieces(docs, length, _ids(shared))
            whole = []
            for start, anchor, value, first, last, row in pieces:
                k = np.minimum(np.searchsorted(wanted, value), len(wanted) - 1)
                mine = wanted[k] == value
                if mine.any():
                    anchor, first, last, row = anchor[mine], first[mine], last[mine], row[mine]
                    whole.append((start + anchor, start + first, start + last, pieces.ids[row], pieces.bytes_of(start, first, last), often[k[mine]]))
            if whole:
                anchor, first, last, owner, digest, hot = (np.concatenate(x) for x in zip(*whole, strict=True))
                order = np.lexsort((owner, digest))
                head = order[np.append(True, digest[order][1:] != digest[order][:-1])]  # the smallest doc_id of each
                anchor, first, last, owner, digest, hot = anchor[head], first[head], last[head], owner[head], digest[head], hot[head]
                text = pieces.data
                parts.append(pa.table([
                    pa.array(np.full(len(head), chunk)), pa.array(digest.view(np.int64)), _slices(text, anchor, last + length), _slices(text, first, anchor),
                    pa.array((anchor - last).astype(np.int32)), pa.array(owner), pa.array(hot),
                ], schema=_RUN))
        return parts[0] if parts else _RUN.empty_table()

    return run


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """data[start:end] as an Arrow binary column."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data[at].tobytes())])


def _range_minimum(x: np.ndarray):
    """Minimum of x over [lo, hi), lo < hi, for arrays of ranges."""
    levels, step = [x], 1
    while 2 * step <= len(x):
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
        step *= 2
    flat = np.concatenate(levels)
    base = np.concatenate([[0], np.cumsum([len(v) for v in levels])])

    def of(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        k = np.frexp((hi - lo).astype(float))[1] - 1
        return np.minimum(flat[base[k] + lo], flat[base[k] + hi - (1 << k)])

    return of


def induce(right: list[bytes], left: list[bytes], near: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs sorted by right in, (run, window, smallest doc_id of equal windows) out; window counts from the run's first.

    Going left one byte at a time, the order of the suffixes is induced from the order before: by the new byte, then as
    before. near: offset of the anchor in the last window of the run; in the first it is len(left).
    """
    n = len(right)
    far = np.array([len(x) for x in left])
    width = max(map(len, right))
    m = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in right), np.uint8).reshape(n, width)
    sizes = np.array([len(x) for x in right])
    # Common prefixes of neighbours; what lies beyond an end differs from everything.
    differ = np.ones((max(0, n - 1), width + 1), bool)
    differ[:, :-1] = m[1:] != m[:-1]
    lcp = np.zeros(n, np.int16)
    lcp[1:] = np.minimum(np.minimum(differ.argmax(1), np.minimum(sizes[1:], sizes[:-1])), length)
    start = np.concatenate([[0], np.cumsum(far)])
    before = np.frombuffer(b"".join(left), np.uint8)
    order = np.arange(n)
    runs_out, windows, smallest = [], [], []
    for o in range(int(far.max()) + 1):
        if o:
            has = np.flatnonzero(far[order] >= o)  # the others have no longer suffix
            rows = order[has]
            byte = before[start[rows + 1] - o]
            perm = np.argsort(byte, kind="stable")
            place = has[perm]
            minimum = _range_minimum(lcp)
            new = np.zeros(len(rows), np.int16)
            same = np.flatnonzero(byte[perm][1:] == byte[perm][:-1]) + 1
            if len(same):
                new[same] = np.minimum(minimum(place[same - 1] + 1, place[same] + 1) + 1, length)
            order, lcp = rows[perm], new
        here = np.flatnonzero((near[order] <= o) & (far[order] >= o))
        if len(here):
            equal = np.zeros(len(here), bool)
            if len(here) > 1:
                equal[1:] = _range_minimum(lcp)(here[:-1] + 1, here[1:] + 1) >= length
            head = np.flatnonzero(~equal)
            low = np.repeat(np.minimum.reduceat(least[order[here]], head), np.diff(np.append(head, len(here))))
            runs_out.append(order[here])
            windows.append(far[order[here]] - o)
            smallest.append(low)
    return np.concatenate(runs_out), np.concatenate(windows), np.concatenate(smallest)


_ANSWER = pa.schema([("chunk", pa.int64()), ("run_id", pa.int64()), ("smallest", pa.binary()), ("window", pa.int32()), ("digest", pa.binary()), ("least", pa.int64())])


def _windows(t: pa.Table, length: int) -> pa.RecordBatch:
    """Runs in; out, a row for each of their windows with its digest."""
    right, left, near = t.column("right").to_pylist(), t.column("left").to_pylist(), t.column("near").to_pylist()
    many = [len(x) - n + 1 for x, n in zip(left, near, strict=True)]
    digests = [hashlib.blake2b((x + r)[w : w + length], digest_size=16).digest() for x, r, m in zip(left, right, many, strict=True) for w in range(m)]
    window = np.concatenate([np.arange(m, dtype=np.int32) for m in many])
    rep = lambda c: pa.array(np.repeat(t.column(c).to_numpy(), many))
    return pa.RecordBatch.from_arrays([rep("chunk"), rep("run_id"), pa.nulls(len(window), pa.binary()), pa.array(window), pa.array(digests, pa.binary()), rep("least")], schema=_ANSWER)


def _answers(length: int):
    """Sorted runs in; out, for runs with a window that a smaller document of another chunk has, that document for each window. Hot runs, which come last, give their windows."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        least = t.column("least").to_numpy()
        run, window, low = induce(t.column("right").to_pylist(), t.column("left").to_pylist(), t.column("near").to_numpy(), least, length)
        order = np.lexsort((window, run))
        run, low = run[order], low[order]
        cut = np.searchsorted(run, np.arange(len(least) + 1))
        told = np.flatnonzero(np.minimum.reduceat(low, cut[:-1]) < least)
        packed = [low[cut[k] : cut[k + 1]].tobytes() for k in told]
        none = [pa.nulls(len(told), f.type) for f in _ANSWER][3:]
        return pa.RecordBatch.from_arrays([t.column("chunk").combine_chunks().take(pa.array(told)), t.column("run_id").combine_chunks().take(pa.array(told)), pa.array(packed, pa.binary()), *none], schema=_ANSWER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            cold = int(np.count_nonzero(~np.array(batch.column("hot").to_pylist(), bool)))
            if cold < len(batch):
                hot = pa.Table.from_batches([batch.slice(cold)])
                for start in range(0, len(hot), 4096):
                    yield _windows(hot.slice(start, 4096).combine_chunks(), length)
                batch = batch.slice(0, cold)
            if not len(batch):
                continue
            held.append(batch)
            n += len(batch)
            if n < GROUP_ROWS:
                continue
            # Up to the last change of anchor, so that all runs of an anchor (HOT at most) stay together.
            t = pa.Table.from_batches(held)
            right = t.column("right").combine_chunks()
            last = right[n - 1].as_py()[:GRAM]
            lo, hi = 0, n - 1
            while lo < hi:  # first row with the last anchor; rows are sorted
                mid = (lo + hi) // 2
                if right[mid].as_py()[:GRAM] < last:
                    lo = mid + 1
                else:
                    hi = mid
            if lo:
                yield solve(t.slice(0, lo).combine_chunks())
            held, n = t.slice(lo).to_batches(), n - lo
        if n:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _cut(length: int, digest: bool):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(docs):
            return _RESULT.empty_table()
        copies = _ids(answers)
        answers = answers.filter(answers.column("run_id").is_valid())
        pieces = Pieces(docs, length, copies)
        ids, at = pieces.ids, pieces.at
        asked = answers.column("run_id").to_numpy() if len(answers) else np.zeros(0, np.int64)
        order = np.argsort(asked)
        asked = asked[order]
        both = zip(answers.column("smallest").to_pylist(), answers.column("lows").to_pylist(), strict=True) if len(answers) else ()
        low_of = [np.frombuffer(x, np.int64) if y is None else np.array(y, np.int64) for x, y in both]
        size = np.array([len(x) for x in low_of], np.int64)[order] if low_of else np.zeros(0, np.int64)
        flat = np.concatenate([low_of[k] for k in order]) if low_of else np.zeros(0, np.int64)
        base = np.cumsum(size) - size
        all_runs = [(start + first, start + last, row, pieces.bytes_of(start, first, last)) for start, _, _, first, last, row in pieces]
        change = np.zeros(len(pieces.data) + 1, np.int32)
        if all_runs:
            first, last, row, run_id = (np.concatenate(x) for x in zip(*all_runs, strict=True))
            run_id = run_id.view(np.int64)
            # Inside the chunk: a run that a smaller document has is covered whole.
            sorted_runs = np.lexsort((ids[row], run_id))
            head = np.append(True, run_id[sorted_runs][1:] != run_id[sorted_runs][:-1])
            low = np.empty(len(row), np.int64)
            low[sorted_runs] = ids[row[sorted_runs[head]]][np.cumsum(head) - 1]
            inside = low < ids[row]
            np.add.at(change, first[inside], 1)
            np.add.at(change, last[inside] + length, -1)
            if len(asked):
                k = np.minimum(np.searchsorted(asked, run_id), len(asked) - 1)
                hit = np.flatnonzero((asked[k] == run_id) & ~inside)
                k = k[hit]
                window = np.arange(size[k].sum()) - np.repeat(np.cumsum(size[k]) - size[k], size[k])
                at_window = np.repeat(first[hit], size[k]) + window
                covered = flat[np.repeat(base[k], size[k]) + window] < np.repeat(ids[row[hit]], size[k])
                np.add.at(change, at_window[covered], 1)
                np.add.at(change, at_window[covered] + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        out = {c: [] for c in _RESULT.names}
        for k, i in enumerate(ids.tolist()):
            mask = gone[at[k] : at[k + 1]]
            kept = pieces.data[at[k] : at[k + 1]][~mask].tobytes()
            out["doc_id"].append(None if i == NONE else i)
            out["n_bytes"].append(len(mask))
            out["n_removed"].append(int(mask.sum()))
            out["n_spans"].append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
            out["kept"].append(hashlib.sha256(kept).digest() if digest else kept)
        whole = docs.filter(pa.array(np.isin(docs.column("doc_id").to_numpy(), copies)))
        for i, n in zip(whole.column("doc_id").to_pylist(), pc.binary_length(whole.column("text")).to_pylist(), strict=True):
            for c, x in zip(_RESULT.names, (i, n, n, 1, hashlib.sha256(b"").digest() if digest else b""), strict=True):
                out[c].append(x)
        return pa.table(out, schema=_RESULT)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes, or their SHA-256 if digest is set)."""
    if not GRAM < length <= 200:
        raise ValueError(f"length must be over {GRAM} and at most 200")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = corpus_bytes(docs)
    chunks, buckets = max(1, -(-size // CHUNK_BYTES)), max(1, -(-size // BUCKET_BYTES))
    # Equal doc_ids share a chunk.
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("long"))
    same = docs.where(F.octet_length("text") >= length).groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = docs.select("doc_id", "chunk", F.sha2("text", 256).alias("sha")).join(same, "sha").where("doc_id > first")
    copies = copies.select("chunk", F.col("doc_id").alias("copy")).distinct()
    by_chunk = docs.groupBy("chunk")
    blocks = by_chunk.cogroup(copies.withColumnRenamed("chunk", "home").groupBy("home")).applyInArrow(_anchor_blocks(length, buckets), "bucket long, chunk long, values binary, several binary, counts binary")
    shared = blocks.groupBy("bucket").applyInArrow(_shared, "chunk long, values binary, hot boolean").unionByName(copies, allowMissingColumns=True)
    found = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(_repeated_runs(length), "chunk long, run_id long, right binary, left binary, near int, least long, hot boolean")
    # Runs of one anchor meet; those of hot ones, which don't have to, are spread.
    deal = F.when(F.col("hot"), F.col("run_id")).otherwise(F.xxhash64(F.substring("right", 1, GRAM)))
    dealt = found.withColumn("deal", deal).repartition("deal").sortWithinPartitions("hot", "right")
    answers = dealt.drop("deal").mapInArrow(_answers(length), "chunk long, run_id long, smallest binary, window int, digest binary, least long")
    answers = materialise(answers)
    windows = answers.where("digest IS NOT NULL").select("chunk", "run_id", "window", "digest", "least")
    low = windows.groupBy("digest").agg(F.min("least").alias("low"))
    told = windows.join(low, "digest").groupBy("chunk", "run_id").agg(F.array_sort(F.collect_list(F.struct("window", "low"))).alias("lows"), F.max(F.col("low") < F.col("least")).alias("any"))
    told = told.where("any").select("chunk", "run_id", F.transform("lows", lambda w: w["low"]).alias("lows"))
    answers = answers.where("digest IS NULL").select("chunk", "run_id", "smallest").unionByName(told, allowMissingColumns=True).unionByName(copies, allowMissingColumns=True)
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(_cut(length, digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))
