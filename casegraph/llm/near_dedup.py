"""Near-duplicate groups by bottom-k sketches from one hash function.

Every document is its set of word shingles, hashed once. The k least values are its sketch.
 1. Documents of equal sets fold into classes (a hot group is one row from here on).
 2. Inverted lists: each pair of neighbouring values among a class's `PROBES` least gets a list of the classes that
    retain both. Classes as similar as the threshold share about 16 lists of 23; fewer than `OVERLAP` shared lists
    have a chance of about 1e-5 at the very threshold. Sets retained whole can have so few lists that links share
    fewer: for them the overlap asked for is what every link must share (`needs`), so none is missed.
 3. Lists of up to `LONG` classes give all their pairs, counted: a pair is kept if the lists shared, with the long
    lists that both are in, reach the overlap.
 4. So only classes in as many long lists as their overlap (members of large near-copy groups) still need pairs from long
    lists. There each meets the hub of its list (the class whose own lists are longest: what the others were copied
    from), the runner-up and its neighbour by rank; links found so join most of a group.
 5. What is left in a long list are links of a class x that is not joined with the hub. They are found by what sets it
    and its partner apart from the hub: a linked y shares with x more than about half of the values in which y differs
    from the hub (`spared`). So one of just over half of those is enough to find x by, its own edits first, which few
    have. Each class sends its departures from the hub once; what two of them share gives their similarity exactly.
 6. Everywhere the union sketch (the k least of both) estimates the similarity; what is clearly below the threshold
    (four standard errors) goes, the rest is confirmed on the full sets. Links join into components.
No class is dropped or capped, and no step sends a class once for each partner: rows grow with the classes. Tasks of step 5
compare classes that share a departure, apart from the hub and from each other, and send only the links they find.

Equal sets and equal shingles are those of equal 128- and 64-bit hashes: two of n different shingles fall together with a
chance of n * n / 2**65.

Defined results: null texts and texts without words have no set and are linked with nothing; shorter texts than a
shingle are one shingle; texts of any length are taken whole; repeated rows are documents of equal sets, each with a row
of the result; rows that share a doc_id and differ are one document with the least of their texts, and one row; rows without
doc_id go; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegraph.llm import text as tx
from casegraph.llm.common import materialise, passing, table
from casegraph.llm.pairs import against_heads, common, shingle_sets, sliced, streamed, with_heads
from casegraph.operators.components import star_components

WIDTH = 5
THRESHOLD = (80, 100)
K = 64
PROBES = 24
OVERLAP = 5
LONG = 32
SLICE = 256  # classes of a long list that are ranked together
BUCKET = 4_000_000  # shingles of a hub's classes whose departures one task compares


def shared_keys(n: int, t: tuple[int, int], probes: int = PROBES) -> int:
    """What a set of n <= probes values shares at least, in keys, with any linked set that is not smaller.

    Of u values in the union c are common: each of the other u - c parts at most one of the c - 1 neighbouring pairs, and
    the larger set's values beyond the probes have no key.
    """
    num, den = t
    found = []
    for c in range(1, n + 1):
        u = den * c // num
        if u >= 2 * n - c:
            found.append(2 * c - u - 1 - max(0, u - n + c - probes))
    return min(found, default=OVERLAP)


def needs(t: tuple[int, int]) -> tuple[list[int], int]:
    """Overlap that a pair needs by the size of either set (from 1; OVERLAP beyond the list), and the size up to which sets are
    keyed on single values too, since neighbouring ones guarantee nothing."""
    num, den = t
    own = [min(OVERLAP, shared_keys(n, t)) for n in range(1, PROBES + 1)]
    single = max((n for n in range(1, PROBES + 1) if own[n - 1] < 1), default=0) * den // num
    least = lambda n: min(own[a - 1] if a <= PROBES else OVERLAP for a in range(-(-n * num // den), n + 1))
    return [1 if n <= single else least(n) for n in range(1, PROBES * den // num + 1)], single


def _need(n: str, t: tuple[int, int]) -> Column:
    of = needs(t)[0]
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in of]), (F.col(n) - 1).cast("int")), F.lit(OVERLAP))


def sketches(docs: DataFrame, width: int, k: int = K, probes: int = PROBES, single: int = 0) -> DataFrame:
    """doc_id, n (set size), set_id, sketch (upper halves of the k least hashes), keys (of the inverted lists; sets of up to `single` values have each value as a key too)."""

    def run(batches):
        for batch in batches:
            data, at = tx.buffers(batch.column("text"))
            n, ids, sk, keys = [], [], [], []
            for a, b in tx.blocks(at):
                row, h = shingle_sets(data[at[a] : at[b]], at[a : b + 1] - at[a], width)
                cut = np.searchsorted(row, np.arange(b - a + 1)).tolist()
                for x, y in zip(cut[:-1], cut[1:], strict=True):
                    least = h[x : min(y, x + probes)]
                    n.append(y - x)
                    ids.append(hashlib.blake2b(h[x:y].tobytes(), digest_size=16).digest() if y > x else None)
                    sk.append((h[x : min(y, x + k)] >> np.uint64(32)).astype("<u4").tobytes())
                    key = tx.mix64(least[:-1] * np.uint64(3) + least[1:])
                    keys.append((key if y - x > single else np.concatenate([key, h[x:y]])).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sk, pa.binary()), pa.array(keys, pa.binary())], names=["doc_id", "n", "set_id", "sketch", "keys"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "doc_id long, n long, set_id binary, sketch binary, keys binary")


def estimate(a: bytes, b: bytes, k: int) -> tuple[float, int]:
    """Similarity by the union sketch, and how many values it rests on."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both = np.sort(np.concatenate([x, y]))
    same = both[1:] == both[:-1]
    new = np.ones(len(both), bool)
    new[1:] = ~same
    union = both[new][:k]
    if not len(union):
        return 0.0, 0
    return int((both[1:][same] <= union[-1]).sum()) / len(union), len(union)


def _lists(classes: DataFrame, least: int) -> DataFrame:
    """key, id, n, cnt (classes in the list), hub (how well its lists are filled): lists of one class are gone."""

    def run(batches):
        for batch in batches:
            keys = [np.frombuffer(x, "<i8") for x in batch.column("keys").to_pylist()]
            size = [len(x) for x in keys]
            rep = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), size), pa.int64())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else [], pa.int64()), rep("id"), rep("n")], names=["key", "id", "n"])

    keyed = classes.where(F.col("n") >= least).select("id", "n", "keys").mapInArrow(run, "key long, id long, n long")
    counts = keyed.groupBy("key").agg(F.count("*").alias("cnt")).where("cnt > 1")
    lists = keyed.join(counts, "key")  # no window by key: a long list may be split over tasks
    return lists.withColumn("hub", F.sum("cnt").over(Window.partitionBy("id")))


def _short_pairs(lists: DataFrame, hot: DataFrame, t: tuple[int, int]) -> DataFrame:
    """a < b from the short lists, whose overlap can reach what they need."""
    member = F.struct("id", F.coalesce("h", F.lit(0)).alias("h"), _need("n", t).alias("need")).alias("m")
    short = lists.where(F.col("cnt") <= LONG).join(hot.select("id", "h"), "id", "left").select("key", member)
    short = short.groupBy("key").agg(F.sort_array(F.collect_list("m")).alias("ms"))  # LONG at most
    pair = lambda a, b: F.struct(a["id"].alias("a"), b["id"].alias("b"), F.least(a["h"], b["h"]).alias("h"), F.greatest(a["need"], b["need"]).alias("need"))
    every = F.flatten(F.transform("ms", lambda a: F.transform(F.filter("ms", lambda b: b["id"] > a["id"]), lambda b: pair(a, b))))
    pairs = short.select(F.inline(every)).groupBy("a", "b").agg(F.count("*").alias("o"), F.first("h").alias("h"), F.first("need").alias("need"))
    return pairs.where(F.col("o") + F.col("h") >= F.col("need")).select("a", "b")


def _star_pairs(long: DataFrame) -> DataFrame:
    """Each class with the hub, the runner-up and its neighbour by rank within a slice of its list."""
    slices = F.pmod(F.xxhash64("id"), F.ceil(F.col("cnt") / SLICE)).cast("int")
    w = Window.partitionBy("key", "slice").orderBy(F.desc("hub"), "id")
    ranked = long.select("key", "id", "hub", slices.alias("slice")).withColumns({"c3": F.lag("id").over(w), "rank": F.row_number().over(w)})
    first = F.min(F.struct(-F.col("hub"), "id"))["id"]
    tops = ranked.where("rank <= 2")
    c1 = tops.groupBy("key").agg(first.alias("c1"))
    heads = c1.join(tops.join(c1, "key").where("id <> c1").groupBy("key").agg(first.alias("c2")), "key", "left")
    stars = ranked.join(heads, "key").select("id", F.explode(F.array_distinct(F.array("c1", F.coalesce("c2", "c1"), F.coalesce("c3", "c1")))).alias("c")).where("id <> c")
    return stars.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b"))


def _spokes(long: DataFrame, components: DataFrame) -> DataFrame:
    """head, member, mark, n, buckets: the hub of a long list and each class in it, for hubs that some class (mark) is not joined with."""
    # Linked classes that meet in long lists only share `need` of them: both keep the first shared one in the order of keys.
    order = F.row_number().over(Window.partitionBy("id").orderBy("key"))
    heads = long.groupBy("key").agg(F.min(F.struct(-F.col("hub"), "id"))["id"].alias("head"))
    s = long.withColumn("place", order).where(F.col("place") <= F.col("h") - F.col("need") + 1)
    s = s.join(heads, "key").where("id <> head").select("head", F.col("id").alias("member"), "n").distinct()
    s = _joined(_joined(s, components, "head"), components, "member")
    s = s.select("head", "member", "n", (F.col("c_head") != F.col("c_member")).alias("mark"))
    apart = s.groupBy("head").agg(F.count("*").alias("all"), F.max("mark").alias("any"), F.ceil(F.sum("n") / BUCKET).cast("int").alias("buckets")).where("any")
    return s.drop("n").join(apart.select("head", F.col("all").alias("n"), "buckets"), "head")


def _joined(df: DataFrame, components: DataFrame, name: str) -> DataFrame:
    """df with c_<name>, the component of the class in that column."""
    of = components.select(F.col("u").alias(name), F.col("v").alias(f"c_{name}"))
    return df.join(of, name, "left").withColumn(f"c_{name}", F.coalesce(f"c_{name}", name))


def spared(d: np.ndarray, n: np.ndarray, hub: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """More than so many of its d departures from the hub does a set of n values share with any x that is linked with it but not with the hub.

    With c = (1 - t) / (1 + t): x and y are linked if they differ in at most c (|x| + |y|) values, x and the hub h are not
    linked, so d(x) > c (|x| + |h|), and x and y differ in d(x) + d(y) less twice what d(x) and d(y) share. So they share
    more than (d(y) + c (|h| - |y|)) / 2.
    """
    num, den = t
    return (d * (den + num) + (den - num) * (hub - n)) / (2 * (den + num))


def _departures(spokes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """A row for each member of a hub and bucket of values: the set's size, the hub's, all departures, and those in the bucket (its own first)."""

    def run(batches):
        for rows in streamed(batches, width):
            out = []
            for (head, buckets), member, x, hub, own in rows:
                parts = np.setdiff1d(own, hub, assume_unique=True), np.setdiff1d(hub, own, assume_unique=True)
                d = np.concatenate(parts)
                of = d % np.uint64(buckets)
                for k in range(buckets):
                    mine = d[of == k] if buckets > 1 else d
                    out.append((head, k, buckets, member, x, len(own), len(hub), len(d), mine.tobytes()))
            names = ["head", "bucket", "buckets", "id", "x", "n", "hub", "d", "values"]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=names)

    return against_heads(sliced(spokes), docs, width, "buckets").mapInArrow(run, "head long, bucket int, buckets int, id long, x boolean, n long, hub long, d long, values binary")


def _compared(rows: DataFrame, components: DataFrame, t: tuple[int, int]) -> DataFrame:
    """a, b, sure: links of classes x with others that they are not joined with; where a hub has several buckets, possible links."""
    num, den = t

    def compare(group: pa.Table) -> pa.Table:
        ids, comp, n, hub, total = (group.column(c).to_numpy() for c in ("id", "c_id", "n", "hub", "d"))
        whole = group.column("buckets")[0].as_py() == 1
        values = [np.frombuffer(v, np.uint64) for v in group.column("values").to_pylist()]
        here = np.array([len(v) for v in values])
        least = spared(total, n, hub, t) * here / np.maximum(total, 1)  # a share of the bucket
        few = (here - np.floor(least)).astype(np.int64)
        owner = np.repeat(np.arange(len(ids)), few)
        listed = np.concatenate([v[:k] for v, k in zip(values, few.tolist(), strict=True)])
        order = np.argsort(listed, kind="stable")
        listed, owner = listed[order], owner[order]
        values = [np.sort(v) for v in values]
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        found = []
        for x in np.flatnonzero(group.column("x").to_numpy(zero_copy_only=False)).tolist():
            lo, hi = np.searchsorted(listed, values[x], "left"), np.searchsorted(listed, values[x], "right")
            met = np.unique(np.concatenate([owner[i:j] for i, j in zip(lo.tolist(), hi.tolist(), strict=True) if j > i] or [owner[:0]]))
            met = met[(den * np.minimum(n[met], n[x]) >= num * np.maximum(n[met], n[x])) & (comp[met] != comp[x])]
            for y in met.tolist():
                if find(int(comp[x])) == find(int(comp[y])):
                    continue
                shared = common(values[x], values[y])
                same = (n[x] + n[y] - (total[x] + total[y] - 2 * shared)) // 2
                if whole and den * same >= num * (n[x] + n[y] - same):
                    root[find(int(comp[x]))] = find(int(comp[y]))
                    found.append((x, y))
                elif not whole and shared > least[y]:
                    found.append((x, y))
        both = ids[np.array(found, np.int64).reshape(-1, 2)]
        return pa.table({"a": pa.array(both.min(1), pa.int64()), "b": pa.array(both.max(1), pa.int64()), "sure": pa.array(np.full(len(both), whole))})

    return _joined(rows, components, "id").groupBy("head", "bucket").applyInArrow(compare, "a long, b long, sure boolean")


def _links_apart(long: DataFrame, links: DataFrame, components: DataFrame, docs: DataFrame, classes: DataFrame, width: int, t: tuple[int, int]) -> DataFrame:
    """components after the links of classes that are not joined with the hub of their long list (step 5)."""
    spokes = materialise(_spokes(long, components))
    if spokes.isEmpty():
        return components
    found = materialise(_compared(_departures(spokes, docs, width), components, t).distinct())
    more = found.where("sure").select("a", "b")
    possible = found.where("NOT sure").select("a", "b")
    if not possible.isEmpty():
        more = more.unionByName(_linked(possible, classes, docs, width, t))
    return components if more.isEmpty() else _components(links.unionByName(more))


def _may_link(estimated: tuple[float, int], t: tuple[int, int]) -> bool:
    """Whether a union sketch leaves a link possible: within four standard errors of the threshold."""
    num, den = t
    return estimated[0] >= num / den - 4 * math.sqrt(num * (den - num) / den**2 / max(1, estimated[1]))


def may_link(pairs: DataFrame, classes: DataFrame, t: tuple[int, int], k: int = K) -> DataFrame:
    """The pairs whose union sketch does not speak clearly against a link (four standard errors)."""
    num, den = t
    side = classes.select("id", "n", "sketch")
    both = pairs.join(side.withColumnsRenamed({"id": "a", "n": "n_a", "sketch": "s_a"}), "a").join(side.withColumnsRenamed({"id": "b", "n": "n_b", "sketch": "s_b"}), "b")
    both = both.where((den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b")))

    def run(batches):
        for batch in batches:
            mask = pa.array([_may_link(estimate(x, y, k), t) for x, y in zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return both.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, t: tuple[int, int]) -> DataFrame:
    """The pairs linked by their full sets: a, b."""
    num, den = t
    pairs = materialise(may_link(pairs, classes, t))

    def run(batches):
        for rows in streamed(batches, width):
            out = []
            for (head, _), member, _, x, y in rows:
                same = common(x, y)
                if den * same >= num * (len(x) + len(y) - same):
                    out.append((min(head, member), max(head, member)))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return against_heads(with_heads(pairs), docs, width).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), kept (it is that document). threshold: a fraction."""
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    num, den = threshold
    least = next(n for n in range(1, 10**6) if den * n >= num * (n + 1))  # smaller sets are linked to equal ones only
    with passing() as kept:
        sk = materialise(sketches(docs, width, single=needs(threshold)[1]))
        # Rows of one doc_id with different texts: the thin table tells whether there are any.
        if not sk.groupBy("doc_id").agg(F.min(F.coalesce("set_id", F.lit(b""))).alias("lo"), F.max(F.coalesce("set_id", F.lit(b""))).alias("hi")).where("lo <> hi").isEmpty():
            docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
            sk = materialise(sketches(docs, width, single=needs(threshold)[1]))
        classes = sk.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
        classes = materialise(classes)
        lists = materialise(_lists(classes, least))
        long = lists.where(F.col("cnt") > LONG)
        hot = materialise(long.groupBy("id").agg(F.count("*").cast("int").alias("h"), F.first("n").alias("n")).withColumn("need", _need("n", threshold)))
        members = hot.where(F.col("h") >= F.col("need"))
        long = materialise(long.join(members.drop("n"), "id"))
        pairs = _short_pairs(lists, hot, threshold).unionByName(_star_pairs(long)).distinct()
        links = materialise(_linked(pairs, classes, docs, width, threshold))
        components = _components(links)
        components = _links_apart(long, links, components, docs, classes, width, threshold)
        kept += [sk, classes, components]
    of = classes.select("set_id", "id").join(components.select(F.col("u").alias("id"), F.col("v").alias("least")), "id", "left")
    of = of.select("set_id", F.coalesce("least", "id").alias("component"))
    out = sk.select("doc_id", "n", "set_id").join(of, "set_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def _components(links: DataFrame) -> DataFrame:
    return star_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), materialise)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, (85, 100))
