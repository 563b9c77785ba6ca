"""Iterative graph operators: neighbourhoods, paths, components, PageRank, betweenness, cliques.

Each is a driver loop over DataFrames; the state of a round is written to the shared folder, so lineage stays short and
a lost executor costs one round. Frontiers carry their seed, so all seeds run in one job.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casegraph import schemas as S
from casegraph.functions.scratch import materialise as write
from casegraph.functions.scratch import passing, tidy
from casegraph.operators.components import hub_components, hub_steps, star_components
from casegraph.operators.graph import undirected
from casegraph.operators.patterns import neighbours


def _arcs(edges: DataFrame, direction: str) -> DataFrame:
    """at -> to in the wanted direction."""
    out = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


@tidy
def ego(seeds: DataFrame, edges: DataFrame, depth: int = 1, direction: str = "both") -> DataFrame:
    """GR-7: (seed, id, hops) of all vertices within depth hops (1 to 5) of each seed. seeds: seed."""
    arcs = write(_arcs(edges, direction))
    seen = front = seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("hops"))
    for hop in range(1, max(1, min(5, depth)) + 1):
        step = front.join(arcs, front["id"] == arcs["at"]).select("seed", F.col("to").alias("id")).distinct()
        front = write(step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen


def ego_edges(seen: DataFrame, edges: DataFrame) -> DataFrame:
    """GR-7: the induced edges of each seed's neighbourhood, in their own direction."""
    s = seen.select("seed", "id")
    return edges.join(s.withColumnRenamed("id", "src"), "src").join(s.withColumnRenamed("id", "dst"), ["seed", "dst"])


@tidy
def shortest_paths(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """GR-8: for each (source, target) a shortest directed path, else an undirected one; ties give the least path.

    pairs: source, target. Out: source, target, path, length, directed; pairs without a path are missing.
    """
    edges = write(edges.select("src", "dst").distinct())  # both directions and the vertices are read from it
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    pairs = pairs.select("source", "target").distinct()
    pairs = pairs.join(nodes.withColumnRenamed("id", "source"), "source", "left_semi").join(nodes.withColumnRenamed("id", "target"), "target", "left_semi")
    pairs = write(pairs)
    found = []
    for direction in ("out", "both"):
        got = write(meet(pairs, write(_arcs(edges, direction)))).withColumn("directed", F.lit(direction == "out"))
        found.append(got)
        pairs = write(pairs.join(got.select("source", "target"), ["source", "target"], "left_anti"))
    return found[0].unionByName(found[1])


class _Side:
    """One end's search: the vertices at its last level, each with the least path of that length, for all ends at once."""

    def __init__(self, ends: DataFrame, end: str, arcs: DataFrame, forward: bool):
        self.end, self.arcs, self.forward, self.rows = end, arcs, forward, []
        self.here, self.there = ("at", "to") if forward else ("to", "at")
        self.degrees = write(arcs.groupBy(F.col(self.here).alias("id")).agg(F.count("*").alias("arcs")))
        self._reach(ends.select(end).distinct().select(end, F.col(end).alias("id"), F.array(end).alias("path")))
        self.seen = self.front.select(end, "id")

    def _reach(self, front: DataFrame) -> None:
        """front as the last level, each vertex with its arcs ahead."""
        self.front = write(front.join(self.degrees, "id", "left").select(self.end, "id", "path", F.coalesce("arcs", F.lit(0)).alias("arcs")))
        self.rows.append(self.front.count())

    def cost(self, active: DataFrame) -> int:
        """The arcs that the next level of active pairs' ends goes along."""
        return self.front.join(active.select(self.end).distinct(), self.end, "left_semi").agg(F.coalesce(F.sum("arcs"), F.lit(0))).first()[0]

    def advance(self, active: DataFrame) -> None:
        """One level on, for the ends of active pairs only."""
        front = self.front.join(active.select(self.end).distinct(), self.end, "left_semi")
        step = front.join(self.arcs, front["id"] == self.arcs[self.here]).select(self.end, F.col(self.there).alias("id"), "path")
        path = F.concat("path", F.array("id")) if self.forward else F.concat(F.array("id"), "path")
        step = step.join(self.seen, [self.end, "id"], "left_anti").groupBy(self.end, "id").agg(F.min("path").alias("path"))
        self._reach(step.select(self.end, "id", path.alias("path")))
        self.seen = self.seen.unionByName(self.front.select(self.end, "id"))


def _least_ways(active: DataFrame, ahead: DataFrame, back: DataFrame) -> DataFrame:
    """source, target, path: the least way of each pair over a vertex (id) of ahead (source, id, path) and back (target, id, path).

    Begins with the end that gives the pairs fewer rows: a pair of a hub and another vertex is looked up from the other. Paths follow
    once the vertices are known.
    """
    rows = lambda end, side: active.join(side.groupBy(end).agg(F.count("*").alias("n")), end).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ends = [("source", ahead), ("target", back)]
    (one, near), (other, far) = ends if rows(*ends[0]) <= rows(*ends[1]) else ends[::-1]
    ids = active.join(near.select(one, "id"), one).join(far.select(other, "id"), [other, "id"])
    ways = ids.join(ahead, ["source", "id"]).join(back.withColumnRenamed("path", "rest"), ["target", "id"])
    return ways.groupBy("source", "target").agg(F.min(F.concat("path", F.slice("rest", 2, F.size("rest")))).alias("path"))


def _bridged(active: DataFrame, ahead: DataFrame, back: DataFrame, arcs: DataFrame) -> DataFrame:
    """As _least_ways, of the ways over one arc between the vertices of both sides.

    An arc is looked up from its end of fewer arcs, whose arcs to vertices of more are few: a hub's are not gone along.
    """
    many = write(arcs.select(F.explode(F.array("at", "to")).alias("id")).groupBy("id").agg(F.count("*").alias("n")))
    both = arcs.join(many.withColumnsRenamed({"id": "at", "n": "m"}), "at").join(many.withColumnRenamed("id", "to"), "to")
    both = write(both.select("at", "to", (F.struct("m", "at") < F.struct("n", "to")).alias("low")))
    on = ahead.join(both.where("low"), ahead["id"] == both["at"]).select("source", F.col("to").alias("id"), F.concat("path", F.array("to")).alias("path"))
    on = write(on.groupBy("source", "id").agg(F.min("path").alias("path")))
    off = back.join(both.where("NOT low"), back["id"] == both["to"]).select("target", F.col("at").alias("id"), F.concat(F.array("at"), "path").alias("path"))
    off = write(off.groupBy("target", "id").agg(F.min("path").alias("path")))
    ways = _least_ways(active, on, back).unionByName(_least_ways(active, ahead, off))
    return ways.groupBy("source", "target").agg(F.min("path").alias("path"))


def _over_first_steps(active: DataFrame, arcs: DataFrame, length: int) -> DataFrame | None:
    """As _least_ways, of the pairs whose least neighbour ahead of the source is `length` arcs from the target, none being nearer; None
    where the sources have too many such neighbours for a search from these to be less than one from the sources."""
    ahead = arcs.where("at <> to").join(active.select(F.col("source").alias("at")).distinct(), "at", "left_semi")
    first = write(ahead.groupBy(F.col("at").alias("source")).agg(F.min("to").alias("step")))
    if SHARED * first.select("step").distinct().count() > first.count():
        return None
    steps = write(active.join(first, "source"))
    got = meet(steps.select(F.col("step").alias("source"), "target").distinct(), arcs, most=length).where(F.col("length") == length)
    return steps.join(got.select(F.col("source").alias("step"), "target", "path"), ["step", "target"]).select("source", "target", F.concat(F.array("source"), "path").alias("path"))


STEEP = 1 << 20  # arcs of a level from which on what is nearest is sought without it
SHARED = 16  # sources for each least neighbour, at least, for a search from those


def meet(pairs: DataFrame, arcs: DataFrame, rows: list[int] | None = None, most: int | None = None) -> DataFrame:
    """Least shortest paths of pairs (source, target) along arcs (at, to), searched from both ends: source, target, path, length.

    Each round moves the side with fewer arcs ahead of its last level, so levels stay far below those of a search from one end.
    A path of the two levels' summed length exists where they share a vertex; the least goes through the least of
    both halves. Searches are shared by pairs of one source or target. Before a level of many arcs, pairs that are one arc more apart are
    found by that arc, and of those of two more the ones whose least first steps are shared by many sources: the level is then
    taken for the rest only. most: longer paths are not sought. rows: gets the rows of each level.
    """
    found = pairs.where("source = target").select("source", "target", F.array("source").alias("path"))
    active = write(pairs.where("source <> target"))
    sides = [_Side(active, "source", arcs, True), _Side(active, "target", arcs, False)]
    length, known = 0, 0  # of both last levels; no active pair has a path of so many arcs
    while not active.isEmpty() and (most is None or length < most):  # ends: a side's levels run out, and its pairs with them
        costs = [x.cost(active) for x in sides]
        if min(costs) >= STEEP and known == length and most is None:
            fronts = [x.front.drop("arcs").join(active.select(x.end).distinct(), x.end, "left_semi") for x in sides]
            known = length + 1
            met = write(_bridged(active, *fronts, arcs))
            found = found.unionByName(met)
            active = write(active.join(met, ["source", "target"], "left_anti"))
            met = _over_first_steps(active, arcs, known)
            if met is not None:
                met = write(met)
                found = found.unionByName(met)
                active = write(active.join(met, ["source", "target"], "left_anti"))
            continue
        sides[costs.index(min(costs))].advance(active)
        length += 1
        known = max(known, length)
        ahead, back = [x.front.drop("arcs") for x in sides]
        met = write(_least_ways(active, ahead, back))
        found = found.unionByName(met)
        left = active.join(met, ["source", "target"], "left_anti").join(ahead.select("source").distinct(), "source", "left_semi")
        active = write(left.join(back.select("target").distinct(), "target", "left_semi").select("source", "target"))
    if rows is not None:
        rows += sides[0].rows + sides[1].rows
    return found.withColumn("length", F.size("path") - 1)


def walk_lengths(targets: DataFrame, arcs: DataFrame, most: int) -> DataFrame:
    """(target, id, lengths): bit k of lengths tells of a walk of k arcs from id that reaches target first at its end."""
    front = targets.select("target", F.col("target").alias("id"))
    levels = front.withColumn("lengths", F.lit(1))
    for k in range(1, most + 1):
        front = write(front.join(arcs, front["id"] == arcs["to"]).where(F.col("at") != F.col("target")).select("target", F.col("at").alias("id")).distinct())
        if front.isEmpty():
            break
        levels = levels.unionByName(front.withColumn("lengths", F.lit(1 << k)))
    return levels.groupBy("target", "id").agg(F.bit_or("lengths").alias("lengths"))


@tidy
def money_paths(pairs: DataFrame, edges: DataFrame, max_hops: int = 8, top: int = 10, beam: int | None = None, rows: list[int] | None = None) -> DataFrame:
    """GR-9: for each pair the first `top` simple paths over money edges by length, then nodes.

    Best first: what is open of a pair are prefixes, each with the length (b) that its paths will have: there are walks of
    that length to the target. Each round extends the first `beam` of a pair by (b, prefix), which is the order of their paths too; a
    pair ends once its `top` found paths come before all that is open. So paths longer, or later, than those are never listed, and
    the work of a pair is bounded by the result and the degrees on it, not by how many paths there are. The first round takes paths of
    one and two hops only: where they suffice nothing longer is begun. Arcs meet walks to the targets before prefixes do, so that
    a round makes those steps only that lead to the target; the last step is known from the walk and needs no join.
    rows: gets the open prefixes of each round.
    """
    arcs = write(_arcs(edges.where(F.upper("rel").isin(*S.MONEY)), "out").where("at <> to"))
    pairs = write(pairs.select("source", "target").distinct())
    walks = write(walk_lengths(pairs.select("target").distinct(), arcs, max_hops))
    key, beam = ["source", "target"], beam or max(top, 1)
    has = lambda k: F.col("lengths").bitwiseAND(F.pow(F.lit(2), k).cast("int")) != 0
    lengths = F.filter(F.sequence(F.lit(1), F.lit(max_hops)), has)
    is_open = pairs.where("source <> target").join(walks.withColumnRenamed("id", "source"), ["target", "source"]).select(*key, F.explode(lengths).alias("b"), F.array("source").alias("path"), F.col("source").alias("id"))
    is_open, found, ended, short = write(is_open), None, [], True
    by_path = Window.partitionBy(*key).orderBy("b", "path")
    left = F.col("b") - F.size("path") + 1  # arcs to the target
    while not is_open.isEmpty():  # ends: every round replaces prefixes by longer ones
        if rows is not None:
            rows.append(is_open.count())
        ranked = is_open.withColumn("r", F.row_number().over(by_path))
        chosen = (F.col("r") <= beam) & ((F.col("b") <= 2) if short else F.lit(True))
        first, short = ranked.where(chosen).withColumn("left", left), False
        onward = first.where("left > 1").select(*key, "b", "path", "id", "left")
        hops = arcs.join(onward.select(F.col("id").alias("at")).distinct(), "at", "left_semi").join(walks.withColumnRenamed("id", "to"), "to").select("target", F.col("at").alias("id"), "to", "lengths")
        most = onward.agg(F.bit_or(F.pow(F.lit(2), F.col("left") - 1).cast("int"))).first()[0] or 0
        step = onward.join(hops.where(F.col("lengths").bitwiseAND(F.lit(most)) != 0), ["target", "id"]).where(has(F.col("left") - 1) & ~F.array_contains("path", F.col("to")))
        step = write(step.select(*key, "b", F.concat("path", F.array("to")).alias("path"), F.col("to").alias("id")))
        # One arc from the target: the path is whole.
        got = first.where("left = 1").select(*key, "b", "path").unionByName(step.where(left == 1).select(*key, "b", "path"))
        got = got.select(*key, "b", F.concat("path", F.array("target")).alias("path"))
        found = got if found is None else found.drop("r").unionByName(got)
        found = write(found.withColumn("r", F.row_number().over(by_path)).where(F.col("r") <= top))
        last = found.where(F.col("r") == top).select(*key, F.struct("b", "path").alias("last"))
        rest = ranked.where(~chosen).drop("r").unionByName(step.where(left > 1))
        is_open = write(rest.join(last, key, "left").where(F.col("last").isNull() | (F.struct("b", "path") < F.col("last"))).drop("last"))
        # Pairs with nothing open are not ranked again.
        going = is_open.select(*key).distinct()
        ended.append(found.join(going, key, "left_anti"))
        found = write(found.join(going, key, "left_semi"))
    if not ended:
        return is_open.select(*key, "path", F.lit(0).alias("rank"), F.col("b").alias("length"))
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    return out.select(*key, "path", F.col("r").alias("rank"), (F.size("path") - 1).alias("length"))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """GR-10: (id, component: least id in it), isolated vertices being their own."""
    least = hub_components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), write)
    return vertices.select("id").distinct().join(least.withColumnsRenamed({"u": "id", "v": "component"}), "id", "left").withColumn("component", F.coalesce("component", "id"))


def component_sizes(of: DataFrame) -> DataFrame:
    """GR-10: components by size, largest first, numbered from 0.

    Components are dealt by range and numbered inside it, on top of the counts of the ranges before.
    """
    sizes = of.groupBy("component").agg(F.count("*").alias("size"))
    ranges = write(sizes.repartitionByRange(F.desc("size"), "component").withColumn("range", F.spark_partition_id()))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    offsets = ranges.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.desc("size"), "component"))
    return ranges.withColumn("place", place).join(F.broadcast(offsets), "range").select("component", "size", (F.col("before") + F.col("place") - 1).alias("index"))


@tidy
def pagerank(vertices: DataFrame, edges: DataFrame, alpha: float = 0.85, max_rounds: int = 200, tol: float = 1e-6, fixed_rounds: int | None = None) -> DataFrame:
    """GR-15: (id, rank); dangling mass is spread evenly, ranks are brought back to a sum of 1 each round.

    Stops when the summed change falls below N * tol, or after fixed_rounds. A round is one join and two aggregations by
    vertex; its sums (all ranks, those of dangling vertices, the change) come from one pass over what it wrote.
    """
    v = vertices.select("id").distinct()
    arcs = write(edges.select("src", "dst").distinct())
    out = arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"))
    state = write(v.join(out, "id", "left").select("id", "out", F.lit(1.0).alias("rank"), F.lit(0.0).alias("old")))
    sums = lambda df: df.agg(F.count("*"), F.sum("rank"), F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.sum(F.abs(F.col("rank") - F.col("old")))).first()
    n, total, dangling, _ = sums(state)
    if not n:
        return v.withColumn("rank", F.lit(0.0))
    for k in range(fixed_rounds or max_rounds):
        now = state.select("id", "out", (F.col("rank") / total).alias("old"))
        given = now.where("out IS NOT NULL").select(F.col("id").alias("src"), (F.col("old") / F.col("out")).alias("share")).join(arcs, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("got"))
        base = (1 - alpha) / n + alpha * (dangling or 0.0) / total / n
        state = write(now.join(given, "id", "left").select("id", "out", (base + alpha * F.coalesce("got", F.lit(0.0))).alias("rank"), "old"))
        if k + 1 == fixed_rounds:
            break
        _, total, dangling, change = sums(state)
        if not fixed_rounds and change < n * tol:
            break
    if fixed_rounds:
        total = state.agg(F.sum("rank")).first()[0]
    return state.select("id", (F.col("rank") / total).alias("rank"))


def _pruned(ids: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(core, arcs, gone): a graph without the trees that hang on it, taken away leaf by leaf.

    ids: id, s, t (its weight as a source and as a target). In core and gone, s and t are those of a vertex and all that hangs on it; hs, ht
    those of what hangs alone, hst the sum of s * t over its branches. Of two leaves that are joined with each other the greater goes.
    """
    core, gone = write(ids.select("id", "s", "t", *[F.lit(0.0).alias(c) for c in ("hs", "ht", "hst")])), None
    while True:  # ends: every round takes leaves away
        leaves = arcs.groupBy(F.col("at").alias("id")).agg(F.count("*").alias("n"), F.min("to").alias("parent")).where("n = 1").select("id", "parent")
        leaves = leaves.join(leaves.select(F.col("id").alias("parent"), F.lit(True).alias("leaf")), "parent", "left").where("leaf IS NULL OR id > parent")
        leaves = write(leaves.select("id", "parent").join(core, "id"))
        if leaves.isEmpty():
            return core, arcs, core.limit(0) if gone is None else gone
        gone = leaves.drop("parent") if gone is None else gone.unionByName(leaves.drop("parent"))
        hung = leaves.groupBy(F.col("parent").alias("id")).agg(F.sum("s").alias("a"), F.sum("t").alias("b"), F.sum(F.col("s") * F.col("t")).alias("ab"))
        more = {"s": "a", "t": "b", "hs": "a", "ht": "b", "hst": "ab"}
        core = core.join(leaves.select("id"), "id", "left_anti").join(hung, "id", "left")
        core = write(core.select("id", *[(F.col(c) + F.coalesce(x, F.lit(0.0))).alias(c) for c, x in more.items()]))
        arcs = arcs.join(leaves.select(F.col("id").alias("at")), "at", "left_anti").join(leaves.select(F.col("id").alias("to")), "to", "left_anti")
        arcs = write(arcs.select("at", "to"))


@tidy
def betweenness(vertices: DataFrame, edges: DataFrame, pivots: int | None = None) -> DataFrame:
    """GR-16: (id, betweenness) on the undirected graph, scaled by (N-1)(N-2); from all sources, or from `pivots` of them
    chosen by hash and scaled by N / pivots (Brandes and Pich, 2007). All sources advance together, level by level.

    From all sources, trees that hang on the graph are folded first (Baglioni et al., 2012): a vertex stands for those that hang
    on it, so that stars and forests take work by their edges, not by their pairs of vertices.
    """
    arcs = neighbours(undirected(edges).select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("id").alias("at"), F.col("nbr").alias("to"))
    arcs = write(arcs)
    v = write(vertices.select("id").distinct())
    n = v.count()
    k = n if pivots is None else min(n, pivots)
    if k < n:
        sources, total = v.orderBy(F.xxhash64("id"), "id").limit(pivots), None
        arcs, sources = arcs.withColumn("t", F.lit(1.0)), sources.withColumn("s", F.lit(1.0))
    else:
        ids = v.withColumn("s", F.lit(1.0)).unionByName(arcs.select(F.col("at").alias("id"), F.lit(0.0).alias("s"))).groupBy("id").agg(F.max("s").alias("s")).withColumn("t", F.lit(1.0))
        ids = write(ids)
        core, inner, gone = _pruned(ids, arcs)
        # What hangs on a vertex is parted by it from its other branches, and from the rest of its component.
        of = write(components(ids, arcs.select(F.col("at").alias("src"), F.col("to").alias("dst"))))
        sums = of.join(ids, "id").groupBy("component").agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
        parted = core.unionByName(gone).where("hs > 0 OR ht > 0").join(of, "id").join(sums, "component")
        total = parted.select("id", F.expr("hs * ht - hst + hs * (all_t - t) + (all_s - s) * ht").alias("d"))
        arcs = write(inner.join(core.select(F.col("id").alias("to"), "t"), "to").select("at", "to", "t"))
        sources = core.where("s > 0").join(arcs.select(F.col("at").alias("id")).distinct(), "id", "left_semi").select("id", "s")
    levels = [write(sources.select(F.col("id").alias("source"), "s", "id", F.lit(1.0).alias("paths"), F.lit(0.0).alias("t")))]
    seen = levels[0].select("source", "id")
    while True:  # ends: every round visits new vertices
        step = levels[-1].drop("t").join(arcs, levels[-1]["id"] == arcs["at"]).groupBy("source", "s", F.col("to").alias("id"), "t").agg(F.sum("paths").alias("paths"))
        step = write(step.join(seen, ["source", "id"], "left_anti").select("source", "s", "id", "paths", "t"))
        if step.isEmpty():
            break
        levels.append(step)
        seen = seen.unionByName(step.select("source", "id"))
    below = None
    for level in reversed(levels[1:]):  # sources get nothing from themselves
        if below is None:
            here = level.withColumn("d", F.lit(0.0))
        else:
            back = below.join(arcs.select("at", "to"), below["id"] == arcs["to"]).select("source", F.col("at").alias("id"), ((F.col("t") + F.col("d")) / F.col("paths")).alias("share"))
            back = back.groupBy("source", "id").agg(F.sum("share").alias("share"))
            here = level.join(back, ["source", "id"], "left").select("source", "s", "id", "paths", "t", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("d"))
        below = write(here)
        part = below.groupBy("id").agg(F.sum(F.col("s") * F.col("d")).alias("d"))
        total = part if total is None else total.unionByName(part)
    scale = n / k / ((n - 1) * (n - 2)) if n > 2 and k else 1.0
    if total is None:
        return v.withColumn("betweenness", F.lit(0.0))
    total = total.groupBy("id").agg(F.sum("d").alias("d"))
    return v.join(total, "id", "left").select("id", (F.coalesce("d", F.lit(0.0)) * scale).alias("betweenness"))


def _numbered(v: DataFrame) -> DataFrame:
    """v (id) with numbers from 0 in the order of id: by range, on top of the rows of the ranges before."""
    ranges = write(v.repartitionByRange("id").withColumn("range", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    offsets = ranges.groupBy("range").agg(F.count("*").alias("n")).select("range", before.alias("before"))
    return ranges.withColumn("at", F.row_number().over(Window.partitionBy("range").orderBy("id"))).join(offsets, "range").select("id", (F.col("at") + F.col("before") - 1).alias("number"))


def _chance(*parts) -> F.Column:
    """A number in (0, 1) from a hash of parts."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def _chosen(rows: DataFrame, seed: int, step: int) -> DataFrame:
    """For each k one id, drawn with a chance in proportion to w."""
    return rows.groupBy("k").agg(F.max_by("id", F.struct(F.log(_chance("k", "id", F.lit(seed), F.lit(step))) / F.col("w"), "id")).alias("id"))


def sampled_paths(samples: DataFrame, arcs: DataFrame, seed: int = 42) -> DataFrame:
    """(k, id): the inner vertices of one shortest path for each sample (k, s, t), drawn evenly from all its shortest paths.

    Searched from both ends with numbers of paths, level by level for all samples at once; where the levels meet a vertex is drawn by
    the paths through it, and from there back to both ends a neighbour by the paths to it. arcs: at, to, both ways.
    """
    active = write(samples)
    sides = [[write(active.select("k", F.col(c).alias("id"), F.lit(1.0).alias("paths")))] for c in ("s", "t")]
    seen, out, step = [x[0].select("k", "id") for x in sides], None, 0
    while not active.isEmpty():  # ends: every level visits new vertices
        costs = [x[-1].join(active.select("k"), "k", "left_semi").count() for x in sides]
        which = int(costs[1] < costs[0])
        front = sides[which][-1].join(active.select("k"), "k", "left_semi")
        new = front.join(arcs, front["id"] == arcs["at"]).select("k", F.col("to").alias("id"), "paths").join(seen[which], ["k", "id"], "left_anti").groupBy("k", "id").agg(F.sum("paths").alias("paths"))
        sides[which].append(write(new))
        seen[which] = seen[which].unionByName(sides[which][-1].select("k", "id"))
        last = [x[-1] for x in sides]
        both = active.select("k").join(last[0].withColumnRenamed("paths", "one"), "k").join(last[1].withColumnRenamed("paths", "two"), ["k", "id"])
        step += 1
        middle = write(_chosen(both.select("k", "id", (F.col("one") * F.col("two")).alias("w")), seed, step))
        got = middle
        for levels in sides:  # from the middle back to either end
            here = middle
            for level in reversed(levels[:-1]):
                step += 1
                back = here.join(arcs, here["id"] == arcs["at"]).select("k", F.col("to").alias("id")).join(level, ["k", "id"]).withColumnRenamed("paths", "w")
                here = write(_chosen(back, seed, step))
                got = got.unionByName(here)
        out = got if out is None else out.unionByName(got)
        left = active.join(middle, "k", "left_anti")
        for x in last:
            left = left.join(x.select("k").distinct(), "k", "left_semi")
        active = write(left)
    ends = samples.select("k", F.explode(F.array("s", "t")).alias("id"))
    return (out if out is not None else samples.select("k", F.col("s").alias("id")).limit(0)).distinct().join(ends, ["k", "id"], "left_anti")


def _longest(v: DataFrame, e: DataFrame, arcs: DataFrame) -> int:
    """A bound on the vertices of any shortest path: twice the levels from one vertex of each component, and one."""
    seen = front = write(components(v, e).select(F.col("component").alias("id")).distinct())
    levels = 0
    while True:
        front = write(front.join(arcs, front["id"] == arcs["at"]).select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti"))
        if front.isEmpty():
            return 2 * levels + 1
        seen, levels = seen.unionByName(front), levels + 1


@tidy
def betweenness_within(vertices: DataFrame, edges: DataFrame, epsilon: float = 0.05, delta: float = 0.1, seed: int = 42, first: int = 256) -> DataFrame:
    """GR-16 for graphs whose sources are too many: (id, betweenness), scaled as by `betweenness`, with all values within epsilon of the
    exact ones with a chance of at least 1 - delta.

    Counts how many of some sampled shortest paths a vertex is inside of. Samples double until an empirical Bernstein bound over all vertices
    and rounds (half of delta) is within epsilon, or until as many as suffice for any graph whose shortest paths are as long
    (Riondato and Kornaropoulos, 2016; the other half). Their number depends on epsilon and the paths' length, not on the graph's size.
    """
    arcs = neighbours(undirected(edges).select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("id").alias("at"), F.col("nbr").alias("to"))
    arcs, v = write(arcs), write(_numbered(vertices.select("id").distinct()))
    n, ids = v.count(), v.select("id")
    long = _longest(ids, edges, arcs) if n > 2 else 0
    if long < 3:
        return ids.withColumn("betweenness", F.lit(0.0))
    within = epsilon * (n - 2) / n
    enough = math.ceil(0.5 / within**2 * (math.floor(math.log2(max(2, long - 2))) + 1 + math.log(2 / delta)))
    rounds = max(1, math.ceil(math.log2(max(1, enough / first))) + 1)
    log_term = math.log(3 * 2 * n * rounds / delta)
    counts, done = None, 0
    while True:
        upto = min(enough, max(first, 2 * done))
        s = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))
        k = v.sparkSession.range(done, upto).select(F.col("id").alias("k"), s.alias("x"), F.pmod(s + 1 + F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(n - 1)), F.lit(n)).alias("y"))
        name = lambda c, to: v.select(F.col("id").alias(to), F.col("number").alias(c))
        samples = write(k.join(name("x", "s"), "x").join(name("y", "t"), "y").select("k", "s", "t"))
        part = sampled_paths(samples, arcs, seed).groupBy("id").agg(F.count("*").alias("n"))
        counts = write(part if counts is None else counts.unionByName(part).groupBy("id").agg(F.sum("n").alias("n")))
        done = upto
        share = min(0.5, (counts.agg(F.max("n")).first()[0] or 0) / done)
        if done >= enough or math.sqrt(2 * share * (1 - share) * log_term / done) + 3 * log_term / done <= within:
            break
    return ids.join(counts, "id", "left").select("id", (F.coalesce("n", F.lit(0)) / F.lit(done) * F.lit(n / (n - 2))).alias("betweenness"))


@tidy
def triangles(edges: DataFrame) -> DataFrame:
    """GR-18: members (sorted array) of every triangle, whether or not it is part of a larger clique.

    Edges point from the vertex of lower (degree, id) to the other, so no vertex points at more than the square root of
    twice the edges, and each triangle is found once, at the edge of its two lower vertices.
    """
    return _closed(write(_upward(edges))).select(F.array_sort(F.array("u", "v", "w")).alias("members"))


def _closed(arcs: DataFrame, rows: list[int] | None = None) -> DataFrame:
    """u, v, w: every triangle u -> v, u -> w, v -> w of arcs (u, v).

    An arc goes on from the end that points at fewer: the other end has to point there too. An arc to a vertex that points at none goes.
    rows: gets the rows that are looked up.
    """
    out = write(arcs.groupBy("u").agg(F.count("*").alias("n")))
    sides = arcs.join(out.withColumnRenamed("n", "nu"), "u").join(out.withColumnsRenamed({"u": "v", "n": "nv"}), "v")
    low = F.col("nu") <= F.col("nv")
    sides = sides.select("u", "v", F.when(low, F.col("u")).otherwise(F.col("v")).alias("near"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("far"))
    two = sides.join(arcs.select(F.col("u").alias("near"), F.col("v").alias("w")), "near").where("w <> far").select("u", "v", "far", "w")
    if rows is not None:
        rows.append(two.count())
    return two.join(arcs.select(F.col("u").alias("far"), F.col("v").alias("w")), ["far", "w"]).select("u", "v", "w")


def _upward(edges: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """u, v: each undirected edge from the vertex of lower (degree, id) to the other; order: id, first, what comes before the degree."""
    und = write(undirected(edges))
    deg = und.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("deg"))
    deg = write(deg.withColumn("first", F.lit(0).cast("long")) if order is None else deg.join(order, "id"))
    one = lambda x: deg.select(F.col("id").alias(x), F.struct("first", "deg", "id").alias(f"o{x}"))
    sides = und.join(one("a"), "a").join(one("b"), "b")
    low = F.col("oa") < F.col("ob")
    return sides.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("v"))


@tidy
def core_bounds(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(id, first): an upper bound of each vertex's core number, from its degree by `rounds` of peeling.

    A round puts a vertex at the largest h such that h neighbours stand at h or more (Lue et al., 2016); repeated without end that
    is the core number. Values are counted before they are ordered, so a hub is no large group.
    """
    both = write(neighbours(undirected(edges).select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    at = both.groupBy("id").agg(F.count("*").alias("first"))
    for _ in range(rounds):
        held = both.join(at.select(F.col("id").alias("nbr"), "first"), "nbr").groupBy("id", "first").agg(F.count("*").alias("n"))
        reach = F.sum("n").over(Window.partitionBy("id").orderBy(F.desc("first")))
        at = write(held.select("id", F.least("first", reach).alias("h")).groupBy("id").agg(F.max("h").alias("first")))
    return at


@tidy
def maximal_cliques(edges: DataFrame, rows: list[int] | None = None) -> DataFrame:
    """GR-18: members (sorted array) of the maximal cliques of three or more, of any size.

    What is in no triangle is in no clique of three: triangles are listed first, and only their edges go on. Those point from the vertex of
    lower (core bound, degree, id) to the other, so that a hub is pointed at and out-lists
    stay small. A subproblem is a row: a clique and the candidates that continue it, at first a vertex and its out-list. Each round
    takes up all candidates joined with all others at once (a dense core ends there), and branches, a row each, on the
    candidates that are not neighbours of a pivot (the one with most neighbours). Rows are dealt anew each round, so no task holds more
    than its share of them. What some other vertex continues is no maximal clique and goes at the end.
    rows: gets the rows of each round.
    """
    with passing() as kept:
        closed = _closed(write(_upward(edges)))
        sides = F.array(*[F.struct(F.col(x).alias("src"), F.col(y).alias("dst")) for x, y in ("uv", "uw", "vw")])
        edges = write(closed.select(F.explode(sides).alias("e")).select("e.*").distinct())
        kept.append(edges)
    arcs = write(_upward(edges, core_bounds(edges)))
    out = write(arcs.groupBy("u").agg(F.collect_set("v").alias("out")))
    near = _closed(arcs).select("u", F.col("v").alias("y"), F.col("w").alias("z"))
    near = near.unionByName(near.select("u", F.col("z").alias("y"), F.col("y").alias("z")))
    near = write(near.groupBy("u", "y").agg(F.collect_set("z").alias("adj")))  # who is joined with whom in an out-list
    # Who is joined with no other of the list is in no clique of three with u.
    state = near.groupBy("u").agg(F.collect_set("y").alias("p")).select("u", F.array("u").alias("r"), "p")
    state, found = write(state.withColumn("k", F.monotonically_increasing_id())), None
    none = F.array().cast("array<string>")
    while not state.isEmpty():  # ends: candidates are fewer every round
        if rows is not None:
            rows.append(state.count())
        each = state.select("k", "u", "p", F.explode("p").alias("y")).join(near, ["u", "y"], "left").select("k", "y", F.size("p").alias("m"), F.array_intersect("p", F.coalesce("adj", none)).alias("a"))
        every = F.size("a") == F.col("m") - 1
        told = each.groupBy("k").agg(F.collect_list(F.when(every, F.col("y"))).alias("all"), F.max_by(F.col("a"), F.when(~every, F.struct(F.size("a"), "y"))).alias("by"))
        step = state.join(told, "k").select("u", F.concat("r", "all").alias("r"), F.array_except("p", "all").alias("p"), "by")
        step = write(step)
        ended = step.where(F.size("p") == 0).select("r")
        branch = step.where(F.size("p") > 0).withColumn("b", F.array_sort(F.array_except("p", "by"))).select("u", "r", "p", "b", F.posexplode("b").alias("i", "y"))
        branch = branch.join(near, ["u", "y"], "left").select("u", F.concat("r", F.array("y")).alias("r"), F.array_except(F.array_intersect("p", F.coalesce("adj", none)), F.slice("b", F.lit(1), F.col("i"))).alias("p"))
        branch = write(branch.withColumn("k", F.monotonically_increasing_id()))
        ended = ended.unionByName(branch.where(F.size("p") == 0).select("r")).where(F.size("r") > 2)
        found = ended if found is None else found.unionByName(ended)
        state = branch.where(F.size("p") > 0)
    if found is None:
        found = state.select("r")
    found = write(found.select(F.element_at("r", 1).alias("u"), F.array_sort("r").alias("members")))
    # Continued by a vertex of the same out-list: one that every other member is joined with.
    of = found.select("u", "members", F.explode("members").alias("y")).where("y <> u").join(near, ["u", "y"])
    inside = of.select("members", F.explode(F.array_except("adj", "members")).alias("z")).groupBy("members", "z").agg(F.count("*").alias("n")).where(F.col("n") == F.size("members") - 1)
    # Continued by an earlier vertex: one that points at all members.
    before = arcs.select(F.col("v").alias("u"), F.col("u").alias("w")).join(found.select("u").distinct(), "u", "left_semi").join(out.withColumnRenamed("u", "w"), "w")
    outside = found.join(before, "u").where(F.size(F.array_except("members", "out")) == 0)
    gone = inside.select("members").unionByName(outside.select("members")).distinct()
    return found.select("members").join(gone, "members", "left_anti")
