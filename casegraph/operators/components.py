"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), on what hubs leave of a graph.

Before them, `hub_steps` takes the vertices with most edges as hubs and merges every neighbour of one into it, as long as that halves the
edges: two joins of the edges with the vertices each, where a star step takes many. Which vertices are hubs changes the work only.

Each star step takes the least neighbour of every node (aggregated before it is shuffled) and joins it back to the edges, so
the edges of a hub may be split over tasks: no neighbour list is ever collected or sorted in one place, and the number
of steps grows with the logarithm of the longest path. Steps are written out between rounds, so lost executors redo one round at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.join(both.groupBy("u").agg(F.min("v").alias("m")), "u").withColumn("m", F.least("u", "m"))
    return least.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # Every row has u > v here.
    least = edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")
    return least.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()


def star_components(edges: DataFrame, write: Callable[[DataFrame], DataFrame], max_rounds: int = 50) -> DataFrame:
    """(u, v): every node of an edge that is not the least of its component, with that least node.

    edges: u, v (any direction, repeats and loops allowed). write cuts lineage: it stores a DataFrame and returns it.
    """
    now = write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _digest(now)
    for _ in range(max_rounds):
        now = write(_small_star(_large_star(now)))
        old, state = state, _digest(now)
        if old == state:
            return now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


HUBS = 64  # of a step: they are broadcast
REPRESENTATIVES = 100_000  # components that are few enough to be broadcast


def _swapped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("v").alias("u"), F.col("u").alias("v"))


def hub_steps(edges: DataFrame, write: Callable[[DataFrame], DataFrame], hubs: int = HUBS) -> tuple[list[DataFrame], DataFrame]:
    """(steps, rest): for each step the vertices that it merges (u) and the hub they are merged into (to), and the edges (u, v) between
    what is left after all steps, none of them a loop."""
    now, steps = write(edges.where("u <> v").select("u", "v")), []
    n = now.count()
    while n > hubs:
        ends = now.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
        top = F.broadcast(write(ends.orderBy(F.desc("n"), "id").limit(hubs)))  # HUBS rows
        near = now.unionByName(_swapped(now)).join(top.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.max(F.struct("n", "v"))["v"].alias("to"))
        near = write(near.join(top.select(F.col("id").alias("u")), "u", "left_anti"))
        into = near.hint("shuffle_hash")  # the edges are not sorted
        left = now.join(into, "u", "left").select(F.coalesce("to", "u").alias("u"), "v")
        left = left.join(into.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("to", "v").alias("v"))
        now = write(left.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        steps.append(near)
        before, n = n, now.count()
        if 2 * n > before:
            break
    return steps, now


def hub_components(edges: DataFrame, write: Callable[[DataFrame], DataFrame], hubs: int = HUBS) -> DataFrame:
    """As star_components, for graphs of many edges."""
    steps, rest = hub_steps(edges, write, hubs)
    of = star_components(rest, write).select("u", F.col("v").alias("to"))
    for near in reversed(steps):  # what a step merged is in no later one
        up = near.withColumnRenamed("to", "at").join(of.withColumnsRenamed({"u": "at", "to": "top"}), "at", "left").select("u", F.coalesce("top", "at").alias("to"))
        of = write(of.unionByName(up))
    of = of.unionByName(of.select(F.col("to").alias("u"), "to").distinct())
    least = write(of.groupBy("to").agg(F.min("u").alias("v")))
    least = F.broadcast(least) if least.count() <= REPRESENTATIVES else least
    return write(of.join(least, "to").where("u <> v").select("u", "v"))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
