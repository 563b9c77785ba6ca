"""GR-10: components stored with their vertices and edges, so that any of them is read without a scan of the rest.

Rows are dealt to parts (folders) of about the same number of rows: components smaller than a part share parts by hash; a larger one
has parts of its own, over which its vertices and edges are spread, so that neither a giant component nor a hub of it is one task
or one file. An index tells a component's parts. Columns of the graph named component, part, first or parts are replaced.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegraph.functions.scratch import materialise, passing

ROWS = 4_000_000  # of a part
OWN = ("component", "part", "first", "parts")
FEW = 10_000  # parts that are named one by one when components are read; large components that are broadcast


def _placed(sizes: DataFrame, rows: int) -> tuple[int, DataFrame]:
    """The number of shared parts, and (component, first, parts) of the components that have parts of their own after those.

    sizes: component, n. There is at most one such component for each part, which bounds the window.
    """
    total = sizes.where(F.col("n") < rows).agg(F.sum("n")).first()[0] or 0
    shared = max(1, ceil(total / rows))
    large = sizes.where(F.col("n") >= rows).select("component", F.ceil(F.col("n") / rows).cast("int").alias("parts"))
    before = F.sum("parts").over(Window.orderBy("component").rowsBetween(Window.unboundedPreceding, -1))
    return shared, large.select("component", (F.coalesce(before, F.lit(0)) + shared).cast("int").alias("first"), "parts")


def _shared_part(shared: int) -> Column:
    return F.pmod(F.xxhash64("component"), F.lit(shared)).cast("int")


def store(vertices: DataFrame, edges: DataFrame, of: DataFrame, path: str, rows: int = ROWS) -> None:
    """Write a graph by component below path, which must not exist. of: (id, component), as of traverse.components.

    Edges with an end that is no vertex of `of` have no component and are left out.
    """
    with passing():
        of = materialise(of.select("id", "component"))
        v = vertices.drop(*OWN).join(of, "id")
        ends = [of.select(F.col("id").alias(c), *extra) for c, extra in (("src", ["component"]), ("dst", []))]
        e = materialise(edges.drop(*OWN).join(ends[0], "src").join(ends[1], "dst", "left_semi"))
        counted = v.groupBy("component").agg(F.count("*").alias("n_vertices")).join(e.groupBy("component").agg(F.count("*").alias("n_edges")), "component", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
        sizes = materialise(counted.withColumn("n", F.col("n_vertices") + F.col("n_edges")))
        shared, large = _placed(sizes, rows)
        large = materialise(large)
        if large.count() <= FEW:
            large = F.broadcast(large)
        index = sizes.drop("n").join(large, "component", "left").withColumns({"first": F.coalesce("first", _shared_part(shared)), "parts": F.coalesce("parts", F.lit(1))})
        index.repartitionByRange("component").sortWithinPartitions("component").write.parquet(f"{path}/index")
        for name, df, like, key in (("vertices", v, vertices, ("id",)), ("edges", e, edges, ("src", "dst"))):
            spread = F.col("first") + F.pmod(F.xxhash64(*key), F.col("parts")).cast("int")
            dealt = df.join(large, "component", "left").withColumn("part", F.coalesce(spread, _shared_part(shared)))
            dealt = dealt.select("component", *[c for c in like.columns if c not in OWN], "part")
            dealt.limit(0).coalesce(1).write.parquet(f"{path}/schema_{name}")
            dealt.repartition("part").sortWithinPartitions("part", "component").write.partitionBy("part").parquet(f"{path}/{name}")


def index(spark: SparkSession, path: str) -> DataFrame:
    """component, n_vertices, n_edges, first, parts: sorted by component inside its files, so that one is found by their bounds."""
    return spark.read.parquet(f"{path}/index")


def _rows(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/schema_{name}").schema).parquet(f"{path}/{name}")  # no folders where there are no rows


def component_graph(spark: SparkSession, path: str, component: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of one component; only its parts are read. One that is not there has none."""
    at = index(spark, path).where(F.col("component") == component).first()
    first, parts = (at["first"], at["parts"]) if at else (-1, 0)
    of = lambda name: _rows(spark, path, name).where(F.col("part").between(first, first + parts - 1) & (F.col("component") == component)).drop("part")
    return of("vertices"), of("edges")


def component_graphs(spark: SparkSession, path: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the components in wanted (component), with their component; only their parts are read where they are few."""
    asked = wanted.select("component").distinct()
    at = index(spark, path).join(asked, "component", "left_semi")
    parts = [r[0] for r in at.select(F.explode(F.expr("sequence(first, first + parts - 1)"))).distinct().limit(FEW + 1).collect()]  # FEW + 1 numbers at most

    def of(name: str) -> DataFrame:
        rows = _rows(spark, path, name)
        return (rows.where(F.col("part").isin(parts)) if len(parts) <= FEW else rows).drop("part").join(asked, "component", "left_semi")

    return of("vertices"), of("edges")
