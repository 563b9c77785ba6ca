"""Property-graph operators on two DataFrames: vertices (id, type, ...) and edges (src, dst, rel, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegraph import schemas as S
from casegraph.functions.expr import blank_null
from casegraph.operators.patterns import neighbours


def _first(df: DataFrame, *names: str, default: Column | None = None) -> Column:
    """First non-null of the columns that df has."""
    got = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*got, *([default] if default is not None else [])) if got or default is not None else F.lit(None)


def _list(df: DataFrame, plural: str, single: str) -> Column:
    """The plural column; where it is missing or empty, the single one as a list."""
    one = F.when(F.col(single).isNotNull(), F.array(F.col(single).cast("string"))) if single in df.columns else None
    many = F.when(F.size(plural) > 0, F.col(plural)) if plural in df.columns else None
    return F.coalesce(*[c for c in (many, one) if c is not None], F.array().cast("array<string>"))


def project_vertices(entities: DataFrame) -> DataFrame:
    """GR-1: entity rows of any layout as vertices."""
    e = entities
    empty = F.create_map().cast("map<string,string>")
    return e.select(
        _first(e, "entity_id", "id").cast("string").alias("id"), _first(e, "type", "entity_type", default=F.lit("UNKNOWN")).alias("type"),
        _first(e, "label", "value", "raw_value", "entity_id", "id").alias("label"), _first(e, "value", "label").alias("value"),
        _first(e, "confidence", default=F.lit(1.0)).cast("double").alias("confidence"), _first(e, "risk_score", default=F.lit(None)).cast("double").alias("risk"),
        _list(e, "case_ids", "case_id").alias("case_ids"), _list(e, "evidence_ids", "evidence_id").alias("evidence_ids"),
        _first(e, "attributes", default=empty).alias("attributes"), _first(e, "seq", default=F.lit(0)).cast("long").alias("seq"),
    )


def project_edges(relationships: DataFrame) -> DataFrame:
    """GR-2: relationship rows of any layout as edges."""
    r = relationships
    src, dst = _first(r, "source_entity", "src_id", "source"), _first(r, "target_entity", "dst_id", "target")
    rel = _first(r, "relationship", "type", default=F.lit("RELATED_TO"))
    empty = F.create_map().cast("map<string,string>")
    return r.select(
        F.coalesce(_first(r, "relationship_id", "id"), F.concat_ws("__", src, rel, dst)).alias("edge_id"), src.alias("src"), dst.alias("dst"), rel.alias("rel"),
        _first(r, "confidence", default=F.lit(1.0)).cast("double").alias("confidence"), _first(r, "evidence_source", default=F.lit("observed")).alias("evidence_source"),
        _list(r, "case_ids", "case_id").alias("case_ids"), _list(r, "evidence_ids", "evidence_id").alias("evidence_ids"),
        _first(r, "attributes", default=empty).alias("attributes"), _first(r, "seq", default=F.lit(0)).cast("long").alias("seq"),
    )


def in_case(df: DataFrame, case_id: str) -> DataFrame:
    """GR-4: rows whose case_ids hold the case, or whose case_id is it where the list is empty."""
    ids = F.when(F.size("case_ids") > 0, F.col("case_ids"))
    single = F.array(F.col("case_id")) if "case_id" in df.columns else F.array().cast("array<string>")
    return df.where(F.array_contains(F.coalesce(ids, single), case_id))


def build(vertices: DataFrame, edges: DataFrame, multi_edges: bool = False) -> tuple[DataFrame, DataFrame]:
    """GR-3: the last row of each vertex, edges with both ends, and the last edge of each (src, dst) unless multi_edges."""
    last = lambda df, *key: df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("seq")))).where("_n = 1").drop("_n")
    v = last(vertices, "id") if "seq" in vertices.columns else vertices.dropDuplicates(["id"])
    e = induced(edges, v)
    return v, e if multi_edges or "seq" not in edges.columns else last(e, "src", "dst")


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends among the vertices."""
    ids = vertices.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def filter_graph(
    vertices: DataFrame, edges: DataFrame, types: list[str] | None = None, rels: list[str] | None = None, min_confidence: float | None = None, evidence_source: str | None = None, pattern: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """GR-6: vertices of the types, edges between them that pass the edge filters; isolated vertices stay."""
    if types:
        vertices = vertices.where(F.upper("type").isin([t.upper() for t in types]))
        edges = induced(edges, vertices)
    if rels:
        edges = edges.where(F.upper("rel").isin([r.upper() for r in rels]))
    if min_confidence is not None:
        edges = edges.where(F.col("confidence") >= min_confidence)
    if evidence_source:
        edges = edges.where(F.col("evidence_source") == evidence_source)
    if pattern:
        edges = edges.where(F.try_element_at("attributes", F.lit("pattern")) == pattern)
    return vertices, edges


def search(vertices: DataFrame, query: str) -> DataFrame:
    """GR-11: vertices whose label, value or id contains the text, whatever the case."""
    columns = [c for c in ("label", "value", "id") if c in vertices.columns]
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False))
    return vertices.where(hit)


def degrees(edges: DataFrame) -> DataFrame:
    """GR-13: in, out and total degree and the summed confidence, in one shuffle; a self-loop counts once in each."""
    ends = F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    e = edges.select(F.explode(ends).alias("e"), F.col("confidence").cast("decimal(18,4)").alias("c")).select("e.*", "c")
    return e.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"), F.sum("c").cast("double").alias("weight"))


def typed_neighbours(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """GR-14: how many neighbours of a vertex are accounts, devices and SIMs; one linked both ways counts twice."""
    types = vertices.select(F.col("id").alias("nbr"), F.upper("type").alias("t")).hint("shuffle_hash")  # the arcs are not sorted
    n = neighbours(edges).join(types, "nbr")
    count = lambda types: F.count(F.when(F.col("t").isin(*types), 1))
    return n.groupBy("id").agg(count(S.ACCOUNT).alias("accounts"), count(S.DEVICE).alias("devices"), count(S.SIM).alias("sims"))


def undirected(edges: DataFrame) -> DataFrame:
    """GR-17: each pair once, without loops: a < b."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def export(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GR-5: vertices and edges as rows of plain columns and a metadata struct."""
    meta = lambda df, *names: F.struct(*[F.col(n) for n in names if n in df.columns])
    first = lambda df: F.try_element_at("evidence_ids", F.lit(1)) if "evidence_ids" in df.columns else F.lit(None).cast("string")
    v = vertices.select("id", "type", "label", first(vertices).alias("evidence_id"), meta(vertices, "confidence", "risk", "case_ids", "attributes").alias("metadata"))
    e = edges.select("src", "dst", "rel", first(edges).alias("evidence_id"), meta(edges, "confidence", "evidence_source", "case_ids", "attributes").alias("metadata"))
    return v, e


def node_detail(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """GR-12 for every vertex: degrees, number of distinct neighbours (itself excluded) and of money edges."""
    ends = F.array(
        F.struct(F.col("src").alias("id"), F.col("dst").alias("nbr"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.col("src").alias("nbr"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    e = edges.select(F.explode(ends).alias("e"), F.upper("rel").isin(*S.MONEY).alias("money")).select("e.*", "money")
    d = e.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.countDistinct(F.when(F.col("nbr") != F.col("id"), F.col("nbr"))).alias("neighbours"), F.count(F.when(F.col("money"), 1)).alias("money_edges"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("in_degree", "out_degree", "neighbours", "money_edges")}
    return vertices.select("id", "type", "label").join(d, "id", "left").withColumns(zero)


def node_evidence(vertices: DataFrame, evidence: DataFrame) -> DataFrame:
    """GR-12: the evidence rows of each vertex."""
    v = vertices.select("id", F.explode("evidence_ids").alias("evidence_id")).where(blank_null(F.col("evidence_id")).isNotNull())
    return v.join(evidence, "evidence_id")
