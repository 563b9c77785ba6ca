"""Registered queries against their own SQL in DuckDB, and whole-graph queries against plain Python."""

from __future__ import annotations

import glob
import os
import random
from collections import deque

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from casegraph.operators import traverse as T
from casegraph.plans import driver_views
from casegraph.plans.driver_views import edges, vertices

D = "/root/testdata/sf0.001"
NAMES = (
    "norm_sims norm_devices norm_accounts norm_upi upi_errors norm_complaints norm_phones norm_locations norm_unknown norm_dates detector_dates io_csv io_json_wrapped io_delimited io_append io_replace io_of_case io_validate provenance first_rows stream_ingest "
    "organisations optional_mentions responses entities_of_case graph_vertices graph_edges node_evidence evidence_of_case cases_created cases_updated case_by_id audit_kept briefs_stored live_or_sample triangles profile_numeric auc_ap component_sizes linear_score class_report stream_redone dense_clusters money_paths_whole "
    "component_graphs component_graphs_of_nations answers_edges answers_warnings ingest_multiline"
).split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries()[name](spark, D)
    rel = con.sql(oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got == want


def brandes(nodes, arcs, sources):
    """Betweenness from some sources, summed over both directions."""
    near = {v: set() for v in nodes}
    for a, b in arcs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    total = dict.fromkeys(nodes, 0.0)
    for s in sources:
        order, before, paths, far, todo = [], {v: [] for v in nodes}, dict.fromkeys(nodes, 0), {s: 0}, deque([s])
        paths[s] = 1
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in near[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    todo.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                total[w] += share[w]
    return total


def test_betweenness_and_roles_of_the_whole_graph(spark):
    v, e = vertices(spark, D), edges(spark, D)
    nodes = [r["id"] for r in v.select("id").collect()]
    arcs = [(r["src"], r["dst"]) for r in e.select("src", "dst").collect()]
    n = len(nodes)
    want = {k: x / ((n - 1) * (n - 2)) for k, x in brandes(nodes, arcs, nodes).items()}
    got = {r["id"]: r["betweenness"] for r in queries()["betweenness_whole"](spark, D).collect()}
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) <= 0.05 < max(want.values())
    roles = queries()["roles_whole"](spark, D).collect()
    assert len(roles) == n and all(0 <= r["role_score"] <= 1 for r in roles)


def test_betweenness_from_every_source(spark):
    arcs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("b", "d"), ("f", "g"), ("a", "a")]
    nodes = sorted({x for a in arcs for x in a})
    v = spark.createDataFrame([(x,) for x in nodes], "id string")
    e = spark.createDataFrame(arcs, "src string, dst string")
    n = len(nodes)
    want = {k: x / ((n - 1) * (n - 2)) for k, x in brandes(nodes, arcs, nodes).items()}
    assert {r["id"]: r["betweenness"] for r in T.betweenness(v, e).collect()} == pytest.approx(want)


@pytest.mark.parametrize("seed, n, m", [(1, 14, 9), (2, 30, 32), (3, 24, 23)])
def test_betweenness_of_graphs_with_hanging_trees(spark, seed, n, m):
    rng = random.Random(seed)
    nodes = [f"v{k:02}" for k in range(n)]
    arcs = sorted({tuple(sorted(rng.sample(nodes, 2))) for _ in range(m)})
    want = {k: x / ((n - 1) * (n - 2)) for k, x in brandes(nodes, arcs, nodes).items()}
    e = spark.createDataFrame(arcs, "src string, dst string")
    got = {r["id"]: r["betweenness"] for r in T.betweenness(spark.createDataFrame([(x,) for x in nodes], "id string"), e).collect()}
    assert got == pytest.approx(want)


def test_betweenness_of_a_star_takes_work_by_its_edges(spark, monkeypatch):
    written, write = [], T.write
    monkeypatch.setattr(T, "write", lambda df: written.append(write(df)) or written[-1])
    n = 3000
    e = spark.range(1, n).select(F.col("id").cast("string").alias("src"), F.lit("0").alias("dst"))
    got = {r["id"]: r["betweenness"] for r in T.betweenness.__wrapped__(spark.range(n).select(F.col("id").cast("string").alias("id")), e).where("betweenness > 0").collect()}
    assert got == pytest.approx({"0": 1.0}) and max(t.count() for t in written) <= 2 * n


def test_triangles_inside_larger_cliques(spark):
    e = spark.createDataFrame([(a, b) for a in "abcd" for b in "abcd" if a < b] + [("d", "e"), ("a", "b")], "src string, dst string")
    assert sorted("".join(r["members"]) for r in T.triangles(e).collect()) == ["abc", "abd", "acd", "bcd"]
    assert [r["members"] for r in T.maximal_cliques(e).collect()] == [list("abcd")]


def test_edges_are_dealt_by_the_lines_they_come_from(spark, monkeypatch):
    """A task's share of lines does not grow with the table, and the pairs are those of any other dealing."""
    small = "/root/testdata/sf0.001"
    whole = {tuple(r) for r in edges(spark, small).collect()}
    monkeypatch.setattr(driver_views, "LINES", 500)
    dealt = edges(spark, small)
    lines = spark.read.parquet(f"{small}/lineitem.parquet").count()
    assert f", {-(-lines // 500)}), REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    rows = [tuple(r) for r in dealt.collect()]
    assert set(rows) == whole and len(rows) == len(whole)


def test_findings_derive_the_edges_once(spark, monkeypatch):
    from casegraph.plans import graph_queries

    made = []
    monkeypatch.setattr(graph_queries, "edges", lambda *a: made.append(edges(*a)) or made[-1])
    plan = graph_queries.findings_all(spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert len(made) == 1 and "l_suppkey" not in plan


def test_betweenness_small_leaves_out_no_row(spark):
    """Every customer and supplier lies in its nation's star, and every vertex has a row."""
    read = lambda name: spark.read.parquet(f"{D}/{name}.parquet").collect()
    arcs = [(f"C{r['c_custkey']}", f"N{r['c_nationkey']}") for r in read("customer")] + [(f"S{r['s_suppkey']}", f"N{r['s_nationkey']}") for r in read("supplier")]
    nodes = sorted({x for a in arcs for x in a} | {f"N{r['n_nationkey']}" for r in read("nation")} | {f"P{r['p_partkey']}" for r in read("part")})
    n = len(nodes)
    want = {k: x / ((n - 1) * (n - 2)) for k, x in brandes(nodes, arcs, nodes).items()}
    got = {r["id"]: r["betweenness"] for r in queries()["betweenness_small"](spark, D).collect()}
    assert got == pytest.approx(want, abs=1e-9)
