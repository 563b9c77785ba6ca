"""Graph fixture of FIXTURES.md, section 2."""

import random

import pytest

from __spark_entry__ import queries
from casegraph.operators import graph as G
from casegraph.operators import traverse as T
from casegraph.plans.driver_views import edges, vertices

ENT = [("ent_001", "PERSON", "Rahul Sharma"), ("ent_002", "PHONE", "9876543210"), ("ent_003", "BANK_ACCOUNT", "HDFC0001234"), ("ent_004", "UPI_ID", "fraud@paytm"), ("ent_005", "VICTIM", "Priya Singh")]
REL = [("ent_001", "ent_002", "OWNS", 0.85, "observed"), ("ent_001", "ent_003", "OWNS", 0.72, "inferred"), ("ent_004", "ent_003", "TRANSFERRED_TO", 0.78, "observed"), ("ent_005", "ent_001", "ASSOCIATED_WITH", 0.65, "inferred")]


@pytest.fixture(scope="module")
def g(spark):
    v = G.project_vertices(spark.createDataFrame(ENT, "entity_id string, type string, value string"))
    e = G.project_edges(spark.createDataFrame(REL, "source_entity string, target_entity string, relationship string, confidence double, evidence_source string"))
    return G.build(v, e)


def test_filters(g):
    count = lambda **k: tuple(x.count() for x in G.filter_graph(*g, **k))
    assert count(types=["person"]) == (1, 0)
    assert count(rels=["owns"]) == (5, 2)
    assert count(min_confidence=0.9) == (5, 0)
    assert count(evidence_source="observed") == (5, 2)
    assert count(pattern="x") == (5, 0)


def test_traversal(spark, g):
    v, e = g
    seeds = spark.createDataFrame([("ent_001",)], "seed string")
    assert {r["id"] for r in T.ego(seeds, e, 1).collect()} == {"ent_001", "ent_002", "ent_003", "ent_005"}
    assert T.ego_edges(T.ego(seeds, e, 1), e).count() == 3
    pairs = spark.createDataFrame([("ent_001", "ent_003"), ("ent_002", "ent_004"), ("ent_001", "ent_001"), ("ent_001", "none")], "source string, target string")
    got = {(r["source"], r["target"]): (r["length"], r["directed"], r["path"]) for r in T.shortest_paths(pairs, e).collect()}
    assert got[("ent_001", "ent_003")][:2] == (1, True) and got[("ent_001", "ent_001")][0] == 0
    assert got[("ent_002", "ent_004")] == (3, False, ["ent_002", "ent_001", "ent_003", "ent_004"]) and len(got) == 3
    assert T.money_paths(spark.createDataFrame([("ent_004", "ent_003")], "source string, target string"), e).count() == 1
    assert {r["component"] for r in T.components(v, e).collect()} == {"ent_001"}
    assert [r["id"] for r in G.search(v, "rahul").collect()] == ["ent_001"]
    d = {r["id"]: r for r in G.degrees(e).collect()}["ent_001"]
    assert (d["in_degree"], d["out_degree"], d["degree"]) == (1, 2, 3)


def test_last_edge_wins(spark):
    v = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([("a", "b", "OWNS", 1), ("a", "b", "USES", 2), ("a", "z", "OWNS", 3)], "src string, dst string, rel string, seq long")
    assert [r["rel"] for r in G.build(v, e)[1].collect()] == ["USES"]
    assert G.build(v, e, multi_edges=True)[1].count() == 2


def test_components_of_a_long_path(spark):
    n = 200
    e = spark.createDataFrame([(f"v{i:03}", f"v{i + 1:03}") for i in range(n)], "src string, dst string")
    v = spark.createDataFrame([(f"v{i:03}",) for i in range(n + 3)], "id string")
    got = [r["component"] for r in T.components(v, e).collect()]
    assert got.count("v000") == n + 1 and len(set(got)) == 3


def test_no_caps_on_paths_and_cliques(spark):
    n = 21
    e = spark.createDataFrame([(f"v{i:02}", f"v{i + 1:02}") for i in range(n)] + [("v00", "w"), ("v21", "w")], "src string, dst string")
    got = T.shortest_paths(spark.createDataFrame([("v00", "v21")], "source string, target string"), e).collect()
    assert [(r["length"], r["directed"]) for r in got] == [(n, True)]
    clique = [f"k{i:02}" for i in range(14)]
    e = spark.createDataFrame([(a, b) for a in clique for b in clique if a < b] + [("k00", "x"), ("k01", "x"), ("x", "y")], "src string, dst string")
    assert sorted(r["members"] for r in T.maximal_cliques(e).collect()) == sorted([clique, ["k00", "k01", "x"]])


def test_registered_components_follow_every_relation(spark):
    d, root = "/root/testdata/sf0.001", {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for r in edges(spark, d).select("src", "dst").distinct().collect():
        x, y = sorted((find(r["src"]), find(r["dst"])))
        root[y] = x
    got = {r["id"]: r["component"] for r in queries()["components_whole"](spark, d).collect()}
    assert got == {r["id"]: find(r["id"]) for r in vertices(spark, d).select("id").collect()}
    assert sum(r["rank"] for r in queries()["pagerank_whole"](spark, d).collect()) == pytest.approx(1)


def brute_cliques(arcs):
    adj = {}
    for a, b in arcs:
        if a != b:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
    out = []

    def grow(r, p, x):
        if not p and not x and len(r) > 2:
            out.append(sorted(r))
        for v in sorted(p):
            grow(r | {v}, p & adj[v], x & adj[v])
            p = p - {v}
            x = x | {v}

    grow(set(), set(adj), set())
    return sorted(out)


@pytest.mark.parametrize("seed, n, m", [(1, 14, 55), (2, 40, 90), (3, 10, 42)])
def test_maximal_cliques_of_random_graphs(spark, seed, n, m):
    import random

    rng = random.Random(seed)
    arcs = [(f"v{rng.randrange(n):02}", f"v{rng.randrange(n):02}") for _ in range(m)]
    got = sorted(r["members"] for r in T.maximal_cliques(spark.createDataFrame(arcs, "src string, dst string")).collect())
    assert got == brute_cliques(arcs)


def test_a_dense_core_ends_in_few_rows(spark):
    """300 vertices, all joined but for four pairs: 16 cliques of 296, in one row for each vertex and branch, without Python."""
    core = [f"k{i:03}" for i in range(300)]
    missing = {(core[2 * j], core[2 * j + 1]) for j in range(4)}
    arcs = [(a, b) for i, a in enumerate(core) for b in core[i + 1 :] if (a, b) not in missing]
    rows = []
    cliques = T.maximal_cliques.__wrapped__(spark.createDataFrame(arcs, "src string, dst string"), rows)
    got = sorted(r["members"] for r in cliques.collect())
    assert len(got) == 16 and all(len(c) == 296 for c in got) and max(rows) < 5000 and len(rows) <= 5
    assert "Python" not in cliques._jdf.queryExecution().toString()


def test_core_bounds(spark):
    arcs = [(a, b) for a in "abcd" for b in "abcd" if a < b] + [("d", f"x{k}") for k in range(9)]
    got = {r["id"]: r["first"] for r in T.core_bounds(spark.createDataFrame(arcs, "src string, dst string")).collect()}
    assert all(got[v] == 3 for v in "abcd") and all(got[f"x{k}"] == 1 for k in range(9))


def test_triangles_look_up_no_wedges_that_nothing_can_close(spark):
    """20 vertices joined with 12 others: 1,320 pairs of neighbours, none of which is an edge; one triangle beside."""
    pairs = [(f"c{j:02}", f"s{k:02}") for j in range(20) for k in range(12)] + [("n", "c00"), ("n", "s00")]
    e, rows = spark.createDataFrame(pairs, "src string, dst string"), []
    got = T._closed(T.write(T._upward(e)), rows).collect()
    assert [sorted(r) for r in got] == [["c00", "n", "s00"]] and max(rows) <= 1


def test_components_of_hubs_take_few_steps(spark):
    """Stars joined by their hubs, a chain and pairs: hubs take their neighbours in, star steps the rest."""
    from casegraph.functions.scratch import materialise
    from casegraph.operators.components import hub_components, hub_steps

    rng = random.Random(3)
    e = [(f"h{k % 3}", f"v{k}") for k in range(300)] + [("h0", "h1"), ("v1", "v2"), ("v7", "v7")] + [(f"c{k}", f"c{k + 1}") for k in range(9)] + [(f"p{k}", f"q{k}") for k in range(20)] + [("v5", "v8"), ("v8", "v5"), (None, "v1")]
    e = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in e]
    root = {x: x for pair in e if None not in pair for x in pair}
    for _ in range(20):
        for a, b in e:
            if a and b:
                root[a] = root[b] = min(root[a], root[b])
    edges = spark.createDataFrame(e, "u string, v string").repartition(3)
    steps, rest = hub_steps(edges, materialise, 3)
    assert sum(x.count() for x in steps) >= 297 and rest.count() <= 40
    for hubs in (3, 64):
        got = {r["u"]: r["v"] for r in hub_components(edges, materialise, hubs).collect()}
        assert got == {x: c for x, c in root.items() if x != c}


def test_typed_neighbours_sorts_no_arcs(spark):
    v, e = spark.createDataFrame([("a", "SIM")], "id string, type string"), spark.createDataFrame([("a", "b")], "src string, dst string")
    plan = G.typed_neighbours(v, e)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort " not in plan


def test_cliques_are_sought_among_the_edges_of_triangles(spark, monkeypatch):
    """A star of 500 leaves, 20 vertices joined with 12 others, and one triangle: only its three edges are ordered and go on."""
    seen, bounds = [], T.core_bounds
    monkeypatch.setattr(T, "core_bounds", lambda e: seen.append(e.count()) or bounds(e))
    pairs = [("n", f"l{k:03}") for k in range(500)] + [(f"c{j:02}", f"s{k:02}") for j in range(20) for k in range(12)] + [("n", "c00"), ("s00", "n"), ("n", "n")]
    got = [r["members"] for r in T.maximal_cliques(spark.createDataFrame(pairs, "src string, dst string")).collect()]
    assert got == [["c00", "n", "s00"]] and seen == [3]
