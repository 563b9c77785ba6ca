"""Paths of whole tables of pairs against plain Python."""

from __future__ import annotations

import random

from collections import deque

import pytest

from casegraph.operators import traverse as T

PAIRS = "source string, target string"


def graph(seed, n, m):
    rng = random.Random(seed)
    return sorted({(f"v{rng.randrange(n)}", f"v{rng.randrange(n)}") for _ in range(m)})


def near(arcs):
    out = {}
    for a, b in arcs:
        out.setdefault(a, set()).add(b)
    return out


def least_shortest(adj, s, t):
    """The least of the shortest paths, by whole enumeration of levels."""
    level, seen = {s: [s]}, {s}
    while level:
        if t in level:
            return level[t]
        new = {}
        for v, path in level.items():
            for w in adj.get(v, ()):
                if w not in seen and (w not in new or [*path, w] < new[w]):
                    new[w] = [*path, w]
        seen |= set(new)
        level = new
    return None


def simple_paths(adj, s, t, most):
    out, todo = [], deque([[s]])
    while todo:
        p = todo.popleft()
        if p[-1] == t and len(p) > 1:
            out.append(p)
            continue
        if len(p) <= most:
            todo.extend([*p, w] for w in adj.get(p[-1], ()) if w not in p)
    return sorted(out, key=lambda p: (len(p), p))


@pytest.mark.parametrize("seed, n, m", [(1, 25, 40)])
def test_shortest_paths_of_all_pairs(spark, seed, n, m):
    arcs = graph(seed, n, m)
    e = spark.createDataFrame(arcs, "src string, dst string")
    pairs = [(f"v{i}", f"v{j}") for i in range(n) for j in range(0, n, 3)]
    got = {(r["source"], r["target"]): (r["path"], r["length"], r["directed"]) for r in T.shortest_paths(spark.createDataFrame(pairs * 2, PAIRS), e).collect()}
    out, both, nodes = near(arcs), near(arcs + [(b, a) for a, b in arcs]), {v for a in arcs for v in a}
    want = {}
    for s, t in pairs:
        if s in nodes and t in nodes:
            p, directed = least_shortest(out, s, t), True
            if p is None:
                p, directed = least_shortest(both, s, t), False
            if p is not None:
                want[(s, t)] = (p, len(p) - 1, directed)
    assert got == want


def test_both_ends_visit_less_than_one(spark):
    """A hub's neighbourhood is not searched from the other end's side: the levels stay small."""
    arcs = [(f"a{k}", f"a{k + 1}") for k in range(6)] + [("a6", f"leaf{k}") for k in range(300)] + [(f"leaf{k}", "z") for k in range(300)]
    e = T.write(spark.createDataFrame(arcs, "at string, to string"))
    rows = []
    got = T.meet(T.write(spark.createDataFrame([("a0", "a6"), ("a0", "leaf7")], PAIRS)), e, rows).collect()
    assert sorted((r["target"], r["length"]) for r in got) == [("a6", 6), ("leaf7", 7)] and max(rows) <= 3


@pytest.mark.parametrize("seed, n, m, top, beam", [(1, 12, 40, 10, None), (2, 8, 36, 3, 2)])
def test_money_paths_of_all_pairs(spark, seed, n, m, top, beam):
    arcs = graph(seed, n, m)
    e = spark.createDataFrame([(a, b, "TRANSFERRED_TO") for a, b in arcs] + [("v1", "v0", "OWNS")], "src string, dst string, rel string")
    pairs = [(f"v{i}", f"v{j}") for i in range(0, n, 2) for j in range(0, n, 3)]
    got = {}
    for r in T.money_paths(spark.createDataFrame(pairs, PAIRS), e, max_hops=5, top=top, beam=beam).collect():
        got.setdefault((r["source"], r["target"]), []).append((r["rank"], r["path"], r["length"]))
    adj = near(arcs)
    want = {p: [(k + 1, path, len(path) - 1) for k, path in enumerate(simple_paths(adj, *p, 5)[:top])] for p in pairs if p[0] != p[1]}
    assert {p: sorted(x) for p, x in got.items()} == {p: x for p, x in want.items() if x}


def test_money_paths_do_not_list_what_they_do_not_return(spark):
    """Layers of 12 that are wholly joined: 12**4 paths of five hops, of which ten are asked."""
    arcs = [("s", f"a{k:02}") for k in range(12)] + [(f"{x}{j:02}", f"{y}{k:02}") for x, y in ("ab", "bc", "cd") for j in range(12) for k in range(12)] + [(f"d{k:02}", "t") for k in range(12)]
    e = spark.createDataFrame([(a, b, "PAID_TO") for a, b in arcs], "src string, dst string, rel string")
    rows = []
    got = T.money_paths(spark.createDataFrame([("s", "t")], PAIRS), e, rows=rows).collect()
    assert sorted(r["path"] for r in got) == [["s", "a00", "b00", "c00", f"d{k:02}", "t"] for k in range(10)] and max(rows) < 500


@pytest.mark.parametrize("seed, n, m, epsilon", [(1, 30, 45, 0.1)])
def test_betweenness_within_its_bound(spark, seed, n, m, epsilon):
    arcs = graph(seed, n, m)
    e = spark.createDataFrame(arcs, "src string, dst string")
    v = spark.createDataFrame([(f"v{k}",) for k in range(n + 2)], "id string")
    exact = {r["id"]: r["betweenness"] for r in T.betweenness(v, e).collect()}
    got = {r["id"]: r["betweenness"] for r in T.betweenness_within(v, e, epsilon).collect()}
    assert set(got) == set(exact) and max(exact.values()) > epsilon
    assert max(abs(got[i] - exact[i]) for i in exact) <= epsilon


def test_betweenness_of_small_graphs(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert [r["betweenness"] for r in T.betweenness_within(ids("a", "b", "c", "d"), e).collect()] == [0.0] * 4
    assert T.betweenness_within(ids(), e.limit(0)).count() == 0
    star = spark.createDataFrame([("h", x) for x in "abcdef"], "src string, dst string")
    got = {r["id"]: r["betweenness"] for r in T.betweenness_within(ids("h", *"abcdef"), star, 0.1).collect()}
    assert got["h"] == pytest.approx(1, abs=0.1) and all(got[x] == 0 for x in "abcdef")


def test_money_paths_begin_nothing_longer_than_they_need(spark):
    """Twelve paths of two hops, of which ten are asked: no prefix of the longer ones is extended, and one round ends the pair."""
    mid = [f"m{k:02}" for k in range(12)]
    arcs = [("s", m) for m in mid] + [(m, "t") for m in mid] + [(a, b) for a in mid for b in mid if a != b] + [("s", "s")]
    e = spark.createDataFrame([(a, b, "PAID_TO") for a, b in arcs], "src string, dst string, rel string")
    rows = []
    got = T.money_paths(spark.createDataFrame([("s", "t"), ("t", "s")], PAIRS), e, max_hops=5, rows=rows).collect()
    assert sorted((r["rank"], r["path"]) for r in got) == [(k + 1, ["s", m, "t"]) for k, m in enumerate(mid[:10])] and len(rows) == 1


def test_shortest_paths_derive_edges_once(spark):
    """Edges may be costly to derive: the vertices, directed and undirected arcs come from one table of them."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    e = spark.createDataFrame([("a", "b"), ("c", "b")], "src string, dst string").mapInArrow(seen, "src string, dst string")
    got = T.shortest_paths(spark.createDataFrame([("a", "b"), ("a", "c")], PAIRS), e).collect()
    assert sorted((r["target"], r["path"], r["directed"]) for r in got) == [("b", ["a", "b"], True), ("c", ["a", "b", "c"], False)] and read.value == 2


def test_shortest_paths_around_steep_levels(spark, monkeypatch):
    """Every level counts as steep: pairs are found over one arc between both ends' levels, and over shared first steps."""
    monkeypatch.setattr(T, "STEEP", 1)
    rng = random.Random(4)
    arcs = [(f"c{k:02}", f"n{k % 3}") for k in range(24)] + [(f"c{k:02}", f"s{rng.randrange(30):02}") for k in range(24) for _ in range(2)] + [(f"s{k:02}", f"n{k % 3}") for k in range(30)] + [("n2", "z0"), ("z0", "z1"), ("z1", "z2"), ("z2", "z2")]
    both = arcs + [(b, a) for a, b in arcs]
    pairs = [(f"c{i:02}", x) for i in range(24) for x in [f"c{j:02}" for j in range(0, 24, 5)] + ["n1", "z2", "s07"]]
    got = {(r["source"], r["target"]): (r["path"], r["length"]) for r in T.meet(spark.createDataFrame(pairs, PAIRS), T.write(spark.createDataFrame(sorted(set(both)), "at string, to string"))).collect()}
    want = {p: least_shortest(near(both), *p) for p in pairs}
    assert {len(x) for x in want.values()} >= {1, 2, 3, 4, 5, 6} and got == {p: (x, len(x) - 1) for p, x in want.items()}


def test_shortest_paths_do_not_visit_what_lies_two_steps_off(spark, monkeypatch):
    """40 sources around two hubs that share 300 others: no level of 40 times 300 is made."""
    monkeypatch.setattr(T, "STEEP", 1000)
    arcs = [(f"c{k:02}", f"a{k % 2}") for k in range(40)] + [(h, f"m{k:03}") for h in ("a0", "a1") for k in range(300)]
    e = T.write(spark.createDataFrame(arcs + [(b, a) for a, b in arcs], "at string, to string"))
    pairs, rows = [(f"c{k:02}", f"c{(k + 7) % 40:02}") for k in range(40)], []
    got = {r["source"]: r["path"] for r in T.meet(spark.createDataFrame(pairs, PAIRS), e, rows).collect()}
    assert got == {s: [s, f"a{int(s[1:]) % 2}", "m000", f"a{int(t[1:]) % 2}", t] for s, t in pairs} and max(rows) <= 40
