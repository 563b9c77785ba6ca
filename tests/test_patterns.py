"""Golden values of FIXTURES.md, section 1, and invariants of the detectors."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest

from __spark_entry__ import queries
from casegraph.operators import patterns as P
from casegraph.operators import roles as R
from casegraph.operators import traverse as T
from tests.fixtures import frames


def rows(df, *key):
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r for r in df.collect()}


def test_velocity(spark):
    got = rows(P.velocity(frames(spark)[2]), "account")
    assert set(got) == {"acc_001", "acc_002"}
    assert (got["acc_001"]["n"], got["acc_001"]["volume"], got["acc_001"]["score"], got["acc_001"]["confidence"]) == (7, 237000.0, 0.4519, 0.55)
    assert (got["acc_002"]["n"], got["acc_002"]["volume"], got["acc_002"]["score"]) == (5, 370000.0, 0.3888)


def test_mule(spark):
    got = rows(P.mule(frames(spark)[2]), "account")
    assert set(got) == {"acc_002"}
    r = got["acc_002"]
    assert (r["received"], r["n_in"], r["forwarded"], r["n_out"], r["ratio"], r["score"], r["confidence"]) == (200000.0, 3, 170000.0, 2, 0.85, 0.6133, 0.55)


def test_chains(spark):
    t = frames(spark)[2]
    got = P.layering(t).collect()
    assert [(r["a"], r["b"], r["c"], r["d"], r["i1"], r["i2"], r["i3"], r["volume"], r["score"]) for r in got] == [("acc_001", "acc_002", "acc_003", "acc_004", 1, 3, 5, 240000.0, 0.6079)]
    got = P.rapid_hop(t).collect()
    assert [(r["i1"], r["i2"], r["i3"], r["volume"], r["hours"], r["score"]) for r in got] == [(2, 3, 5, 220000.0, 1.5, 0.6899)]


def test_chain_legs_without_time_always_fit(spark):
    t = spark.createDataFrame([(1, "c1", "a", "b", 1.0, None), (2, "c1", "b", "c", None, 10**15), (3, "c1", "c", "d", 3.0, 0)], "id long, case_id string, src string, dst string, amount double, us long")
    assert P.chains(t, 1).count() == 0  # the anchor is leg 2's time
    t = spark.createDataFrame([(1, "c1", "a", "b", 1.0, 5), (2, "c1", "b", "c", None, None), (3, "c1", "c", "d", 3.0, 0)], "id long, case_id string, src string, dst string, amount double, us long")
    assert [(r["i1"], r["i3"], r["volume"]) for r in P.chains(t, 1).collect()] == [(1, 3, 4.0)]


def test_chains_of_repeated_legs_are_found_once_and_not_shuffled(spark):
    """Against all triples of legs; pairs of accounts with many transfers that share several time buckets, some untimed."""
    rng, hour = random.Random(11), 3_600_000_000
    legs = [(k, "c1" if k % 3 else "c2", f"v{rng.randrange(5)}", f"v{rng.randrange(5)}", float(rng.randrange(99)), None if k % 9 == 0 else rng.randrange(40 * hour)) for k in range(180)]
    t = spark.createDataFrame(legs, "id long, case_id string, src string, dst string, amount double, us long")
    for hours in (1, 3):
        fits = lambda x, y: x is None or y is None or abs(y - x) <= hours * hour  # noqa: B023, E731
        want = {}
        for i1, case, a, b, m1, u1 in legs:
            for i2, _, _, c, m2, u2 in (y for y in legs if a != b and y[1:3] == (case, b) and y[3] not in (a, b) and fits(u1, y[5])):
                anchor = u2 if u1 is None else u1
                for i3, _, _, d, m3, u3 in (z for z in legs if z[1:3] == (case, c) and z[3] not in (a, b, c) and fits(anchor, z[5])):
                    key, got = (case, a, b, c, d), (i1, i2, i3, anchor, u3, m1 + m2 + m3)
                    want[key] = min(want.get(key, got), got, key=lambda x: x[:3])
        out = P.chains(t, hours)
        rows = out.collect()
        assert {tuple(r)[:5]: tuple(r)[5:] for r in rows} == want and len(rows) == len(want) > 50
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_shared(spark):
    v, e, t, c = frames(spark)
    assert [(r["id"], r["n"], r["score"], r["confidence"]) for r in P.shared_device(v, e).collect()] == [("dev_001", 3, 0.31, 0.55)]
    assert [(r["id"], r["n"], r["score"]) for r in P.shared_sim(v, e).collect()] == [("sim_001", 2, 0.2689)]
    r = P.sim_swap(v, e, t).first()
    assert (r["id"], r["n_phones"], r["n_accounts"], r["tx"], r["score"], r["confidence"]) == ("sim_001", 2, 1, 7, 0.4811, 0.7)
    r = P.comm_hub(c).first()
    assert (r["caller"], r["n"], r["ratio"], r["score"]) == ("ph_001", 6, 3.6923, 0.4562)
    assert P.hub_edges(v, e, least=2).first()["n"] == 2


def test_cliques(spark):
    v, e, _, _ = frames(spark)
    got = {tuple(r["members"]): (r["avg_risk"], r["score"], r["confidence"]) for r in P.dense_clusters(T.maximal_cliques(e), v).collect()}
    assert got == {("acc_001", "acc_002", "acc_003", "dev_001"): (0.575, 0.5922, 0.75), ("acc_001", "p_001", "ph_001"): (0.6333, 0.5424, 0.75), ("ph_001", "ph_002", "sim_001"): (0.5, 0.5157, 0.75)}


def test_roles(spark):
    v, e, t, c = frames(spark)
    between, rank = T.betweenness(v, e), T.pagerank(v, e)
    b = {r["id"]: r["betweenness"] for r in between.collect()}
    p = {r["id"]: r["rank"] for r in rank.collect()}
    want = {"p_001": (0.181818, 0.021958), "p_002": (0.045455, 0.021958), "p_003": (0, 0.028179), "ph_001": (0.518182, 0.028179), "ph_002": (0.1, 0.037278), "ph_003": (0.181818, 0.027946), "acc_001": (0.354545, 0.236978), "acc_002": (0.090909, 0.238939), "acc_003": (0, 0.231282), "acc_004": (0, 0.045712), "sim_001": (0, 0.059633), "dev_001": (0, 0.021958)}
    for k, (x, y) in want.items():
        assert b[k] == pytest.approx(x, abs=1e-6) and p[k] == pytest.approx(y, abs=2e-6), k
    assert sum(p.values()) == pytest.approx(1)
    got = rows(R.assign(v, e, t, c, between, rank), "id")
    roles = {"p_001": ("Potential Coordinator", 0.469), "p_002": ("Potential Coordinator", 0.2898), "p_003": ("Victim", 0.85), "ph_001": ("Potential Coordinator", 0.6335), "ph_002": ("Potential Intermediary", 0.4498), "ph_003": ("Potential Intermediary", 0.5974), "acc_001": ("Potential Coordinator", 0.6965), "acc_002": ("Potential Mule Account", 0.5956), "acc_003": ("Potential Coordinator", 0.417), "acc_004": ("Victim", 0.5), "sim_001": ("Technical/Device Node", 0.313), "dev_001": ("Technical/Device Node", 0.7369)}
    assert {k: (r["primary_role"], r["role_score"]) for k, r in got.items()} == roles
    assert "forwarding_ratio=0.85" in got["acc_002"]["evidence"]


def test_empty(spark):
    v, e, t, c = (df.limit(0) for df in frames(spark))
    for out in (P.velocity(t), P.mule(t), P.layering(t), P.comm_hub(c), P.shared_device(v, e), T.maximal_cliques(e), T.betweenness(v, e), T.components(v, e)):
        assert out.count() == 0


def test_registered_findings_have_layering(spark):
    """PT-10 on the tables: every distinct chain within 48 hours is a finding of findings_whole."""
    found = queries()["findings_whole"](spark, "/root/testdata/sf0.001")
    assert found.where("pattern = 'layering'").count() == 1247


def test_velocity_does_not_go_through_a_window_for_each_leg(spark):
    """A leg's cost does not grow with its window: no frame slides; results are those of plain Python, ties and bounds included."""
    rng, hour = random.Random(7), 3_600_000_000
    rows = [(k, rng.choice(["c1", "c2"]), rng.choice("AB"), rng.choice(["A", "B", "C", None]), float(rng.randrange(1, 900)) / 4, rng.choice([None, *(h * hour for h in range(-30, 130, 3))])) for k in range(400)]
    df = P.velocity(spark.createDataFrame(rows, "id long, case_id string, src string, dst string, amount double, us long"), 24, 5)
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "RangeFrame" in plan and "RangeFrame, -" not in plan
    of = {}
    for _, case, src, dst, amount, us in rows:
        for account in (src, dst):
            if account is not None and us is not None:
                of.setdefault((case, account), []).append((us, Decimal(str(amount)).quantize(Decimal("0.01"), ROUND_HALF_UP)))
    want = {}
    for key, legs in of.items():
        windows = [[x for x in legs if us - 24 * hour <= x[0] <= us] for us, _ in legs]
        n, at, w = max(((len(w), -us, w) for (us, _), w in zip(legs, windows, strict=True)), key=lambda x: x[:2])
        if n >= 5:
            want[key] = (n, float(sum(x[1] for x in w)), min(x[0] for x in w), -at)
    assert want and {(r["case_id"], r["account"]): (r["n"], r["volume"], r["start_us"], r["end_us"]) for r in df.collect()} == want
