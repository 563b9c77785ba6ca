"""Top-k search and whitening against brute force, and their defined results."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casegraph.llm import topk, whitening

NAN, INF = float("nan"), float("inf")


def table(spark, rows, kind="array<float>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, rank string, n string")


def some(seed, n, d=6, spread=1.0):
    rng = random.Random(seed)
    return [(k, [rng.gauss(0, spread) for _ in range(d)], "x", "y") for k in range(n)]


def clean(rows, kind=np.float32):
    return [(i, [float(kind(x)) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def brute_topk(rows, k, every=20, scale=64):
    """Sorted (query_id, rank, vec_id, score) of every query row over all other rows."""
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in clean(rows)]
    out = []
    for at, (i, v) in enumerate(whole):
        if i is None or i % every:
            continue
        found = [(-max(-topk.LONG, min(topk.LONG, sum(a * b for a, b in zip(v, w)))), j is None, j or 0) for other, (j, w) in enumerate(whole) if other != at]
        out += [(i, r + 1, None if none else j, -cost) for r, (cost, none, j) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def searched(df, **how):
    return sorted((tuple(r) for r in topk.search(df, **how).collect()), key=str)


ODD = [(20, None, "", ""), (40, [1.0, None], "", ""), (60, [NAN, 1.0], "", ""), (80, [INF, 0.5], "", ""), (100, [], "", ""), (None, [0.5, 0.5, 0.5], "", ""), (7, [0.25], "", "")]


@pytest.mark.parametrize("k, block, shard", [(3, 4096, 16384), (20, 7, 5), (5, 3, 1)])
def test_topk_equals_brute_force(spark, k, block, shard):
    rows = some(1, 130) + ODD + some(2, 60)[:21] + [(200 + j, [0.5] * 6, "", "") for j in range(25)]  # repeated ids, ties
    rows += [rows[0], rows[0], rows[5]]  # repeated rows
    df = table(spark, rows).repartition(3)
    assert searched(df, k=k, query_block=block, shard=shard) == brute_topk(rows, k)


def test_topk_of_large_components_is_exact(spark):
    """Products past the mantissas of floats and the range of a long; the latter counts as the end of that range."""
    rng = random.Random(4)
    rows = [(k, [rng.choice([1.0, 3.0e4, 2.0**23, 2.0**30]) * rng.choice([-1, 1]) * rng.random() for _ in range(4)], "", "") for k in range(60)]
    assert searched(table(spark, rows), k=4) == brute_topk(rows, 4)
    far = [(0, [1e30, 1.0], "", ""), (1, [1e30, 2.0], "", ""), (2, [-1e30, 0.0], "", ""), (3, [0.0, 1.0], "", "")]
    assert searched(table(spark, far), k=3) == [(0, 1, 1, topk.LONG), (0, 2, 3, 4096), (0, 3, 2, -topk.LONG)]


def test_topk_trees_and_empty_tables(spark):
    rows = some(3, 90)
    assert searched(table(spark, rows), k=4, shard=2) == brute_topk(rows, 4)  # 45 shards: two levels
    assert searched(table(spark, [])) == []
    assert searched(table(spark, [r for r in rows if r[0] % 20])) == []  # no query
    assert searched(table(spark, rows[:1])) == []  # no candidate
    double = spark.createDataFrame([(0, [1.5e308]), (20, [0.5]), (21, [2.0])], "vec_id long, embedding array<double>")
    assert searched(double) == [(20, 1, 21, 32 * 128)]  # 64 * x is not finite: no part


def covariance(rows, scale=1024, shift=100_000):
    got = clean(rows)
    width = max((len(v) for _, v in got), default=0)
    x = np.array([[math.floor(scale * c) + shift for c in v] + [shift] * (width - len(v)) for _, v in got], object).reshape(len(got), width)
    z = x * len(x) - x.sum(0)
    return got, z, np.asarray(z / len(x), float)


@pytest.mark.parametrize("parts, fan", [(1, 8), (5, 2), (7, 8)])
def test_whitening_equals_dense_eigenvectors(spark, monkeypatch, parts, fan):
    monkeypatch.setattr(whitening, "FAN", fan)
    rng = np.random.default_rng(1)
    mixed = rng.normal(size=(300, 10)) @ rng.normal(size=(10, 10)) + 3
    rows = [(k, v.tolist(), "x", "y") for k, v in enumerate(mixed)] + [(900, None, "", ""), (901, [NAN] * 10, "", ""), (902, [None] * 10, "", ""), (903, [0.1, 0.2], "", ""), (None, [0.0] * 10, "", "")]
    got, z, x = covariance(rows)
    values, vectors = np.linalg.eigh(x.T @ x / len(x))
    values, vectors = values[::-1], vectors[:, ::-1]
    out = whitening.whiten(table(spark, rows).repartition(parts)).collect()
    assert sorted(out[0].asDict()) == ["deviation", "explained", "identity_error", "n", "rank", "vec_id", "whitened"]
    assert {r["rank"] for r in out} == {"x", ""} and len(out) == len(got)
    sign = None
    for r in out:
        at = next(k for k, (i, _) in enumerate(got) if i == r["vec_id"])
        assert r["n"] == len(got) and int(r["deviation"]) == sum(int(e) ** 2 for e in z[at])
        want = (x[at] @ vectors / np.sqrt(values))[:8]
        sign = np.sign(np.array(r["whitened"]) * want) if sign is None else sign
        assert np.allclose(r["whitened"], want * sign, rtol=1e-8, atol=1e-8)
        assert np.allclose(r["explained"], (values / values.sum())[:8], rtol=1e-10)
        assert 0 <= r["identity_error"] < 1e-9


def test_rank_one_updates_with_deflation():
    """Repeated eigenvalues, zero weights, equal vectors and scales far apart: the decomposition stays exact and orthogonal."""
    rng = np.random.default_rng(2)
    cases = [np.repeat(np.eye(5), 20, 0), np.ones((30, 4)), np.zeros((9, 3)), np.outer(np.arange(40), np.arange(6)), rng.normal(size=(50, 1)), np.c_[rng.normal(size=(60, 3)) * 1e6, rng.normal(size=(60, 3)) * 1e-3], rng.integers(0, 2, (200, 8))]
    for x in cases:
        x = np.asarray(x, float)
        one, two = whitening.Spectrum(x.shape[1]), whitening.Spectrum(x.shape[1])
        for k, v in enumerate(x):
            (one if k % 3 else two).add(v)
        one.combine(two)
        scatter = (x - x.mean(0)).T @ (x - x.mean(0))
        size = max(1e-30, np.abs(scatter).max())
        assert np.abs(one.basis * one.values @ one.basis.T - scatter).max() / size < 1e-12
        assert np.abs(one.basis.T @ one.basis - np.eye(x.shape[1])).max() < 1e-12
        assert one.n == len(x) and np.allclose(one.mean, x.mean(0))


def test_secular_roots_interlace():
    rng = np.random.default_rng(5)
    for m in (1, 2, 3, 17, 64):
        d, z = np.sort(rng.random(m)) * 100, rng.normal(size=m)
        roots, _ = whitening.secular(d, z)
        assert (roots > d).all() and (roots[:-1] < d[1:]).all()
        assert np.allclose(roots, np.linalg.eigvalsh(np.diag(d) + np.outer(z, z)), rtol=1e-12, atol=1e-11)


def test_whitening_defined_results(spark):
    none = whitening.whiten(table(spark, []))
    assert none.count() == 0 and none.columns == ["vec_id", "rank", "n", "deviation", "whitened", "explained", "identity_error"]
    alone = whitening.whiten(table(spark, [(1, [0.5, 1.0], "", ""), (2, None, "", "")])).collect()
    assert [(r["vec_id"], r["n"], int(r["deviation"]), r["whitened"]) for r in alone] == [(1, 1, 0, [])]
    same = whitening.whiten(table(spark, [(k, [0.5, 1.0], "", "") for k in range(5)])).collect()
    assert len(same) == 5 and all(r["whitened"] == [] for r in same)
    line = whitening.whiten(table(spark, [(k, [float(k), 2.0 * k, 0.0], "", "") for k in range(9)] * 2)).collect()
    assert len(line) == 18 and all(len(r["whitened"]) == 1 and abs(r["explained"][0] - 1) < 1e-12 for r in line)
    huge = whitening.whiten(table(spark, [(1, [1e17, 0.0], "", ""), (2, [-1e17, 3.0], "", ""), (3, [0.0, 0.0], "", "")])).collect()
    _, z, _ = covariance([(1, [1e17, 0.0]), (2, [-1e17, 3.0]), (3, [0.0, 0.0])])
    want = [sum(int(e) ** 2 for e in v) for v in z]
    assert [r["deviation"] for r in sorted(huge)] == [None if w >= 10**38 else w for w in want]
    empty = whitening.whiten(table(spark, [(1, [], "", "")]))
    assert empty.count() in (0, 1)


def test_registered_whitening(spark, tmp_path):
    spark.createDataFrame([(k, v) for k, v, *_ in some(8, 200, 12)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = whitening.op12_whitening(spark, str(tmp_path))
    assert out.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    assert out.groupBy("component").agg(F.count("*").alias("n")).where("n = 200").count() == 8
