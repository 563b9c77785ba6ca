"""The index of character runs, and profiles from sketches, against plain Python."""

from __future__ import annotations

import random
import statistics

import pytest

from casegraph.operators import features as X
from casegraph.operators import textindex as I


def test_index_finds_what_contains_finds(spark, tmp_path):
    rng = random.Random(1)
    texts = [(k, "".join(rng.choice("abcé日 ") for _ in range(rng.randint(0, 40)))) for k in range(200)] + [(500, None), (501, ""), (502, "ab"), (503, "x" * 50_000 + "END"), (504, "a\nb")]
    terms = ["a", "ab", "ABC", "é日", "日 a", "cab", "zzz", "end", "a\nb", "", None, "abcabcabcabc", " ", "b"] + ["".join(rng.choice("abcé日") for _ in range(4)) for _ in range(20)]
    rows = spark.createDataFrame(texts, "id long, t string").repartition(3)
    I.build(rows, str(tmp_path), "id", "t")
    got = sorted((r["term"], r["id"]) for r in I.search(spark, str(tmp_path), rows, spark.createDataFrame([(t,) for t in terms], "term string"), "id", "t").collect())
    assert got == sorted({(t, i) for t in terms if t for i, x in texts if x and t.lower() in x.lower()})
    assert I.search(spark, str(tmp_path), rows, spark.createDataFrame([("zzz",)], "term string"), "id", "t").count() == 0


def test_postings_lie_in_blocks(spark, tmp_path):
    """A row of the index holds the keys of a run, not one key: as many rows as there are runs in a block, and their counts."""
    I.build(spark.createDataFrame([(k, "abé") for k in range(1000)], "id long, t string").coalesce(1), str(tmp_path), "id", "t")
    held = spark.read.parquet(str(tmp_path / "postings")).collect()
    assert len(held) == 6 and all(sorted(r["keys"]) == list(range(1000)) for r in held)
    assert {r["n"] for r in spark.read.parquet(str(tmp_path / "counts")).collect()} == {1000}


def test_runs_of_more_letters_than_a_number_holds():
    import numpy as np

    points = np.concatenate([np.arange(1, 1 << 18), np.arange(1 << 17, 1 << 18)]) + 0x10000
    row = np.arange(len(points)) // 7
    runs, at, who = I._postings_of(points.astype("<u4"), row, int(row[-1]) + 1)
    k = int(np.flatnonzero(runs == (int(points[0]) + 1 << 42 | int(points[1]) + 1 << 21 | int(points[2]) + 1))[0])
    assert len(set(runs.tolist())) == len(runs) and who[at[k] : at[k + 1]].tolist() == [0] and at[-1] == len(who)


def test_index_of_no_rows(spark, tmp_path):
    rows = spark.createDataFrame([], "id long, t string")
    I.build(rows, str(tmp_path / "i"), "id", "t")
    assert I.search(spark, str(tmp_path / "i"), rows, spark.createDataFrame([("a",)], "term string"), "id", "t").count() == 0


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_sketches_merge(spark, n):
    rng = random.Random(n)
    values = [None if rng.random() < 0.1 else round(rng.gauss(50, 20), 1) for _ in range(n)]
    df = spark.createDataFrame([(k % 7, v) for k, v in enumerate(values)], "part int, v double")
    got = X.profile_of(X.merge_sketches(X.sketches(df, ["v"], "part"))).collect()
    held = sorted(v for v in values if v is not None)
    if not n:
        assert got == []
        return
    r = got[0]
    assert (r["rows"], r["missing"], r["min"], r["max"]) == (n, n - len(held), held[0] if held else None, held[-1] if held else None)
    if len(held) > 1:
        assert r["mean"] == pytest.approx(statistics.mean(held)) and r["std"] == pytest.approx(statistics.stdev(held))
        assert abs(r["distinct"] - len(set(held))) <= 0.03 * len(set(held)) + 1
        for q, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
            assert sum(v < r[q] for v in held) / len(held) - 0.015 <= p <= sum(v <= r[q] for v in held) / len(held) + 0.015
