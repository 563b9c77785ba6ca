"""Components stored with their graphs: read back whole, by pruning, in parts of about the same size."""

from __future__ import annotations

import glob

import pyarrow.parquet as pq

from casegraph.operators import subgraphs as B
from casegraph.operators import traverse as T

V, E = "id string, type string, part int", "src string, dst string, rel string"


def graph(spark):
    """A hub of 300, fifty pairs (two of whose edges are loops or repeats) and twenty vertices alone."""
    v = [("h", "PERSON", 7)] + [(f"l{k:03}", "PHONE", None) for k in range(300)] + [(f"{x}{k:02}", "SIM", k) for k in range(50) for x in "pq"] + [(f"z{k:02}", "SIM", 1) for k in range(20)]
    e = [("h", f"l{k:03}", "OWNS") for k in range(300)] + [(f"q{k:02}", f"p{k:02}", "CALLED") for k in range(50)] + [("p00", "p00", "CALLED"), ("q01", "p01", "OWNS"), ("p02", "gone", "OWNS"), ("gone", "p02", "OWNS")]
    return spark.createDataFrame(v, V), spark.createDataFrame(e, E)


def stored(spark, tmp_path, rows):
    v, e = graph(spark)
    path = str(tmp_path / "g")
    of = T.components(v, e.where("src <> 'gone' AND dst <> 'gone'"))
    B.store(v, e, of, path, rows)
    return path


def test_a_component_is_read_by_its_parts(spark, tmp_path):
    path = stored(spark, tmp_path, 40)
    at = {r["component"]: r for r in B.index(spark, path).collect()}
    assert len(at) == 71 and (at["h"]["n_vertices"], at["h"]["n_edges"], at["h"]["parts"]) == (301, 300, 16) and all(r["parts"] == 1 for c, r in at.items() if c != "h")
    v, e = B.component_graph(spark, path, "h")
    assert (v.count(), e.count(), v.columns, e.columns) == (301, 300, ["component", "id", "type"], ["component", "src", "dst", "rel"])
    v, e = B.component_graph(spark, path, "p01")
    assert sorted(r["id"] for r in v.collect()) == ["p01", "q01"] and sorted(r["rel"] for r in e.collect()) == ["CALLED", "OWNS"]
    assert "PartitionFilters: [isnotnull(part" in e._jdf.queryExecution().toString()
    v, e = B.component_graph(spark, path, "none")
    assert (v.count(), e.count()) == (0, 0)


def test_parts_are_of_about_the_same_size(spark, tmp_path):
    path = stored(spark, tmp_path, 40)
    sizes = {}
    for f in glob.glob(f"{path}/*/part=*/*.parquet"):
        part = f.split("part=")[1].split("/")[0]
        sizes[part] = sizes.get(part, 0) + pq.read_metadata(f).num_rows
    assert sum(sizes.values()) == 421 + 352 and max(sizes.values()) < 3 * 40  # the edges of "gone" have no component


def test_many_components(spark, tmp_path):
    path = stored(spark, tmp_path, 40)
    v, e = B.component_graphs(spark, path, spark.createDataFrame([("h",), ("p00",), ("p00",), ("z05",), ("none",), (None,)], "component string"))
    assert (v.count(), e.count()) == (301 + 2 + 1, 300 + 2) and {r["component"] for r in v.select("component").distinct().collect()} == {"h", "p00", "z05"}
    v, e = B.component_graphs(spark, path, B.index(spark, path))
    assert (v.count(), e.count()) == (421, 352)


def test_no_rows(spark, tmp_path):
    v, e = spark.createDataFrame([], V), spark.createDataFrame([], E)
    for name, vertices in (("none", v), ("alone", spark.createDataFrame([("a", "SIM", 1)], V))):
        path = str(tmp_path / name)
        B.store(vertices, e, T.components(vertices, e), path)
        got = B.component_graphs(spark, path, B.index(spark, path))
        assert (got[0].count(), got[1].count()) == (vertices.count(), 0)
        assert B.component_graph(spark, path, "a")[1].count() == 0
