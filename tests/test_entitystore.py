"""The entity store: batches give what one merge gives, only touched parts are written, old rows are not shuffled."""

from __future__ import annotations

import glob
import os
import random

from pyspark.sql import functions as F

from casegraph.operators import entitystore as U
from casegraph.operators import resolve as R

SCHEMA = "seq long, type string, value string, raw_value string, confidence double, evidence_source string, evidence_id string, case_id string, source_text string"


def made(n, seed, names=40):
    rng = random.Random(seed)
    return [
        (k, rng.choice(["PERSON", "PHONE"]), rng.choice(["Al ", "al", "AL"]).strip() + str(rng.randrange(names)), f"raw{k}", rng.random(), rng.choice(["observed", "inferred"]), f"e{rng.randrange(9)}", rng.choice([None, "c1", "c2"]), rng.choice([None, "t1", "t2", "t3", "t4", f"t{k}"]))
        for k in range(n)
    ]


def plain(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def test_three_batches_equal_one(spark, tmp_path):
    rows = made(300, 1)
    order = rows[200:] + rows[:100] + rows[100:200]  # later mentions come first
    path, like = str(tmp_path / "s"), U.states(spark.createDataFrame(rows, SCHEMA))
    for k in range(3):
        U.upsert(spark, path, spark.createDataFrame(order[100 * k : 100 * k + 100], SCHEMA))
    assert plain(U.entities(spark, path, like)) == plain(R.merge_entities(spark.createDataFrame(rows, SCHEMA)))


def test_only_touched_parts_are_written(spark, tmp_path):
    path = str(tmp_path / "s")
    U.upsert(spark, path, spark.createDataFrame(made(300, 2, 200), SCHEMA))
    files = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{path}/part=*/*.parquet")}
    before = files()
    assert len({os.path.dirname(f) for f in before}) == U.PARTS
    touched = U.upsert(spark, path, spark.createDataFrame(made(1, 3), SCHEMA))
    assert len(touched) == 1 and {f for f in before if f not in files()} == {f for f in before if f"/part={touched[0]}/" in f}
    assert U.upsert(spark, path, spark.createDataFrame([], SCHEMA)) == []


def above_the_store(spark, plan, prefix):
    """The lines of a plan from the scan of a store up to the first join above it."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = [x for x in text.splitlines() if not x.startswith(",")]  # a separator of keys is a line break
    scan = next(k for k, line in enumerate(lines) if "FileScan parquet" in line and prefix in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    above, at = [], depth(lines[scan])
    for line in reversed(lines[:scan]):
        if depth(line) < at:
            above.append(line)
            at = depth(line)
    return above[: next(k for k, line in enumerate(above) if "Join" in line)]


def test_old_rows_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame(made(200, 4), SCHEMA)
    U.upsert(spark, path, rows)
    new = U.states(rows).withColumn("part", F.lit(0))
    plan = U.merged_with(spark, U.opened(spark, path, U.states(rows)), new, [0, 1])
    assert not any("Exchange" in line for line in above_the_store(spark, plan, "entities_"))


EDGE = "source_type string, source_value string, relationship string, target_type string, target_value string, confidence double, evidence_source string, evidence_id string, case_id string"


def links(n, seed):
    """Relationships whose ends are among made()'s names, in either case, or unknown."""
    rng = random.Random(seed)
    end = lambda: (rng.choice(["PERSON", "PHONE"]), rng.choice(["Al", "al", "AL", "Bo"]) + str(rng.randrange(12)))
    return [(*end(), rng.choice(["OWNS", "CALLED"]), *end(), rng.random(), rng.choice(["observed", "inferred"]), f"e{rng.randrange(9)}", rng.choice([None, "c1", "c2"])) for _ in range(n)]


def test_relationships_in_three_batches_equal_one(spark, tmp_path):
    of_entities, of_edges = str(tmp_path / "n"), str(tmp_path / "e")
    people = spark.createDataFrame(made(300, 5, 12), SCHEMA)
    U.upsert(spark, of_entities, people)
    rows, like = links(400, 6), U.states(people)
    for k in (300, 0, 150):
        some = spark.createDataFrame(rows[k : k + 150] if k < 300 else rows[300:], EDGE)
        U.upsert(spark, of_edges, U.resolve_endpoints(spark, of_entities, some, like), U.EDGES)
    want = R.merge_relationships(R.resolve_endpoints(spark.createDataFrame(rows, EDGE), R.merge_entities(people)))
    empty = U.edge_states(R.resolve_endpoints(spark.createDataFrame([], EDGE), R.merge_entities(people)))
    got = plain(U.relationships(spark, of_edges, empty))
    assert got == plain(want) and len(got) > 100
    assert U.upsert(spark, of_edges, U.resolve_endpoints(spark, of_entities, spark.createDataFrame([], EDGE), like), U.EDGES) == []


def test_relationships_of_the_store_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "e")
    rows = spark.createDataFrame([("a", "OWNS", "b", 0.5, "observed", "e1", "c1"), ("b", "OWNS", "a", 0.5, "observed", "e1", None)], "source_entity string, relationship string, target_entity string, confidence double, evidence_source string, evidence_id string, case_id string")
    U.upsert(spark, path, rows, U.EDGES)
    new = U.edge_states(rows).withColumn("part", F.lit(0))
    plan = U.merged_with(spark, U.opened(spark, path, U.edge_states(rows), U.EDGES), new, [0, 1], U.EDGES)
    assert not any("Exchange" in line for line in above_the_store(spark, plan, "relationships_"))


def test_ends_meet_the_store_where_it_lies(spark, tmp_path):
    path = str(tmp_path / "n")
    people = spark.createDataFrame(made(200, 7), SCHEMA)
    U.upsert(spark, path, people)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = U.resolve_endpoints(spark, path, spark.createDataFrame(links(9, 8), EDGE), U.states(people))
        assert not any("Exchange" in line for line in above_the_store(spark, plan, "entities_"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
