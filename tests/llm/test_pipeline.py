"""The pipeline against its operators' brute-force versions, stage by stage."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_llm import brute_hits, brute_near, sentence


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    good = [sentence(rng, rng.randint(30, 90)) for _ in range(160)]
    item = sentence(rng, 20)
    rows = [(i, t) for i, t in enumerate(good)]
    rows += [(500 + i, t + " tail") for i, t in enumerate(good[:6])]  # near copies
    rows += [(1000 + i, " ".join([t.split()[0]] * 60)) for i, t in enumerate(good[:140])]  # junk
    rows += [(2000, item + " " + sentence(rng, 10)), (2001, sentence(rng, 30) + "\n" + good[0])]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(not 1000 <= i < 2000)) for i, _ in rows], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d, now, kept = str(tmp_path), docs, []
    for _, stage in cp.STAGES:
        before = now
        now = cp.materialise(stage(spark, now, d))
        kept.append(now)
        assert now.columns[:5] == docs.columns and now.select("doc_id").exceptAll(before.select("doc_id")).where(F.lit(stage is not cp.mixing_stage)).count() == 0
    ids = [{r["doc_id"] for r in k.collect()} for k in kept]
    assert sum(1000 <= i < 2000 for i in ids[0]) <= 14 and sum(i < 1000 for i in ids[0]) >= 160
    assert kept[1].where("doc_id = 2001").first()["text"].count("\n") == 0
    text = {r["doc_id"]: r["text"] for r in kept[1].collect()}
    near = brute_near(list(text.items()), 5, 80, 100)
    assert ids[2] == {i for i in text if near[i][1] == i}
    hits = brute_hits([(i, text[i]) for i in ids[2]], [(1, item)])
    assert ids[3] == {i for i in ids[2] if not hits[i][3]} and 2000 not in ids[3]
    assert ids[4] <= ids[3] and kept[4].where("copy > 2").count() == 0
    assert cp.run(spark, d).count() == kept[4].count()


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and empty texts, a repeated row, a row without doc_id, columns that clash with the operators' own, empty tables."""
    rng = random.Random(7)
    good = [sentence(rng, 40) for _ in range(40)]
    line = sentence(rng, 6)
    rows = [(i, t) for i, t in enumerate(good)] + [(50, None), (51, ""), (52, good[3]), (52, good[3]), (None, good[4] + "\n" + line), (53, line), (54, line), (55, " \n "), (56, "x" * 300_000)]
    docs = spark.createDataFrame([(i, t, None if i == 50 else "en", None if i in (None, 51) else f"s{(i or 0) % 2}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("score", "found", "n_lines", "key", "size", "items", "part", "_text"):
        docs = docs.withColumn(c, F.lit("mine"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(good[7].split()[:15]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, d = docs, str(tmp_path)
    kept = []
    for name, stage in cp.STAGES:
        now = cp.materialise(stage(spark, now, d))
        assert now.columns == docs.columns + (["copy"] if name == "mixing" else []) and now.where("score <> 'mine'").count() == 0
        kept.append(sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in now.select("doc_id", "text").collect() if r["text"] is not None))
    assert (51, "") in kept[0] and kept[0].count((52, good[3])) == 2
    assert (54, "") not in kept[1] and (53, line) not in kept[1] and (-1, good[4] + "\n" + line) in kept[1]  # a null doc_id is the first
    assert [k for k, _ in kept[2]].count(52) == 0 and 7 not in [k for k, _ in kept[3]] and 8 in [k for k, _ in kept[3]]
    empty = docs.limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, empty, d).count() == 0


def test_a_repeated_row_stays_once(spark):
    docs = spark.createDataFrame([(1, "b b b b b b"), (1, "a a a a a a"), (2, "c c c c c c"), (None, "x"), (None, "x")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["text"]) for r in cp.near_stage(spark, docs, "").collect())
    assert got == [("1", "a a a a a a"), ("2", "c c c c c c"), ("None", "x"), ("None", "x")]
