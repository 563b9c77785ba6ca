"""Streams: batches that are redone count once; exact velocity equals the batch detector."""

from __future__ import annotations

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from casegraph.operators import patterns as P
from casegraph.streaming import jobs

HOUR = 3_600_000_000
FIRST = 400_000 * HOUR


def ingest(spark, tmp_path, **how):
    return jobs.run_ingest(jobs.ingest_stream(spark, str(tmp_path / "in"), ["vpa", "txn_count"], "upi_ids", **how), str(tmp_path / "out"), str(tmp_path / "ck"))


def counts(spark, tmp_path):
    got = spark.read.parquet(str(tmp_path / "out"))
    return got.where("ok = 'true'").count(), got.where("ok = 'false'").count()


def lose_commit(tmp_path, number):
    """As if the driver was lost after the sink had written a batch and before its commit."""
    for f in glob.glob(f"{tmp_path}/ck/commits/*{number}*") + glob.glob(f"{tmp_path}/ck/commits/.{number}*"):
        os.remove(f)


def test_redone_batches_count_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"f{k}.csv").write_text(f"vpa,txn_count\na{k}@ybl,1\nb{k}@ybl,no\nc{k}@ybl,2\n")
        ingest(spark, tmp_path).awaitTermination()
    assert counts(spark, tmp_path) == (6, 3)
    lose_commit(tmp_path, 2)
    ingest(spark, tmp_path).awaitTermination()
    assert counts(spark, tmp_path) == (6, 3)
    (tmp_path / "in" / "again.csv").write_text((tmp_path / "in" / "f0.csv").read_text())  # a second upload counts again
    ingest(spark, tmp_path).awaitTermination()
    assert counts(spark, tmp_path) == (8, 4)


def test_a_failure_after_the_write_is_redone_once(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"f{k}.csv").write_text("vpa,txn_count\na@ybl,1\n")
    made = jobs.batch_sink

    def failing(*args):
        put = made(*args)

        def then_fail(batch, number):
            put(batch, number)
            if number == 1:
                raise RuntimeError("lost")

        return then_fail

    monkeypatch.setattr(jobs, "batch_sink", failing)
    with pytest.raises(Exception, match="lost"):
        ingest(spark, tmp_path, files=1).awaitTermination()
    assert counts(spark, tmp_path) == (2, 0)
    monkeypatch.setattr(jobs, "batch_sink", made)
    ingest(spark, tmp_path, files=1).awaitTermination()
    assert counts(spark, tmp_path) == (2, 0)


def test_two_streams_share_a_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.csv").write_text("vpa,txn_count\na@ybl,1\n")
    for ck in ("ck1", "ck2"):
        jobs.run_ingest(jobs.ingest_stream(spark, str(tmp_path / "in"), ["vpa", "txn_count"], "upi_ids"), str(tmp_path / "out"), str(tmp_path / ck)).awaitTermination()
    assert counts(spark, tmp_path) == (2, 0)


SCHEMA = "id long, case_id string, src string, dst string, amount double, us long, description string"


def streamed(spark, tmp_path, batches, late="2 hours"):
    for rows in batches:  # one batch each
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        jobs.run_velocity(source, str(tmp_path / "out"), str(tmp_path / "ck"), late=late).awaitTermination()
    return sorted(tuple(r) for r in jobs.velocity_so_far(spark, str(tmp_path / "out")).collect())


def made(n, seed):
    rng = random.Random(seed)
    return [(k, "c1", f"A{rng.randint(0, 5)}", rng.choice(["A1", "A2", "B9", None]), rng.choice([10.0, 0.05, None]), FIRST + rng.choice([k * HOUR // 2, k * HOUR // 2, (k // 8) * 4 * HOUR]), "") for k in range(n)]


def test_streamed_velocity_equals_batch(spark, tmp_path):
    """Ties, legs to oneself, null ends and amounts, quiet times over a day, and legs up to the bound late."""
    rows = [r for r in made(160, 1)] + [(900 + k, "c1", "Q", "Q", 1.0, FIRST + (1000 + k) * HOUR, "") for k in range(6)]
    rows.sort(key=lambda r: r[5])
    batches = [rows[:50], rows[53:100], rows[50:53] + rows[100:140], rows[140:]]  # three legs come a batch later
    want = sorted(tuple(r) for r in P.velocity(spark.createDataFrame(rows, SCHEMA)).collect())
    assert streamed(spark, tmp_path, batches, late="48 hours") == want and len(want) >= 5
    lose_commit(tmp_path, 3)
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    jobs.run_velocity(source, str(tmp_path / "out"), str(tmp_path / "ck"), late="48 hours").awaitTermination()
    assert sorted(tuple(r) for r in jobs.velocity_so_far(spark, str(tmp_path / "out")).collect()) == want


def test_legs_beyond_the_watermark_are_dropped(spark, tmp_path):
    first = [(k, "c1", "X", None, 1.0, FIRST + k * HOUR, "") for k in range(4)]
    later = [(10, "c1", "Y", None, 1.0, FIRST + 100 * HOUR, "")]
    none = [(11, "c1", "Z", None, 1.0, FIRST + 101 * HOUR, "")]
    too_late = [(20, "c1", "X", None, 1.0, FIRST + 4 * HOUR, ""), (21, "c1", "Z", None, 1.0, FIRST + 101 * HOUR, "")]
    assert streamed(spark, tmp_path, [first, later, none, too_late]) == []
    assert P.velocity(spark.createDataFrame(first + too_late, SCHEMA)).where(F.col("account") == "X").count() == 1
