"""Queries whose rows come through a stream that is replayed, late in part, and interrupted."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegraph.functions.expr import HOUR_US
from casegraph.functions.scratch import remove, scratch_path
from casegraph.plans.driver_views import table, transfers
from casegraph.plans.transfer_queries import ORACLES as TRANSFER_ORACLES
from casegraph.streaming import jobs

PARTS = 5


def _in_parts(rows, path: str) -> None:
    """rows (part: 0 to PARTS - 1) as files that arrive part after part."""
    for k in range(PARTS):
        rows.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(path)


def velocity_streamed(spark, d):
    """PT-6 over the events as they arrive: five parts by time, of which every seventh event of the last hour comes with the next."""
    path = scratch_path(spark)
    t = transfers(spark, d)
    first, last = t.agg(F.min("us"), F.max("us")).first()
    width = (last - first) // PARTS + 1
    late = ((F.col("us") + HOUR_US - first) / width).cast("int")
    part = F.least(F.when(F.col("id") % 7 == 0, late).otherwise(((F.col("us") - first) / width).cast("int")), F.lit(PARTS - 1))
    _in_parts(t.withColumn("part", part), f"{path}/in")
    source = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    jobs.run_velocity(source, f"{path}/out", f"{path}/check").awaitTermination()
    return jobs.velocity_so_far(spark, f"{path}/out")


def stream_redone(spark, d):
    """IO-20: orders that arrive in five files; the commit of the last batch is lost and the batch comes again."""
    path = scratch_path(spark)
    orders = table(spark, d, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit("@ybl")).alias("vpa"), F.when(F.col("o_custkey") % 5 == 0, F.lit("few")).otherwise(F.col("o_custkey").cast("string")).alias("txn_count"), (F.col("o_orderkey") % PARTS).alias("part"))
    for k in range(PARTS):
        orders.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").option("header", True).csv(f"{path}/in")
    run = lambda: jobs.run_ingest(jobs.ingest_stream(spark, f"{path}/in", ["vpa", "txn_count"], "upi_ids", files=1), f"{path}/out", f"{path}/check").awaitTermination()
    run()
    remove(spark, f"{path}/check/commits/{PARTS - 1}")
    run()
    return spark.read.parquet(f"{path}/out").select("vpa", "txn_count", "error", F.col("ok").cast("string").alias("ok"))


QUERIES = {"velocity_streamed": velocity_streamed, "stream_redone": stream_redone}
ORACLES = {
    "velocity_streamed": TRANSFER_ORACLES["velocity"],
    "stream_redone": "SELECT o_orderkey || '@ybl' AS vpa, CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE o_custkey END::INTEGER AS txn_count, CASE WHEN o_custkey % 5 = 0 THEN 'txn_count is no whole number: few' END AS error, CASE WHEN o_custkey % 5 = 0 THEN 'false' ELSE 'true' END AS ok FROM orders",
}
