"""The given tables as the canonical ones: transfers, calls, vertices, edges, cases, narratives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.functions.expr import micros

LINES = 1 << 17  # of lineitem to a task
ROWS = 8192  # of a task, where a small row becomes a long text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str, rows: int = ROWS) -> DataFrame:
    """df dealt by key to tasks of about `rows` rows: a file of small rows is read by few tasks, whatever is made of the rows after."""
    return df.repartition(max(1, -(-df.count() // rows)), key)


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, case_id, src, dst, amount, us (microseconds), description: one per event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.lit("c1").alias("case_id"), F.concat(F.lit("A"), F.col("user_id").cast("string")).alias("src"),
        F.concat(F.lit("A"), F.get_json_object("props", "$.k")).alias("dst"), F.col("value").alias("amount"), micros(F.col("ts")).alias("us"), F.col("event_type").alias("description"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transfers(spark, sf_dir).where(F.col("description").isin("click", "view"))
    return t.select("id", "case_id", F.col("src").alias("caller"), F.col("dst").alias("receiver"), F.col("amount").alias("duration"), "us")


def _id(prefix: str, key: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, label, risk."""
    t = lambda n: table(spark, sf_dir, n)
    parts = [
        t("customer").select(_id("C", "c_custkey").alias("id"), F.lit("PERSON").alias("type"), F.col("c_name").alias("label"), (F.pmod("c_custkey", F.lit(100)) / 100).alias("risk")),
        t("supplier").select(_id("S", "s_suppkey").alias("id"), F.lit("BANK_ACCOUNT").alias("type"), F.col("s_name").alias("label"), (F.pmod("s_suppkey", F.lit(10)) / 10).alias("risk")),
        t("part").select(_id("P", "p_partkey").alias("id"), F.lit("DEVICE").alias("type"), F.col("p_name").alias("label"), F.lit(None).cast("double").alias("risk")),
        t("nation").select(_id("N", "n_nationkey").alias("id"), F.lit("SIM").alias("type"), F.col("n_name").alias("label"), F.lit(0.5).alias("risk")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _linked(df: DataFrame, src: F.Column, dst: F.Column, rel: str, confidence: float, evidence: str) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"), F.lit(confidence).alias("confidence"), F.lit(evidence).alias("evidence_source"))


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of every customer and supplier to its nation."""
    uses = _linked(table(spark, sf_dir, "customer"), _id("C", "c_custkey"), _id("N", "c_nationkey"), "USES", 0.9, "observed")
    return uses.unionByName(_linked(table(spark, sf_dir, "supplier"), _id("S", "s_suppkey"), _id("N", "s_nationkey"), "LINKED_TO", 0.8, "observed"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, rel, confidence, evidence_source: distinct pairs.

    Lines are dealt by their number: pairs are few bytes when shuffled and many in a task that tells them apart.
    """
    t = lambda n: table(spark, sf_dir, n)
    li = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    tasks = max(1, -(-li.count() // LINES))
    pairs = lambda df, a, b: df.select(a, b).repartition(tasks, a, b).distinct()
    parts = _linked(pairs(li, "l_partkey", "l_suppkey"), _id("P", "l_partkey"), _id("S", "l_suppkey"), "LINKED_TO", 0.7, "inferred")
    orders = t("orders").select("o_orderkey", "o_custkey").repartition(tasks, "o_orderkey")
    paid = orders.join(li.repartition(tasks, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    paid = _linked(pairs(paid, "o_custkey", "l_suppkey"), _id("C", "o_custkey"), _id("S", "l_suppkey"), "TRANSFERRED_TO", 0.6, "inferred")
    return memberships(spark, sf_dir).unionByName(parts).unionByName(paid)


SQL = {
    "transfers": "SELECT event_id AS id, 'c1' AS case_id, 'A' || user_id AS src, 'A' || (props->>'k') AS dst, value AS amount, epoch_us(ts) AS us, event_type AS description FROM events",
    "calls": "SELECT event_id AS id, 'c1' AS case_id, 'A' || user_id AS caller, 'A' || (props->>'k') AS receiver, value AS duration, epoch_us(ts) AS us FROM events WHERE event_type IN ('click', 'view')",
    "vertices": """SELECT 'C' || c_custkey AS id, 'PERSON' AS type, c_name AS label, (c_custkey % 100) / 100.0::DOUBLE AS risk FROM customer
      UNION ALL SELECT 'S' || s_suppkey, 'BANK_ACCOUNT', s_name, (s_suppkey % 10) / 10.0::DOUBLE FROM supplier
      UNION ALL SELECT 'P' || p_partkey, 'DEVICE', p_name, NULL FROM part UNION ALL SELECT 'N' || n_nationkey, 'SIM', n_name, 0.5 FROM nation""",
    "memberships": """SELECT 'C' || c_custkey AS src, 'N' || c_nationkey AS dst, 'USES' AS rel, 0.9::DOUBLE AS confidence, 'observed' AS evidence_source FROM customer
      UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'LINKED_TO', 0.8, 'observed' FROM supplier""",
    "edges": """SELECT 'C' || c_custkey AS src, 'N' || c_nationkey AS dst, 'USES' AS rel, 0.9::DOUBLE AS confidence, 'observed' AS evidence_source FROM customer
      UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'LINKED_TO', 0.8, 'observed' FROM supplier
      UNION ALL SELECT DISTINCT 'P' || l_partkey, 'S' || l_suppkey, 'LINKED_TO', 0.7, 'inferred' FROM lineitem
      UNION ALL SELECT DISTINCT 'C' || o_custkey, 'S' || l_suppkey, 'TRANSFERRED_TO', 0.6, 'inferred' FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
}


def with_views(sql: str, *names: str) -> str:
    """sql after the named views as common tables."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + sql
