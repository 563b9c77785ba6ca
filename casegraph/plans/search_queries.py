"""Queries of tables of search terms, and of profiles from sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegraph.functions.scratch import scratch_path
from casegraph.operators import features as X
from casegraph.operators import textindex as I
from casegraph.plans.driver_views import table


def search_terms(spark, d):
    """Documents that contain a nation's name, a market segment, a benchmark item's first or last 12 characters, or one of some short terms."""
    path, docs = scratch_path(spark), table(spark, d, "documents")
    of = lambda t, c: table(spark, d, t).select(c.alias("term"))
    terms = of("nation", F.col("n_name")).unionByName(of("customer", F.col("c_mktsegment")))
    terms = terms.unionByName(of("benchmark", F.substring("text", 1, 12))).unionByName(of("benchmark", F.expr("right(text, 12)")))
    terms = terms.unionByName(of("region", F.lower(F.substring("r_name", 1, 2)))).unionByName(of("region", F.substring("r_name", 3, 1)))
    I.build(docs, path, "doc_id", "text")
    return I.search(spark, path, docs, terms, "doc_id", "text")


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def profile_sketched(spark, d):
    """The profile of lineitem's numbers from sketches by line number that are merged: exact columns as they are, sketched ones by
    whether they keep to their errors."""
    li = table(spark, d, "lineitem")
    p = X.profile_of(X.merge_sketches(X.sketches(li, NUMBERS, "l_linenumber")))
    x = F.col("x")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in NUMBERS])
    ranks = li.select(F.inline(pairs)).join(F.broadcast(p), "column").groupBy("column").agg(F.countDistinct("x").alias("true"), *[F.avg((x < F.col(q)).cast("double")).alias(f"lo_{q}") for q in ("q25", "median", "q75")], *[F.avg((x <= F.col(q)).cast("double")).alias(f"hi_{q}") for q in ("q25", "median", "q75")])
    near = lambda q, at: (F.col(f"lo_{q}") - 0.015 <= at) & (F.col(f"hi_{q}") + 0.015 >= at)
    out = p.join(ranks, "column").withColumns({"quartiles_hold": near("q25", 0.25) & near("median", 0.5) & near("q75", 0.75), "distinct_holds": F.abs(F.col("distinct") - F.col("true")) <= 0.03 * F.col("true") + 1})
    return out.select("column", "rows", "missing", "zeros", "negatives", F.round("min", 4).alias("min"), F.round("max", 4).alias("max"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "quartiles_hold", "distinct_holds")


_TERMS = """SELECT n_name AS term FROM nation UNION SELECT c_mktsegment FROM customer UNION SELECT substr(text, 1, 12) FROM benchmark UNION SELECT right(text, 12) FROM benchmark
  UNION SELECT lower(substr(r_name, 1, 2)) FROM region UNION SELECT substr(r_name, 3, 1) FROM region"""
QUERIES = {"search_terms": search_terms, "profile_sketched": profile_sketched}
ORACLES = {
    "search_terms": f"SELECT DISTINCT term, doc_id FROM ({_TERMS}) JOIN documents ON contains(lower(text), lower(term)) WHERE term <> ''",
    "profile_sketched": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS missing, count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives, round(min({c})::DOUBLE, 4) AS "min", round(max({c})::DOUBLE, 4) AS "max",
  round(avg({c}::DOUBLE), 4) AS mean, round(stddev_samp({c}::DOUBLE), 4) AS std, true AS quartiles_hold, true AS distinct_holds FROM lineitem""" for c in NUMBERS
    ),
}
