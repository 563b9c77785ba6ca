"""Queries over transfers and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegraph.operators import patterns as P
from casegraph.plans.driver_views import calls, transfers, with_views
from casegraph.plans.sqltext import clamp4, sig

HUB_RATIO = 1.02  # the given calls are spread evenly: at the default ratio nothing stands out
MULE_RATIO = 0.05


def velocity(spark, d):
    return P.velocity(transfers(spark, d))


def mule(spark, d):
    return P.mule(transfers(spark, d), MULE_RATIO)


def layering(spark, d):
    return P.layering(transfers(spark, d))


def rapid_hop(spark, d):
    return P.rapid_hop(transfers(spark, d))


def comm_hub(spark, d):
    return P.comm_hub(calls(spark, d), ratio=HUB_RATIO)


def time_range(spark, d):
    return P.time_range(P.legs(transfers(spark, d)), "case_id", "account")


LEGS = """legs AS (SELECT id, case_id, src AS account, true AS sent, us, coalesce(amount, 0)::DECIMAL(18,2) AS amount FROM transfers WHERE src IS NOT NULL
  UNION ALL SELECT id, case_id, dst, false, us, coalesce(amount, 0)::DECIMAL(18,2) FROM transfers WHERE dst IS NOT NULL)"""
FLOWS = """flows AS (SELECT case_id, account, coalesce(sum(amount) FILTER (NOT sent), 0)::DOUBLE AS received, count(*) FILTER (NOT sent) AS n_in,
  coalesce(sum(amount) FILTER (sent), 0)::DOUBLE AS forwarded, count(*) FILTER (sent) AS n_out FROM legs GROUP BY case_id, account)"""


def _chains(hours: float, tail: str) -> str:
    span = int(hours * 3_600_000_000)
    return with_views(
        f""", t AS (SELECT case_id, src, dst, id, us, coalesce(amount, 0)::DECIMAL(18,2) AS amount FROM transfers WHERE src <> dst),
c3 AS (SELECT t1.case_id, t1.src AS a, t1.dst AS b, t2.dst AS c, t3.dst AS d, t1.id AS i1, t2.id AS i2, t3.id AS i3, coalesce(t1.us, t2.us) AS first_us, t3.us AS last_us,
    (t1.amount + t2.amount + t3.amount)::DOUBLE AS volume
  FROM t t1 JOIN t t2 ON t2.case_id = t1.case_id AND t1.dst = t2.src AND t2.dst <> t1.src AND coalesce(abs(t2.us - t1.us) <= {span}, true)
  JOIN t t3 ON t3.case_id = t1.case_id AND t2.dst = t3.src AND t3.dst <> t1.src AND t3.dst <> t1.dst AND coalesce(abs(t3.us - coalesce(t1.us, t2.us)) <= {span}, true)),
p AS (SELECT * FROM c3 QUALIFY row_number() OVER (PARTITION BY case_id, a, b, c, d ORDER BY i1, i2, i3) = 1)
""" + tail,
        "transfers",
    ).replace(") , t AS", "), t AS")


VELOCITY = with_views(
    f", {LEGS}, " + f"""w AS (SELECT case_id, account, us, count(*) OVER x AS n, sum(amount) OVER x AS volume, min(us) OVER x AS start_us FROM legs
  WINDOW x AS (PARTITION BY case_id, account ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)),
b AS (SELECT DISTINCT case_id, account, n, volume::DOUBLE AS volume, start_us, us AS end_us FROM w QUALIFY row_number() OVER (PARTITION BY case_id, account ORDER BY n DESC, us) = 1)
SELECT *, {clamp4(f"least(0.6 * {sig('n', 8, 0.4)} + 0.4 * {sig('volume', 200000, 3e-6)}, 1.0)")} AS score, CASE WHEN n >= 10 THEN 0.7::DOUBLE ELSE 0.55 END AS confidence FROM b WHERE n >= 5""",
    "transfers",
)
MULE = with_views(
    f", {LEGS}, {FLOWS}, r AS (SELECT *, forwarded / received AS ratio FROM flows WHERE n_in > 0 AND n_out > 0 AND received > 0) "
    f"""SELECT case_id, account, received, n_in, forwarded, n_out, round(ratio, 4) AS ratio,
  {clamp4(f"least(0.3 + 0.4 * {sig('ratio', 0.85, 8)} + 0.3 * {sig('n_in + n_out', 6, 0.5)}, 1.0)")} AS score, CASE WHEN ratio >= 0.9 THEN 0.65::DOUBLE ELSE 0.55 END AS confidence FROM r WHERE ratio >= {MULE_RATIO}""",
    "transfers",
)
LAYERING = _chains(48, f"SELECT case_id, a, b, c, d, i1, i2, i3, volume, {clamp4(f'least(0.25 + 0.4 * {sig("3.0", 4, 0.8)} + 0.35 * {sig("volume", 100000, 5e-6)}, 1.0)')} AS score, 0.6::DOUBLE AS confidence FROM p")
_RAPID = f"least(0.35 + 0.35 * {sig('3.0', 4, 0.9)} + 0.3 * {sig('volume', 50000, 8e-6)}, 1.0)"
RAPID = _chains(
    2,
    f""", h AS (SELECT *, abs(last_us - first_us) / 3600000000.0::DOUBLE AS hours, {_RAPID} AS s FROM p)
SELECT case_id, a, b, c, d, i1, i2, i3, volume, round(hours, 2) AS hours, {clamp4("CASE WHEN hours < 1 THEN least(s + 0.1, 1.0) ELSE s END")} AS score, 0.65::DOUBLE AS confidence FROM h""",
)
HUB = with_views(
    f""", n AS (SELECT case_id, caller, count(DISTINCT receiver) AS n FROM calls WHERE receiver IS NOT NULL GROUP BY case_id, caller),
r AS (SELECT case_id, caller, n, n / greatest(avg(n) OVER (PARTITION BY case_id), 1.0) AS ratio FROM n)
SELECT case_id, caller, n, round(ratio, 4) AS ratio, {clamp4(f"least(0.6 * {sig('ratio', 3.75, 0.5)} + 0.4 * {sig('n', 8, 0.2)}, 1.0)")} AS score, 0.65::DOUBLE AS confidence FROM r WHERE n >= 4 AND ratio >= {HUB_RATIO}""",
    "calls",
)
TIME_RANGE = with_views(f", {LEGS} SELECT case_id, account, min(us) AS start_us, max(us) AS end_us, round((max(us) - min(us)) / 3600000000.0::DOUBLE, 2) AS span_hours FROM legs GROUP BY case_id, account", "transfers")

QUERIES = {"velocity": velocity, "mule": mule, "layering": layering, "rapid_hop": rapid_hop, "comm_hub": comm_hub, "time_range": time_range}
ORACLES = {"velocity": VELOCITY, "mule": MULE, "layering": LAYERING, "rapid_hop": RAPID, "comm_hub": HUB, "time_range": TIME_RANGE}
ORACLES = {k: v.replace(") , ", "), ") for k, v in ORACLES.items()}
