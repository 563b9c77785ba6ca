"""Queries over account features, profiles and scored tables."""

from __future__ import annotations

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from casegraph.functions.scratch import materialise, scratch_path
from casegraph.operators import features as X
from casegraph.operators import model as M
from casegraph.plans.driver_views import table, transfers, with_views

WORDS = ("error", "signup")


def _fraud(spark, d):
    t = transfers(spark, d)
    cases = table(spark, d, "orders").where("o_totalprice > 0").select(F.concat(F.lit("A"), (F.col("o_custkey") % 7).cast("string"), F.lit("| A"), (F.col("o_custkey") % 5).cast("string")).alias("involved_accounts"))
    return X.labels(cases, t.where("amount >= 99"))


def fraud_labels(spark, d):
    return _fraud(spark, d)


def features(spark, d):
    accounts = table(spark, d, "customer").select(F.concat(F.lit("A"), F.col("c_custkey").cast("string")).alias("account"))
    out = X.account_features(transfers(spark, d), _fraud(spark, d), accounts, WORDS)
    r = {c: F.round(c, 4) for c in ("std_tx_amount", "avg_tx_amount", "fwd_ratio", "round_amount_ratio_out", "near_threshold_ratio", "suspicious_desc_ratio", "total_volume")}
    return out.withColumns(r)


def split(spark, d):
    return X.split(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality")


def profile_numeric(spark, d):
    p = X.profile_numeric(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return p.select("column", "rows", "missing", "distinct", "zeros", "negatives", "outliers", *[F.round(c, 4).alias(c) for c in ("min", "max", "mean", "median", "q25", "q75", "std")])


def profile_top5(spark, d):
    return X.profile_top(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_shipdate"]).withColumn("rank", F.col("rank").cast("long"))


def duplicate_rows(spark, d):
    return X.duplicate_rows(table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_discount"))


def target_summary(spark, d):
    return X.target_summary(table(spark, d, "labels"), "quality")


def _scored(spark, d):
    """A fixed score for each label: the first digits of the digest of its id, raised for good ones."""
    u = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 4), 16, 10).cast("double") / 65536
    return table(spark, d, "labels").select("doc_id", F.round(F.when(F.col("quality") == 1, 0.3 + 0.7 * u).otherwise(0.7 * u), 6).alias("score"), F.col("quality").alias("label"))


def threshold_sweep(spark, d):
    return M.sweep(_scored(spark, d)).select("threshold", "tp", "fp", "fn", "tn", "f1")


def best_threshold(spark, d):
    return M.best_threshold(M.sweep(_scored(spark, d)))


def auc_ap(spark, d):
    return M.ranking_metrics(_scored(spark, d))


def confusion(spark, d):
    return M.confusion(_scored(spark, d), 0.5).select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def class_report(spark, d):
    out = M.class_report(_scored(spark, d), 0.5)
    return out.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")], "support")


def risk_bands(spark, d):
    return _scored(spark, d).groupBy(X.band(F.col("score")).alias("band"), X.display_band(F.col("score")).alias("shown")).agg(F.count("*").alias("n"))


def train_score(spark, d):
    """Trains a logistic model on the accounts' features and scores every account."""
    rows = materialise(_rows(spark, d))
    m = M.train(rows.where("part = 'train'"), names=("logistic",))["logistic"]
    scored = M.score(rows, m)
    return M.contributions(scored, m.stages[-1].coefficients.toArray().tolist()).select("account", "part", "score", "classification", "top_features", "explanation")


def _rows(spark, d):
    return X.split(features(spark, d).withColumn("is_fraud", (F.col("tx_in_count") > F.col("tx_out_count")).cast("int")), "account", "is_fraud")


TREES, ROUNDS = 40, 10  # of the registered queries; the library's own are 200 each


def model_metrics(spark, d):
    """Three models trained on the training part and measured on the validation part, as they are chosen by."""
    rows = materialise(_rows(spark, d))
    return M.evaluate(M.train(rows.where("part = 'train'"), trees=TREES, rounds=ROUNDS), rows.where("part = 'validation'"))


def model_reloaded(spark, d):
    """The forest saved with its metadata, loaded and measured again on the test part, beside its most important features."""
    rows = materialise(_rows(spark, d))
    m = M.train(rows.where("part = 'train'"), names=("forest",), trees=TREES)["forest"]
    path = scratch_path(spark)
    M.save(m, X.target_summary(rows, "is_fraud"), path)
    again = M.load(path)
    top = M.importance(again, spark).agg(F.array_join(F.collect_list("feature"), ",").alias("features"))
    return M.evaluate({"forest": again}, rows.where("part = 'test'")).crossJoin(F.broadcast(top))  # one row each


LINEAR = tuple((-1) ** k * (k + 1) / 20 for k in range(len(X.FEATURES)))


def linear_score(spark, d):
    """Scores, bands, contributions and sentences of a fixed linear model on standardised features."""
    rows = features(spark, d)
    x = VectorAssembler(inputCols=list(X.FEATURES), outputCol="raw").transform(rows)
    x = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(x).transform(x)
    v = vector_to_array("scaled")
    z = sum((v[k] * w for k, w in enumerate(LINEAR)), F.lit(0.0))
    scored = x.withColumn("score", F.round(1 / (1 + F.exp(-z)), 4)).withColumn("classification", X.band(F.col("score")))
    out = M.contributions(scored, list(LINEAR))
    return out.select("account", "score", "classification", F.get("top_features", F.lit(0))["feature"].alias("top"), F.round(F.get("top_features", F.lit(0))["contribution"], 3).alias("contribution"), F.startswith("explanation", F.lit("Risk")).alias("explained"))


def best_model(spark, d):
    """The model of the best average precision among scores of several ones."""
    s = _scored(spark, d)
    flat = s.withColumn("score", F.lit(0.5))
    both = M.ranking_metrics(s).withColumn("model", F.lit("raised")).unionByName(M.ranking_metrics(flat).withColumn("model", F.lit("flat")))
    return M.select_best(both)


FRAUD = """fraud AS (SELECT DISTINCT account FROM (SELECT trim(unnest(string_split('A' || (o_custkey % 7) || '| A' || (o_custkey % 5), '|'))) AS account FROM orders WHERE o_totalprice > 0
  UNION ALL SELECT unnest([src, dst]) FROM transfers WHERE amount >= 99) WHERE account <> '')"""
FEATURES_SQL = """, FRAUD_CTE, l AS (SELECT src AS account, dst AS peer, true AS sent, amount, description, src = dst AS loop FROM transfers UNION ALL SELECT dst, src, false, amount, description, src = dst FROM transfers),
g AS (SELECT account, coalesce(sum(amount::DECIMAL(18,2)) FILTER (sent), 0)::DOUBLE AS out_volume, count(amount) FILTER (sent) AS tx_out_count, coalesce(max(amount) FILTER (sent), 0) AS out_max_amount,
  coalesce(min(amount) FILTER (sent), 0) AS min_tx_amount, coalesce(sum(amount::DECIMAL(18,2)) FILTER (NOT sent), 0)::DOUBLE AS in_volume, count(amount) FILTER (NOT sent) AS tx_in_count,
  count(DISTINCT peer) FILTER (sent) AS unique_out_peers, count(DISTINCT peer) FILTER (NOT sent) AS unique_in_peers, coalesce(stddev_samp(amount) FILTER (sent), 0) AS std,
  coalesce(avg((amount % 1 = 0)::INT) FILTER (sent), 0) AS r, coalesce(avg((amount BETWEEN 9000 AND 10000)::INT) FILTER (sent), 0) AS nt, coalesce(avg((lower(description) IN ('error', 'signup'))::INT) FILTER (sent), 0) AS sd,
  coalesce(sum(loop::INT) FILTER (sent), 0)::BIGINT AS self_loop_count FROM l GROUP BY account),
u AS (SELECT coalesce(g.account, 'A' || c_custkey) AS account, g.* EXCLUDE (account) FROM g FULL JOIN customer ON g.account = 'A' || c_custkey)
SELECT account, coalesce(tx_out_count + tx_in_count, 0) AS tx_count, coalesce(tx_out_count, 0) AS tx_out_count, coalesce(tx_in_count, 0) AS tx_in_count, round(coalesce(out_volume + in_volume, 0), 4) AS total_volume,
  coalesce(out_volume, 0) AS out_volume, coalesce(in_volume, 0) AS in_volume, round(coalesce(out_volume / nullif(tx_out_count, 0), 0), 4) AS avg_tx_amount, coalesce(out_max_amount, 0) AS max_tx_amount, coalesce(min_tx_amount, 0) AS min_tx_amount,
  round(coalesce(std, 0), 4) AS std_tx_amount, round(coalesce(out_volume / (in_volume + 1), 0), 4) AS fwd_ratio, coalesce(unique_out_peers + unique_in_peers, 0) AS unique_peers, coalesce(unique_out_peers, 0) AS unique_out_peers,
  coalesce(unique_in_peers, 0) AS unique_in_peers, round(coalesce(r, 0), 4) AS round_amount_ratio_out, round(coalesce(nt, 0), 4) AS near_threshold_ratio, round(coalesce(sd, 0), 4) AS suspicious_desc_ratio,
  coalesce(self_loop_count, 0) AS self_loop_count, coalesce(out_max_amount, 0) AS out_max_amount, (account IN (SELECT account FROM fraud))::INTEGER AS is_fraud FROM u""".replace("FRAUD_CTE", FRAUD)
_COLUMN = """SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "distinct", count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives,
  (SELECT count(*) FROM lineitem, (SELECT avg({c}::DOUBLE) AS m, stddev_samp({c}::DOUBLE) AS s FROM lineitem) WHERE abs({c}::DOUBLE - m) > 3 * s) AS outliers, round(min({c})::DOUBLE, 4) AS "min", round(max({c})::DOUBLE, 4) AS "max",
  round(avg({c}::DOUBLE), 4) AS mean, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q25, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q75, round(stddev_samp({c}::DOUBLE), 4) AS std FROM lineitem"""
_SCORED = """scored AS (SELECT doc_id, round(CASE WHEN quality = 1 THEN 0.3 + 0.7 * u ELSE 0.7 * u END, 6) AS score, quality AS label FROM (SELECT *, ('0x' || substr(md5(doc_id::VARCHAR), 1, 4))::BIGINT / 65536.0::DOUBLE AS u FROM labels))"""
_CONF = """count(*) FILTER (score >= {t} AND label = 1) AS tp, count(*) FILTER (score >= {t} AND label <> 1) AS fp, count(*) FILTER (score < {t} AND label = 1) AS fn, count(*) FILTER (score < {t} AND label <> 1) AS tn"""
_SWEEP = f"{_SCORED}, s AS (SELECT t / 20.0 AS threshold, {_CONF.format(t='t / 20.0')} FROM scored, range(1, 20) r(t) GROUP BY t)"
_F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) ELSE 0.0 END"

QUERIES = {
    "labels": fraud_labels, "features": features, "split": split, "profile_numeric": profile_numeric, "profile_top5": profile_top5, "duplicate_rows": duplicate_rows, "target_summary": target_summary,
    "threshold_sweep": threshold_sweep, "best_threshold": best_threshold, "auc_ap": auc_ap, "confusion": confusion, "class_report": class_report, "risk_bands": risk_bands, "train_score": train_score, "model_metrics": model_metrics, "model_reloaded": model_reloaded, "linear_score": linear_score, "best_model": best_model,
}
ORACLES = {
    "labels": with_views(f", {FRAUD} SELECT account FROM fraud", "transfers"),
    "features": with_views(FEATURES_SQL, "transfers"),
    "split": """SELECT doc_id, quality, CASE WHEN place < 0.6 THEN 'train' WHEN place < 0.6::DOUBLE + 0.2::DOUBLE THEN 'validation' ELSE 'test' END AS part FROM (SELECT doc_id, quality,
      (row_number() OVER (PARTITION BY quality ORDER BY md5('42' || doc_id), doc_id) - 1) / count(*) OVER (PARTITION BY quality)::DOUBLE AS place FROM labels)""",
    "profile_numeric": " UNION ALL ".join(_COLUMN.format(c=c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    "profile_top5": """SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM (
      SELECT 'l_returnflag' AS "column", l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2
      UNION ALL SELECT 'l_shipdate', l_shipdate::VARCHAR, count(*) FROM lineitem GROUP BY 2) QUALIFY rank <= 5""",
    "duplicate_rows": "SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_quantity, l_discount FROM lineitem)))::BIGINT AS duplicates FROM lineitem",
    "target_summary": """SELECT count(*) AS rows, count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives, round(count(*) FILTER (quality = 0) / nullif(count(*) FILTER (quality = 1), 0)::DOUBLE, 4) AS ratio,
      round(100 * (count(*) FILTER (quality = 1) / count(*)::DOUBLE), 4) AS pct FROM labels""",
    "threshold_sweep": f"WITH {_SWEEP} SELECT threshold::DOUBLE AS threshold, tp, fp, fn, tn, {_F1} AS f1 FROM s",
    "best_threshold": f"WITH {_SWEEP} SELECT threshold::DOUBLE AS threshold, {_F1} AS f1 FROM s ORDER BY {_F1} DESC, threshold LIMIT 1",
    "auc_ap": f"""WITH {_SCORED}, g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM scored GROUP BY score),
      c AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM g)
      SELECT round(sum((tp - p / 2.0::DOUBLE) * n) / (sum(p) * sum(n)), 6) AS roc_auc, round(sum(p * tp / (tp + fp)::DOUBLE) / sum(p), 6) AS average_precision FROM c""",
    "confusion": f"WITH {_SCORED}, s AS (SELECT {_CONF.format(t='0.5')} FROM scored) SELECT tp, fp, fn, tn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, {_F1} AS f1 FROM s",
    "class_report": f"""WITH {_SCORED}, s AS (SELECT {_CONF.format(t='0.5')} FROM scored), c AS (SELECT '0' AS class, tn AS r, fn AS w, fp AS m, tp + tn AS good FROM s UNION ALL SELECT '1', tp, fp, fn, tp + tn FROM s),
      v AS (SELECT class, coalesce(r / nullif(r + w, 0)::DOUBLE, 0) AS precision, coalesce(r / nullif(r + m, 0)::DOUBLE, 0) AS recall, coalesce(2 * r / nullif(2 * r + w + m, 0)::DOUBLE, 0) AS f1, r + m AS support, good FROM c),
      a AS (SELECT * FROM v UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT, max(good) FROM v
        UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT, max(good) FROM v)
      SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(good / (SELECT sum(support) FROM v)::DOUBLE, 6) AS accuracy, support FROM a""",
    "risk_bands": f"""WITH {_SCORED} SELECT CASE WHEN score >= 0.8 THEN 'HIGH' WHEN score >= 0.5 THEN 'MEDIUM' WHEN score >= 0.2 THEN 'LOW' ELSE 'VERY_LOW' END AS band,
      CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS shown, count(*) AS n FROM scored GROUP BY 1, 2""",
}
_Z = ", ".join(f"coalesce(({f} - avg({f}) OVER ()) / nullif(stddev_samp({f}) OVER (), 0), 0) * {w} AS z_{f}" for f, w in zip(X.FEATURES, LINEAR, strict=True))
_TOP = "[" + ", ".join(f"{{o: -abs(z_{f}), f: '{f}', c: z_{f}}}" for f in X.FEATURES) + "]"
ORACLES["linear_score"] = (
    with_views(FEATURES_SQL.replace("SELECT account, coalesce(tx_out_count", ", ft AS (SELECT account, coalesce(tx_out_count"), "transfers")
    + f"""), zs AS (SELECT account, {_Z} FROM ft), sc AS (SELECT account, round(1 / (1 + exp(-({' + '.join('z_' + f for f in X.FEATURES)}))), 4) AS score, list_sort({_TOP})[1] AS t FROM zs)
SELECT account, score, CASE WHEN score >= 0.8 THEN 'HIGH' WHEN score >= 0.5 THEN 'MEDIUM' WHEN score >= 0.2 THEN 'LOW' ELSE 'VERY_LOW' END AS classification, t.f AS top, round(round(t.c, 6), 3) AS contribution, true AS explained FROM sc"""
)
ORACLES["best_model"] = ORACLES["auc_ap"].replace("SELECT round(sum((tp", "SELECT 'raised' AS model, average_precision FROM (SELECT round(sum((tp") + ")"
ORACLES = {k: v.replace(") , ", "), ") for k, v in ORACLES.items()}
