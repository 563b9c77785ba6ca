"""Risk models with Spark ML: training, choice, threshold, evaluation, batch scoring, contributions."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegraph.operators.features import FEATURES, band

SCORE_DIGITS = 6


def weighted(rows: DataFrame, label: str = "is_fraud") -> DataFrame:
    """ML-12: column weight = n / (2 * rows of the class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_c"))
    total = rows.count()
    return rows.join(F.broadcast(counts.limit(1000)), label).withColumn("weight", F.lit(float(total)) / (2 * F.col("_c"))).drop("_c")


def estimators(trees: int = 200, rounds: int = 200, total_weight: float = 1.0, label: str = "is_fraud") -> dict[str, object]:
    """ML-12 to ML-14."""
    common = {"featuresCol": "scaled", "labelCol": label, "weightCol": "weight"}
    return {
        "logistic": LogisticRegression(maxIter=1000, regParam=1.0 / max(total_weight, 1.0), **common),
        "forest": RandomForestClassifier(numTrees=trees, maxDepth=10, seed=42, **common),
        "boosted": GBTClassifier(maxIter=rounds, maxDepth=6, stepSize=0.1, seed=42, **common),
    }


def train(rows: DataFrame, features: tuple[str, ...] = FEATURES, label: str = "is_fraud", names: tuple[str, ...] = ("logistic", "forest", "boosted"), trees: int = 200, rounds: int = 200) -> dict[str, PipelineModel]:
    """ML-11 to ML-14: assemble, standardise on the training rows only, fit each model."""
    rows = weighted(rows.fillna(0, list(features)), label)
    total = rows.agg(F.sum("weight")).first()[0] or 1.0
    steps = [VectorAssembler(inputCols=list(features), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True)]
    fits = estimators(trees, rounds, total, label)
    return {n: Pipeline(stages=[*steps, fits[n]]).fit(rows) for n in names}


def score(rows: DataFrame, model: PipelineModel, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """ML-21, ML-22: rows plus score (6 places) and band; missing features count as 0."""
    out = model.transform(rows.fillna(0, list(features)))
    p = F.round(F.element_at(vector_to_array("probability"), 2), SCORE_DIGITS)
    return out.withColumn("score", p).withColumn("classification", band(F.col("score"))).drop("raw", "rawPrediction", "probability", "prediction")


def contributions(scored: DataFrame, weights: list[float], features: tuple[str, ...] = FEATURES, n: int = 5) -> DataFrame:
    """ML-23: the n features of the largest |scaled value * weight| of each row, and ML-24: a sentence on them."""
    x = vector_to_array("scaled")
    each = F.array(*[F.struct((-F.abs(x[k] * w)).alias("o"), F.lit(f).alias("feature"), F.round(x[k] * w, 6).alias("contribution")) for k, (f, w) in enumerate(zip(features, weights, strict=True))])
    top = F.transform(F.slice(F.array_sort(each), 1, n), lambda e: F.struct(e["feature"].alias("feature"), e["contribution"].alias("contribution")))
    out = scored.withColumn("top_features", top)
    names = F.array_join(F.transform("top_features", lambda e: e["feature"]), ", ")
    return out.withColumn("explanation", F.format_string("Risk %s (%.2f): mainly %s.", "classification", "score", names))


def importance(model: PipelineModel, spark, features: tuple[str, ...] = FEATURES, n: int = 10) -> DataFrame:
    """ML-18: the n most important features of the last stage."""
    last = model.stages[-1]
    got = [abs(x) for x in last.coefficients.toArray()] if hasattr(last, "coefficients") else last.featureImportances.toArray().tolist()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, got, strict=True)], "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(n)


def confusion(scored: DataFrame, threshold: Column | float, label: str = "label", *by: str) -> DataFrame:
    """ML-15: tp, fp, fn, tn and precision, recall, F1 (0 where undefined) at a threshold."""
    hit, yes = F.col("score") >= threshold, F.col(label) == 1
    count = lambda c: F.count(F.when(c, 1))
    out = scored.groupBy(*by).agg(count(hit & yes).alias("tp"), count(hit & ~yes).alias("fp"), count(~hit & yes).alias("fn"), count(~hit & ~yes).alias("tn"))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumns({"precision": safe(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def class_report(scored: DataFrame, threshold: Column | float, label: str = "label", *by: str) -> DataFrame:
    """ML-15: precision, recall, F1 (0 where undefined) and support of each class ("0", "1"), their mean ("macro avg") and their mean by
    support ("weighted avg"), and the accuracy, at a threshold; rows with a label only."""
    c = confusion(scored.where(F.col(label).isNotNull()), threshold, label, *by)
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))

    def one(name: str, right: str, wrong: str, missed: str) -> Column:
        p, r = safe(F.col(right), F.col(right) + F.col(wrong)), safe(F.col(right), F.col(right) + F.col(missed))
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), safe(2 * p * r, p + r).alias("f1"), (F.col(right) + F.col(missed)).alias("support"))

    c = c.select(*by, one("0", "tn", "fn", "fp").alias("x"), one("1", "tp", "fp", "fn").alias("y"), safe(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"))
    n = F.col("x.support") + F.col("y.support")
    mean = lambda k, a, b: [safe(F.col(f"x.{v}") * a + F.col(f"y.{v}") * b, k).alias(v) for v in ("precision", "recall", "f1")]
    macro = F.struct(F.lit("macro avg").alias("class"), *mean(F.lit(2), F.lit(1), F.lit(1)), n.alias("support"))
    weighted = F.struct(F.lit("weighted avg").alias("class"), *mean(n, F.col("x.support"), F.col("y.support")), n.alias("support"))
    return c.select(*by, "accuracy", F.inline(F.array("x", "y", macro, weighted)))


def sweep(scored: DataFrame, label: str = "label") -> DataFrame:
    """ML-17: confusion at 0.05, 0.10, ..., 0.95. Scores are counted per step first, so 20 rows meet the 19 thresholds."""
    step = F.least(F.floor(F.round(F.col("score") * 20, 9)), F.lit(19))
    counts = scored.groupBy(step.alias("step")).agg(F.count(F.when(F.col(label) == 1, 1)).alias("p"), F.count(F.when(F.col(label) != 1, 1)).alias("n"))
    t = scored.sparkSession.range(1, 20).withColumn("threshold", F.round(F.col("id") / 20, 2))
    both = t.join(F.broadcast(counts), F.lit(True))
    over = F.col("step") >= F.col("id")
    out = both.groupBy("threshold").agg(*[F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0)).alias(a) for a, c, x in (("tp", over, "p"), ("fp", over, "n"), ("fn", ~over, "p"), ("tn", ~over, "n"))])
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = out.withColumns({"precision": safe(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", F.round(safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 6))


def best_threshold(swept: DataFrame, default: float = 0.5) -> DataFrame:
    """ML-17: the first threshold of the largest F1; the default where every F1 is 0."""
    top = F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("threshold")))
    return swept.agg(top.alias("b")).select(F.when(F.col("b.f1") > 0, F.col("b.threshold")).otherwise(default).alias("threshold"), "b.f1")


def ranking_metrics(scored: DataFrame, label: str = "label") -> DataFrame:
    """ML-15: ROC-AUC by rank sums and average precision by steps of recall, ties together.

    Rows fold to one per distinct score. Running counts go by slots of scores (a thousandth wide), on top of the totals of
    the slots above, so that no task orders all scores.
    """
    per = scored.groupBy("score").agg(F.count(F.when(F.col(label) == 1, 1)).alias("p"), F.count(F.when(F.col(label) != 1, 1)).alias("n"))
    per = per.withColumn("slot", F.floor(F.col("score") * 1000))
    above = Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each slot
    slots = per.groupBy("slot").agg(F.sum("p").alias("sp"), F.sum("n").alias("sn"))
    slots = slots.select("slot", F.coalesce(F.sum("sp").over(above), F.lit(0)).alias("p_above"), F.coalesce(F.sum("sn").over(above), F.lit(0)).alias("n_above"))
    w = Window.partitionBy("slot").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    c = per.withColumns({"tp": F.sum("p").over(w), "fp": F.sum("n").over(w)}).join(F.broadcast(slots), "slot")
    tp, fp = F.col("p_above") + F.col("tp"), F.col("n_above") + F.col("fp")
    out = c.agg(F.sum((tp - F.col("p") / 2) * F.col("n")).alias("area"), F.sum(F.col("p") * tp / (tp + fp)).alias("ap"), F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    return out.select(F.round(F.try_divide("area", F.col("pos") * F.col("neg")), 6).alias("roc_auc"), F.round(F.try_divide("ap", "pos"), 6).alias("average_precision"))


def select_best(metrics: DataFrame) -> DataFrame:
    """ML-16: the model of the best average precision. metrics: model, average_precision."""
    return metrics.agg(F.max_by("model", F.struct("average_precision", "model")).alias("model"), F.max("average_precision").alias("average_precision"))


def evaluate(models: dict[str, PipelineModel], rows: DataFrame, label: str = "is_fraud", threshold: float = 0.5) -> DataFrame:
    """ML-15, ML-20: one row of metrics per model."""
    out = None
    for name, m in models.items():
        scored = score(rows, m).select("score", F.col(label).alias("label"))
        one = ranking_metrics(scored).join(confusion(scored, threshold), F.lit(True)).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def save(model: PipelineModel, metadata: DataFrame, path: str) -> None:
    """IO-18: the pipeline and a one-row table on its training."""
    model.write().overwrite().save(f"{path}/model")
    metadata.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def load(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")
