"""Account features, fraud labels, reproducible splits and dataset profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegraph.functions.scratch import materialise

# Descriptions (lower case) that count as suspicious.
SUSPICIOUS = (
    "dormant account sudden activity", "offshore transfer to tax haven", "layered transfer via intermediary", "high-value cross-border wire",
    "round-trip transaction", "shell company payment", "structuring deposit below threshold", "rapid movement of funds between accounts",
)
# The order of the feature vector.
FEATURES = (
    "tx_count", "tx_out_count", "tx_in_count", "total_volume", "out_volume", "in_volume", "avg_tx_amount", "max_tx_amount", "min_tx_amount", "std_tx_amount",
    "fwd_ratio", "unique_peers", "unique_out_peers", "unique_in_peers", "round_amount_ratio_out", "near_threshold_ratio", "suspicious_desc_ratio", "self_loop_count", "out_max_amount",
)


def labels(cases: DataFrame, fraud_transfers: DataFrame) -> DataFrame:
    """ML-1: accounts named in cases (involved_accounts, split at |) or at either end of a fraud transfer."""
    named = cases.select(F.explode(F.split("involved_accounts", "[|]")).alias("account")).select(F.trim("account").alias("account"))
    ends = fraud_transfers.select(F.explode(F.array("src", "dst")).alias("account"))
    return named.unionByName(ends).where("account IS NOT NULL AND account <> ''").distinct()


def account_features(transfers: DataFrame, fraud: DataFrame | None = None, accounts: DataFrame | None = None, suspicious: tuple[str, ...] = SUSPICIOUS) -> DataFrame:
    """ML-2 to ML-8: one row per account. transfers: src, dst, amount, description; fraud, accounts: account.

    Both ends of every transfer and the listed accounts are unpivoted into legs, so all sums take one shuffle. Distinct
    peers are counted on a second, pre-aggregated one.
    """
    amount = F.col("amount")
    flags = {
        "is_round": F.coalesce((amount % 1 == 0).cast("int"), F.lit(0)), "near": F.coalesce(amount.between(9000, 10000).cast("int"), F.lit(0)),
        "odd": F.coalesce(F.lower("description").isin(*suspicious).cast("int"), F.lit(0)), "loop": F.coalesce((F.col("src") == F.col("dst")).cast("int"), F.lit(0)),
    }
    leg = lambda me, peer, sent: F.struct(F.col(me).alias("account"), F.col(peer).alias("peer"), F.lit(sent).alias("sent"))
    legs = transfers.withColumns(flags).withColumn("e", F.explode(F.array(leg("src", "dst", True), leg("dst", "src", False))))
    legs = legs.select("e.*", "amount", *flags).where("account IS NOT NULL")
    cents = amount.cast("decimal(18,2)")
    out = lambda x: F.when(F.col("sent"), x)
    # Repeats of (account, peer, direction) fold first, so that distinct peers are plain sums after it.
    part = legs.groupBy("account", "peer", "sent").agg(
        F.sum(cents).alias("s"), F.count("amount").alias("n"), F.count("*").alias("rows"), F.max("amount").alias("hi"), F.min("amount").alias("lo"),
        F.sum(amount * amount).alias("sq"), F.sum(amount).alias("x"), *[F.sum(f).alias(f) for f in flags],
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    money = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    n = F.sum(out(F.col("n")))
    ratio = lambda f: F.coalesce(F.try_divide(F.sum(out(F.col(f))), F.sum(out(F.col("rows")))), F.lit(0.0))
    got = part.groupBy("account").agg(
        money(F.sum(out(F.col("s")))).alias("out_volume"), zero(n).alias("tx_out_count"), money(F.max(out(F.col("hi")))).alias("out_max_amount"), money(F.min(out(F.col("lo")))).alias("min_tx_amount"),
        money(F.sum(F.when(~F.col("sent"), F.col("s")))).alias("in_volume"), zero(F.sum(F.when(~F.col("sent"), F.col("n")))).alias("tx_in_count"),
        F.count(F.when(F.col("sent") & F.col("peer").isNotNull(), 1)).alias("unique_out_peers"), F.count(F.when(~F.col("sent") & F.col("peer").isNotNull(), 1)).alias("unique_in_peers"),
        F.sum(out(F.col("sq"))).alias("sq"), F.sum(out(F.col("x"))).alias("x"),
        ratio("is_round").alias("round_amount_ratio_out"), ratio("near").alias("near_threshold_ratio"), ratio("odd").alias("suspicious_desc_ratio"), zero(F.sum(out(F.col("loop")))).alias("self_loop_count"),
    )
    var = (F.col("sq") - F.col("x") * F.col("x") / F.col("tx_out_count")) / (F.col("tx_out_count") - 1)
    got = got.withColumns({
        "std_tx_amount": F.when(F.col("tx_out_count") > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(0.0), "avg_tx_amount": F.coalesce(F.try_divide("out_volume", "tx_out_count"), F.lit(0.0)), "max_tx_amount": F.col("out_max_amount"),
        "tx_count": F.col("tx_out_count") + F.col("tx_in_count"), "total_volume": F.col("out_volume") + F.col("in_volume"), "fwd_ratio": F.col("out_volume") / (F.col("in_volume") + 1), "unique_peers": F.col("unique_out_peers") + F.col("unique_in_peers"),
    })
    if accounts is not None:
        got = got.join(accounts.select("account").where("account IS NOT NULL").distinct(), "account", "full").fillna(0)
    got = got.select("account", *FEATURES)
    if fraud is None:
        return got.withColumn("is_fraud", F.lit(0))
    marks = fraud.select("account").distinct().withColumn("is_fraud", F.lit(1))
    return got.join(marks, "account", "left").withColumn("is_fraud", F.coalesce("is_fraud", F.lit(0)))


def split(rows: DataFrame, key: str, label: str, shares: tuple[float, float] = (0.6, 0.2)) -> DataFrame:
    """ML-10: column `part` (train, validation, test) by rank of the key's digest inside each label: exact and repeatable.

    The rank needs an order over a label's rows: digests fall evenly into 256 slots, which are ranked apart and offset by
    the counts of the slots before, so no label is one task.
    """
    h = rows.withColumn("_h", F.md5(F.concat(F.lit("42"), F.col(key).cast("string")))).withColumn("_slot", F.substring("_h", 1, 2))
    counts = h.groupBy(label, "_slot").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(label).orderBy("_slot")
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.withColumn("_all", F.sum("_n").over(Window.partitionBy(label))).drop("_n")
    ranked = h.withColumn("_r", F.row_number().over(Window.partitionBy(label, "_slot").orderBy("_h", key))).join(counts, [label, "_slot"])
    at = (F.col("_before") + F.col("_r") - 1) / F.col("_all")
    part = F.when(at < shares[0], "train").when(at < shares[0] + shares[1], "validation").otherwise("test")
    return ranked.withColumn("part", part).drop("_h", "_slot", "_r", "_before", "_all")


def profile_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """ML-25: one row per column: missing, distinct, range, mean, quartiles, deviation, zeros, negatives and 3-sigma outliers.

    One pass counts the values of all columns; the rest is done on distinct values. Quartiles are exact (linear between
    neighbours): values are dealt by range, so that running counts need no more than the totals of the ranges before.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    counts = materialise(df.select(F.inline(pairs)).groupBy("column", "x").agg(F.count("*").alias("n")))
    known, x, n = F.col("x").isNotNull(), F.col("x"), F.col("n")
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    agg = counts.groupBy("column").agg(
        F.sum("n").alias("rows"), total(~known).alias("missing"), F.count("x").alias("distinct"), F.min("x").alias("min"), F.max("x").alias("max"), (F.sum(x * n) / total(known)).alias("mean"),
        total(x == 0).alias("zeros"), total(x < 0).alias("negatives"),
    )
    far = counts.where(known).join(F.broadcast(agg.select("column", "mean")), "column")  # one row for each named column
    var = F.sum((x - F.col("mean")) * (x - F.col("mean")) * n)
    agg = agg.join(far.groupBy("column").agg(F.when(F.sum("n") > 1, F.sqrt(var / (F.sum("n") - 1))).alias("std")), "column", "left")
    far = counts.where(known).join(F.broadcast(agg.select("column", "mean", "std")), "column")
    agg = agg.join(far.groupBy("column").agg(total(F.abs(x - F.col("mean")) > 3 * F.col("std")).alias("outliers")), "column", "left").fillna(0, ["outliers"])
    ranges = materialise(counts.where(known).repartitionByRange("column", "x").withColumn("range", F.spark_partition_id()))
    sums = ranges.groupBy("column", "range").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("column").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("column", "range", F.coalesce(before, F.lit(0)).alias("before"))
    up_to = F.sum("n").over(Window.partitionBy("column", "range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranges.withColumn("up_to", up_to).join(sums, ["column", "range"]).join(F.broadcast(agg.select("column", (F.col("rows") - F.col("missing")).alias("all"))), "column")

    def quantile(p: float) -> Column:
        at = (F.col("all") - 1) * F.lit(p)
        value = lambda place: F.min(F.when(F.col("before") + F.col("up_to") > place, x))
        low, high = value(F.floor(at)), value(F.ceil(at))
        return low + (high - low) * F.max(at - F.floor(at))

    q = placed.groupBy("column").agg(quantile(0.5).alias("median"), quantile(0.25).alias("q25"), quantile(0.75).alias("q75"))
    return agg.join(q, "column", "left")


ACCURACY = 400  # k of the quantile sketches: ranks err by about 2.3 / k ** 0.9
LOG_SIZE = 14  # of the distinct counts: they err by about 0.8 / 2 ** (LOG_SIZE / 2)


def sketches(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """ML-25 at scale: one row per column (and per key of by) with counts, sums and mergeable sketches of quantiles and distinct values.

    One pass, and one small row a task is shuffled; rows of several days or parts merge by merge_sketches without their data.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    x = F.col("x")
    count = lambda c: F.count(F.when(c, 1))
    return df.select(*by, F.inline(pairs)).groupBy(*by, "column").agg(
        F.count("*").alias("rows"), count(x.isNull()).alias("missing"), count(x == 0).alias("zeros"), count(x < 0).alias("negatives"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.sum("x").alias("total"), F.coalesce(F.var_pop("x") * F.count("x"), F.lit(0.0)).alias("squares"),
        F.kll_sketch_agg_double("x", F.lit(ACCURACY)).alias("quantiles"), F.hll_sketch_agg(x.cast("string"), F.lit(LOG_SIZE)).alias("values"),
    )


def merge_sketches(parts: DataFrame) -> DataFrame:
    """Rows of sketches() of several parts as one for each column."""
    n, mean = F.col("rows") - F.col("missing"), F.try_divide("total", F.col("rows") - F.col("missing"))
    whole = F.try_divide(F.sum("total"), F.sum(n))  # squares about the common mean: those within the parts and those of their means
    squares = F.sum("squares") + F.coalesce(F.sum(n * mean * mean) - F.sum(n) * whole * whole, F.lit(0.0))
    return parts.groupBy("column").agg(
        *[F.sum(c).alias(c) for c in ("rows", "missing", "zeros", "negatives", "total")], F.min("min").alias("min"), F.max("max").alias("max"), squares.alias("squares"),
        F.kll_merge_agg_double("quantiles", F.lit(ACCURACY)).alias("quantiles"), F.hll_union_agg("values").alias("values"),
    )


def profile_of(sketched: DataFrame) -> DataFrame:
    """The profile that rows of sketches tell: quartiles by rank, distinct values to within the sketches' errors, the rest exact."""
    n = F.col("rows") - F.col("missing")
    at = lambda p: F.when(n > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(p)))
    return sketched.select(
        "column", "rows", "missing", F.hll_sketch_estimate("values").alias("distinct"), "zeros", "negatives", "min", "max", F.try_divide("total", n).alias("mean"),
        F.when(n > 1, F.sqrt(F.greatest(F.col("squares"), F.lit(0.0)) / (n - 1))).alias("std"), at(0.25).alias("q25"), at(0.5).alias("median"), at(0.75).alias("q75"),
    )


def profile_top(df: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """ML-25: the n most frequent values of each text column."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("e")).select("e.*").where("value IS NOT NULL")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= n)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """ML-25: number of rows that repeat an earlier one."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def target_summary(rows: DataFrame, label: str) -> DataFrame:
    """ML-19, ML-26: rows, positives, negatives, their ratio and the share of positives."""
    pos = F.count(F.when(F.col(label) == 1, 1))
    neg = F.count(F.when(F.col(label) == 0, 1))
    out = rows.agg(F.count("*").alias("rows"), pos.alias("positives"), neg.alias("negatives"))
    return out.withColumns({"ratio": F.round(F.try_divide("negatives", "positives"), 4), "pct": F.round(100 * F.try_divide("positives", "rows"), 4)})


def band(score: Column) -> Column:
    """ML-22: risk band of a score."""
    return F.when(score >= 0.8, "HIGH").when(score >= 0.5, "MEDIUM").when(score >= 0.2, "LOW").otherwise("VERY_LOW")


def display_band(score: Column) -> Column:
    """CS-7."""
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")
