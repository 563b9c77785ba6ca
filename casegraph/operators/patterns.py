"""Pattern detectors over transfers, calls and the graph. Every detector handles all cases at once.

transfers: id, case_id, src, dst, amount, us; calls: case_id, caller, receiver; vertices: id, type, risk;
edges: src, dst, rel. Thresholds are arguments. No detector reads a group into one task: windows are cut into
time buckets, chains join on (account, bucket), neighbour counts aggregate before they join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegraph import schemas as S
from casegraph.functions.expr import HOUR_US, clamp4, money, sig

CHAIN_ROWS = 4096  # transfers for each task that joins chains

def legs(transfers: DataFrame) -> DataFrame:
    """Two rows a transfer, one for each end; a transfer to oneself counts twice."""
    ends = F.array(F.struct(F.col("src").alias("account"), F.lit(True).alias("sent")), F.struct(F.col("dst").alias("account"), F.lit(False).alias("sent")))
    return transfers.withColumn("e", F.explode(ends)).select("id", "case_id", "e.account", "e.sent", "us", money(F.col("amount")).alias("amount")).where("account IS NOT NULL")


def velocity(transfers: DataFrame, hours: float = 24, least: int = 5) -> DataFrame:
    """PT-6: accounts with `least` or more transfers in a trailing window; the first largest window is told.

    A leg enters at its time and leaves after `hours`: running sums of both tell what a window holds, so that a row costs the
    same whatever its window's size. A leg is also history for the next time bucket, so a busy account spreads over as many
    tasks as it has buckets.
    """
    span = int(hours * HOUR_US)
    rows = legs(transfers).where("us IS NOT NULL").withColumn("b", F.floor(F.col("us") / span))
    enters = F.struct(F.col("b").alias("b"), F.col("us").alias("at"), F.lit(1).alias("one"), F.col("amount").alias("amount"))
    again = F.struct((F.col("b") + 1).alias("b"), F.col("us").alias("at"), F.lit(1).alias("one"), F.col("amount").alias("amount"))
    leaves = F.struct((F.col("b") + 1).alias("b"), (F.col("us") + span + 1).alias("at"), F.lit(-1).alias("one"), (-F.col("amount")).cast("decimal(18,2)").alias("amount"))
    steps = rows.select("case_id", "account", F.explode(F.array(enters, again, leaves)).alias("e")).select("case_id", "account", "e.*")
    w = Window.partitionBy("case_id", "account", "b").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    steps = steps.select("case_id", "account", "b", "one", F.col("at").alias("us"), F.sum("one").over(w).alias("n"), F.sum("amount").over(w).alias("volume"))
    # A bucket's best window, then what it holds, all where the bucket lies; each leg counts in its own bucket.
    own, here = (F.col("one") == 1) & (F.floor(F.col("us") / span) == F.col("b")), Window.partitionBy("case_id", "account", "b")
    rank = lambda: F.struct(F.col("n"), -F.col("us"))
    steps = steps.withColumn("w", F.max_by(F.struct("n", "volume", "us"), F.when(own, rank())).over(here))
    steps = steps.where((F.col("one") == 1) & (F.col("w.n") >= least) & F.col("us").between(F.col("w.us") - span, F.col("w.us")))
    best = steps.groupBy("case_id", "account", "b").agg(F.first("w").alias("w"), F.min("us").alias("start_us")).select("case_id", "account", "w.n", "w.volume", "start_us", "w.us")
    best = best.groupBy("case_id", "account").agg(F.max_by(F.struct("n", "volume", "start_us", "us"), rank()).alias("w"))
    return velocity_told(best)


def velocity_told(best: DataFrame) -> DataFrame:
    """PT-6: score and confidence of the windows w (n, volume, start_us, us) of accounts."""
    n, volume = F.col("w.n"), F.col("w.volume").cast("double")
    return best.select(
        "case_id", "account", n.alias("n"), volume.alias("volume"), F.col("w.start_us").alias("start_us"), F.col("w.us").alias("end_us"),
        clamp4(F.least(0.6 * sig(n, 8, 0.4) + 0.4 * sig(volume, 200_000, 3e-6), F.lit(1.0))).alias("score"), F.when(n >= 10, 0.7).otherwise(0.55).alias("confidence"),
    )


def flows(transfers: DataFrame) -> DataFrame:
    """Per account: received, n_in, sent, n_out, in one pass and one shuffle."""
    got = lambda sent: F.when(F.col("sent") if sent else ~F.col("sent"), F.col("amount"))
    zero = F.lit(0).cast("decimal(18,2)")
    return legs(transfers).groupBy("case_id", "account").agg(
        F.coalesce(F.sum(got(False)), zero).cast("double").alias("received"), F.count(got(False)).alias("n_in"),
        F.coalesce(F.sum(got(True)), zero).cast("double").alias("forwarded"), F.count(got(True)).alias("n_out"),
    )


def mule(transfers: DataFrame, ratio: float = 0.75) -> DataFrame:
    """PT-2: accounts that forward at least `ratio` of what they receive."""
    f = flows(transfers).where("n_in > 0 AND n_out > 0 AND received > 0").withColumn("ratio", F.col("forwarded") / F.col("received")).where(F.col("ratio") >= ratio)
    score = 0.3 + 0.4 * sig(F.col("ratio"), 0.85, 8) + 0.3 * sig((F.col("n_in") + F.col("n_out")).cast("double"), 6, 0.5)
    return f.select("case_id", "account", "received", "n_in", "forwarded", "n_out", F.round("ratio", 4).alias("ratio"), clamp4(F.least(score, F.lit(1.0))).alias("score"), F.when(F.col("ratio") >= 0.9, 0.65).otherwise(0.55).alias("confidence"))


def chains(transfers: DataFrame, hours: float, ordered: bool = False) -> DataFrame:
    """PT-3, PT-8: distinct chains a, b, c, d of three transfers between four accounts, each leg within `hours` of the first.

    Of several transfers for one chain the lexicographically first by id count. Legs without a time always fit. The transfers
    of two accounts are one row, so a chain is one row of two joins and is found once: chains are neither shuffled nor
    sorted. Rows join on (account, time bucket), so that a busy account is spread by time, in tasks by the number of transfers:
    few bytes come in where many chains go out.
    """
    span = int(hours * HOUR_US)
    t = transfers.select("case_id", "src", "dst", "id", "us", money(F.col("amount")).alias("amount")).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    pairs = t.groupBy("case_id", "src", "dst").agg(F.collect_list(F.struct("id", "us", "amount")).alias("legs"))
    rows, untimed = t.agg(F.count("*"), F.count(F.when(F.col("us").isNull(), 1))).first()
    parts = max(1, -(-rows // CHAIN_ROWS))
    # Two buckets beside those of time: of what is before an untimed leg, and of what is after one.
    before, after = F.lit(-(1 << 62)), F.lit(1 - (1 << 62))
    bucket = lambda us: F.floor(us / span)
    loose = lambda c: F.exists(c, lambda x: x["us"].isNull())

    def own(c: str) -> Column:
        """The buckets that a row with the anchors c looks into."""
        timed = F.array_distinct(F.transform(c, lambda x: bucket(x["us"])))
        return F.when(loose(c), F.array(after)).otherwise(F.concat(timed, F.array(before))) if untimed else timed

    def near(c: str) -> Column:
        """The buckets that the legs c are found in."""
        timed = F.array_distinct(F.flatten(F.transform(c, lambda x: F.array(*[bucket(x["us"]) + k for k in (-1, 0, 1)]))))
        return F.when(loose(c), F.array(after, before)).otherwise(F.concat(timed, F.array(after))) if untimed else timed

    def fits(anchor: Column, us: Column) -> Column:
        inside = F.abs(us - anchor) <= span
        return anchor.isNull() | us.isNull() | (inside & (us >= anchor) if ordered else inside)

    # Case and account are one key: a constant case would be dropped from the join, and the rows dealt once more.
    late = pairs.select(F.struct("case_id", F.col("src").alias("at")).alias("place"), F.col("dst").alias("to"), F.col("legs").alias("next"), F.explode(near("legs")).alias("bucket")).repartition(parts, "place", "bucket")
    one_each = (F.size("legs") == 1) & (F.size("next") == 1)
    x0, y0 = F.get("legs", F.lit(0)), F.get("next", F.lit(0))

    def extend(left: DataFrame) -> DataFrame:
        """left: case_id, at, legs, ...: joined with the legs that leave `at`; first: the least bucket that both are in."""
        keyed = left.withColumns({"place": F.struct("case_id", "at"), "own": own("legs")}).drop("case_id", "at").withColumn("bucket", F.explode("own"))
        met = keyed.repartition(parts, "place", "bucket").join(late.hint("merge"), ["place", "bucket"]).where(~one_each | fits(x0["us"], y0["us"]))
        return met.withColumn("first", (F.size("own") == 1) | (F.col("bucket") == F.array_min(F.array_intersect("own", near("next")))))

    def second(x: Column, y: Column) -> Column:
        return F.struct(x["id"].alias("i1"), y["id"].alias("i2"), (x["amount"] + y["amount"]).alias("amount"), F.coalesce(x["us"], y["us"]).alias("us"))

    def third(x: Column, y: Column) -> Column:
        return F.struct(x["i1"].alias("i1"), x["i2"].alias("i2"), y["id"].alias("i3"), x["us"].alias("first_us"), y["us"].alias("last_us"), (x["amount"] + y["amount"]).cast("double").alias("volume"))

    def followed(x: Column, by: Callable[[Column, Column], Column]) -> Column:
        return F.transform(F.filter("next", lambda y: fits(x["us"], y["us"])), lambda y: by(x, y))

    # Of the legs after a timed one the first is enough: it alone tells what fits next.
    legs = F.flatten(F.transform("legs", lambda x: F.when(x["us"].isNull(), followed(x, second)).otherwise(F.array_compact(F.array(F.array_min(followed(x, second)))))))
    legs = F.when(F.col("first"), F.when(one_each, F.array(second(x0, y0))).otherwise(legs))
    two = extend(pairs.select("case_id", F.col("dst").alias("at"), F.col("src").alias("a"), F.col("dst").alias("b"), "legs")).where("to <> a")
    two = two.select("place.case_id", F.col("to").alias("at"), "a", "b", F.explode(F.filter(F.array(legs), lambda z: F.size(z) > 0)).alias("legs"))
    pick = F.when(one_each, third(x0, y0)).otherwise(F.array_min(F.transform("legs", lambda x: F.array_min(followed(x, third)))))
    three = extend(two).where("to <> a AND to <> b").select("place.case_id", "a", "b", F.col("place.at").alias("c"), F.col("to").alias("d"), F.explode(F.array_compact(F.array(F.when(F.col("first"), pick)))).alias("pick"))
    return three.select("case_id", "a", "b", "c", "d", "pick.*")


def layering(transfers: DataFrame, hours: float = 48) -> DataFrame:
    c = chains(transfers, hours)
    score = 0.25 + 0.4 * sig(F.lit(3.0), 4, 0.8) + 0.35 * sig(F.col("volume"), 100_000, 5e-6)
    return c.select("case_id", "a", "b", "c", "d", "i1", "i2", "i3", "volume", clamp4(F.least(score, F.lit(1.0))).alias("score"), F.lit(0.6).alias("confidence"))


def rapid_hop(transfers: DataFrame, hours: float = 2) -> DataFrame:
    c = chains(transfers, hours).withColumn("hours", F.abs(F.col("last_us") - F.col("first_us")) / HOUR_US)
    score = F.least(0.35 + 0.35 * sig(F.lit(3.0), 4, 0.9) + 0.3 * sig(F.col("volume"), 50_000, 8e-6), F.lit(1.0))
    score = F.when(F.col("hours") < 1, F.least(score + 0.1, F.lit(1.0))).otherwise(score)
    return c.select("case_id", "a", "b", "c", "d", "i1", "i2", "i3", "volume", F.round("hours", 2).alias("hours"), clamp4(score).alias("score"), F.lit(0.65).alias("confidence"))


def comm_hub(calls: DataFrame, least: int = 4, ratio: float = 2.5) -> DataFrame:
    """PT-7a: callers with many more distinct receivers than the average caller of the case."""
    c = calls.where("caller IS NOT NULL AND receiver IS NOT NULL").groupBy("case_id", "caller").agg(F.countDistinct("receiver").alias("n"))
    mean = c.groupBy("case_id").agg(F.avg("n").alias("mean"))
    c = c.join(mean, "case_id").withColumn("ratio", F.col("n") / F.greatest("mean", F.lit(1.0))).where((F.col("n") >= least) & (F.col("ratio") >= ratio))
    score = F.least(0.6 * sig(F.col("ratio"), 3.75, 0.5) + 0.4 * sig(F.col("n").cast("double"), 8, 0.2), F.lit(1.0))
    return c.select("case_id", "caller", "n", F.round("ratio", 4).alias("ratio"), clamp4(score).alias("score"), F.lit(0.65).alias("confidence"))


def hub_edges(vertices: DataFrame, edges: DataFrame, rels: tuple[str, ...] = ("CALLED",), least: int = 4) -> DataFrame:
    """PT-7b: PHONE or PERSON vertices with many outgoing call edges."""
    out = edges.where(F.upper("rel").isin(*rels)).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    out = out.join(vertices.where(F.upper("type").isin(*S.PHONE_OR_PERSON)).select("id"), "id", "left_semi")
    return out.select("id", "n", clamp4(sig(F.col("n").cast("double"), 6, 0.3)).alias("score"), F.lit(0.5).alias("confidence"))


def neighbours(edges: DataFrame) -> DataFrame:
    """id, nbr in both directions: a neighbour linked both ways comes twice."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("id"), F.col("src").alias("nbr")))).alias("e")).select("e.*")


def _typed(vertices: DataFrame, types: tuple[str, ...], name: str) -> DataFrame:
    return vertices.where(F.upper("type").isin(*types)).select(F.col("id").alias(name))


def sim_swap(vertices: DataFrame, edges: DataFrame, transfers: DataFrame) -> DataFrame:
    """PT-1: SIMs of two or more phones or persons that reach accounts. Transfers count once for each way to the account."""
    n = neighbours(edges)
    per_account = legs(transfers).groupBy(F.col("account").alias("nbr")).agg(F.count("*").alias("tx"))
    accounts = n.join(_typed(vertices, S.ACCOUNT, "nbr"), "nbr", "left_semi").join(per_account, "nbr", "left")
    per_phone = accounts.groupBy(F.col("id").alias("nbr")).agg(F.count("*").alias("accounts"), F.coalesce(F.sum("tx"), F.lit(0)).alias("tx"))
    sims = n.join(_typed(vertices, S.SIM_SWAP, "id"), "id", "left_semi").join(_typed(vertices, S.PHONE_OR_PERSON, "nbr"), "nbr", "left_semi")
    got = sims.join(per_phone, "nbr", "left").groupBy("id").agg(F.count("*").alias("n_phones"), F.coalesce(F.sum("accounts"), F.lit(0)).alias("n_accounts"), F.coalesce(F.sum("tx"), F.lit(0)).alias("tx"))
    got = got.where("n_phones >= 2 AND n_accounts >= 1")
    score = F.least(sig(F.col("n_phones").cast("double"), 3, 1.2) + 0.3 * sig(F.col("tx").cast("double"), 3, 0.4), F.lit(1.0))
    return got.select("id", "n_phones", "n_accounts", "tx", clamp4(score).alias("score"), F.when(F.col("tx") > 0, 0.7).otherwise(0.6).alias("confidence"))


def _shared(vertices: DataFrame, edges: DataFrame, hubs: tuple[str, ...], of: tuple[str, ...], least: int) -> DataFrame:
    n = neighbours(edges).join(_typed(vertices, hubs, "id"), "id", "left_semi").join(_typed(vertices, of, "nbr"), "nbr", "left_semi")
    return n.groupBy("id").agg(F.countDistinct("nbr").alias("n")).where(F.col("n") >= least)


def shared_device(vertices: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """PT-4."""
    got = _shared(vertices, edges, S.DEVICE, (*S.ACCOUNT, "PERSON"), least)
    return got.select("id", "n", clamp4(sig(F.col("n").cast("double"), 4, 0.8)).alias("score"), F.when(F.col("n") >= 5, 0.7).otherwise(0.55).alias("confidence"))


def shared_sim(vertices: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """PT-5."""
    got = _shared(vertices, edges, S.SIM, (*S.ACCOUNT, "PERSON", "PHONE"), least)
    return got.select("id", "n", clamp4(sig(F.col("n").cast("double"), 3, 1.0)).alias("score"), F.lit(0.65).alias("confidence"))


def dense_clusters(cliques: DataFrame, vertices: DataFrame) -> DataFrame:
    """PT-9: scores maximal cliques (members array) by size, density (1 for a clique) and mean risk of those that have one."""
    m = cliques.select("members", F.explode("members").alias("id")).join(vertices.select("id", "risk"), "id", "left")
    m = m.groupBy("members").agg(F.coalesce(F.avg("risk"), F.lit(0.0)).alias("avg_risk")).withColumn("n", F.size("members"))
    score = F.least(0.5 * sig(F.col("n").cast("double"), 5, 0.6) + 0.3 + 0.2 * F.col("avg_risk"), F.lit(1.0))
    return m.select("members", "n", F.round("avg_risk", 4).alias("avg_risk"), clamp4(score).alias("score"), F.lit(0.75).alias("confidence"))


def findings(**found: DataFrame) -> DataFrame:
    """PT-10: findings of all detectors as (case_id, pattern, subject, score, confidence)."""
    subject = {"layering": ("a", "b", "c", "d"), "rapid_hop": ("a", "b", "c", "d"), "comm_hub": ("caller",), "velocity": ("account",), "mule": ("account",)}
    out = None
    for name, df in found.items():
        key: Column = F.array_join("members", ">") if "members" in df.columns else F.concat_ws(">", *subject.get(name, ("id",)))
        case = F.col("case_id") if "case_id" in df.columns else F.lit("c1")
        part = df.select(case.alias("case_id"), F.lit(name).alias("pattern"), key.alias("subject"), "score", "confidence")
        out = part if out is None else out.unionByName(part)
    return out


def time_range(evidence: DataFrame, *by: str) -> DataFrame:
    """PT-11: first and last time of evidence (us) per key, and the hours between them."""
    out = evidence.groupBy(*by).agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    return out.withColumn("span_hours", F.round((F.col("end_us") - F.col("start_us")) / HOUR_US, 2))


def analysis(found: DataFrame) -> DataFrame:
    """PT-12: one row per case: number of findings and of each pattern, and the highest score."""
    per = found.groupBy("case_id", "pattern").agg(F.count("*").alias("n"), F.max("score").alias("top"))
    return per.groupBy("case_id").agg(F.sum("n").alias("total"), F.max("top").alias("top_score"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "pattern", F.col("n").cast("string")))), ",").alias("by_pattern"))
