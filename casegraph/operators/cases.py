"""Evidence, cases, audit log and the case brief."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegraph.functions.expr import blank_null, key12
from casegraph.sources.io import merge_updates, replace_case

# What a case may hold.
STATUSES = ("open", "under_investigation", "closed", "chargesheeted", "archived")
SEVERITIES = ("critical", "high", "medium", "low")
PATTERNS = ("sim_swap", "mule_network", "transaction_layering", "shared_device", "shared_sim", "communication_hub", "rapid_multi_hop", "legitimate", "unknown")
UPDATABLE = ("title", "description", "fraud_pattern", "severity", "status", "jurisdiction", "assigned_to", "total_loss_inr", "victim_ids", "suspect_ids", "tags")


def _any(df: DataFrame, *names: str, default: str = "") -> Column:
    got = [blank_null(F.col(n).cast("string")) for n in names if n in df.columns]
    return F.coalesce(*got, F.lit(default))


def _list(df: DataFrame, *names: str) -> Column:
    got = []
    for n in names:
        if n in df.columns:
            many = df.schema[n].dataType.typeName() == "array"
            got.append(F.when(F.size(n) > 0, F.col(n)) if many else F.when(blank_null(F.col(n)).isNotNull(), F.array(F.col(n))))
    return F.coalesce(*got, F.array().cast("array<string>"))


def evidence(raw: DataFrame) -> DataFrame:
    """EV-1: canonical evidence; alternates coalesce, scalars become lists, other columns stay in `extra`."""
    known = {"evidence_id", "id", "case_id", "source_file", "file_path", "timestamp", "collected_at", "created_at", "entities", "entity_ids", "relationships", "relationship_ids", "description", "type", "collected_by", "is_verified", "hash_sha256"}
    extra = [F.lit(x) if k == 0 else F.col(x).cast("string") for c in raw.columns if c not in known for k, x in enumerate((c, c))]
    verified = F.coalesce(F.col("is_verified"), F.lit(False)) if "is_verified" in raw.columns else F.lit(False)
    return raw.select(
        _any(raw, "evidence_id", "id").alias("evidence_id"), _any(raw, "case_id").alias("case_id"), _any(raw, "source_file", "file_path", "type").alias("source_file"), _any(raw, "timestamp", "collected_at", "created_at").alias("timestamp"),
        _list(raw, "entities", "entity_ids").alias("entities"), _list(raw, "relationships", "relationship_ids").alias("relationships"), _any(raw, "description").alias("description"), _any(raw, "type").alias("type"),
        _any(raw, "collected_by").alias("collected_by"), verified.alias("is_verified"), _any(raw, "hash_sha256").alias("hash_sha256"), (F.create_map(*extra) if extra else F.create_map().cast("map<string,string>")).alias("extra"),
    )


def chain(ev: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """EV-3: per evidence its entities and relationships (sorted lists of structs)."""
    e = ev.select("evidence_id", F.explode("entities").alias("entity_id")).join(entities.select("entity_id", "type", "value"), "entity_id")
    e = e.groupBy("evidence_id").agg(F.array_sort(F.collect_set(F.struct("entity_id", "type", "value"))).alias("entity_rows"))
    r = ev.select("evidence_id", F.explode("relationships").alias("relationship_id")).join(relationships.select("relationship_id", "relationship"), "relationship_id")
    r = r.groupBy("evidence_id").agg(F.array_sort(F.collect_set(F.struct("relationship_id", "relationship"))).alias("relationship_rows"))
    return ev.select("evidence_id", "case_id", "type").join(e, "evidence_id", "left").join(r, "evidence_id", "left")


def evidence_of(ev: DataFrame, case_id: str) -> DataFrame:
    """EV-2: the evidence of a case."""
    return ev.where(F.col("case_id") == case_id)


def search_evidence(ev: DataFrame, text: str) -> DataFrame:
    """EV-4."""
    return ev.where(F.contains(F.lower("type"), F.lit(text.lower())) | F.contains(F.lower("description"), F.lit(text.lower())))


def create_cases(rows: DataFrame, by: str, as_of: str) -> tuple[DataFrame, DataFrame]:
    """CS-1: (good, rejected with a reason): required title of at most 300, known severity, status and pattern, defaults filled in."""
    low = lambda n, d: F.lower(_any(rows, n, default=d))
    loss = F.coalesce(F.col("total_loss_inr").cast("string").try_cast("double"), F.lit(0.0)) if "total_loss_inr" in rows.columns else F.lit(0.0)
    out = rows.select(
        F.trim(_any(rows, "title")).alias("title"), F.trim(_any(rows, "description")).alias("description"), low("fraud_pattern", "unknown").alias("fraud_pattern"), low("severity", "medium").alias("severity"), low("status", "open").alias("status"),
        F.trim(_any(rows, "jurisdiction")).alias("jurisdiction"), F.trim(_any(rows, "assigned_to")).alias("assigned_to"), loss.alias("total_loss_inr"), *[_list(rows, c).alias(c) for c in ("victim_ids", "suspect_ids", "tags")],
        F.lit(by).alias("created_by"), F.lit(as_of).alias("created_at"), F.lit(as_of).alias("updated_at"), F.lit(None).cast("string").alias("closed_at"),
    )
    reason = F.when(F.col("title") == "", "title is required").when(F.length("title") > 300, "title is too long").when(~F.col("severity").isin(*SEVERITIES), "unknown severity")
    reason = reason.when(~F.col("status").isin(*STATUSES), "unknown status").when(~F.col("fraud_pattern").isin(*PATTERNS), "unknown pattern")
    out = out.withColumn("id", key12("case_", "title", "created_by", "created_at")).withColumn("reason", reason)
    return out.where("reason IS NULL").drop("reason"), out.where("reason IS NOT NULL")


def list_cases(cases: DataFrame, limit: int = 50, offset: int = 0, **equal: str) -> DataFrame:
    """CS-2: a page of cases, newest first, each with the total that matches; filters by equality."""
    for k, v in equal.items():
        cases = cases.where(F.col(k) == v)
    total = cases.agg(F.count("*").alias("total"))
    page = cases.orderBy(F.desc("created_at"), "id").offset(max(0, offset)).limit(max(1, min(500, limit)))
    return page.join(F.broadcast(total), F.lit(True))


def case_by_id(cases: DataFrame, case_id: str) -> DataFrame:
    """CS-3."""
    return cases.where(F.col("id") == case_id)


def update_cases(cases: DataFrame, updates: DataFrame, as_of: str) -> DataFrame:
    """CS-4: whitelisted fields of the updates with valid values; closed_at is set when a case first closes."""
    u = updates.select("id", *[c for c in updates.columns if c in UPDATABLE])
    for c, known in (("status", STATUSES), ("severity", SEVERITIES), ("fraud_pattern", PATTERNS)):
        if c in u.columns:
            u = u.where(F.col(c).isNull() | F.col(c).isin(*known))
    out = merge_updates(cases, u, as_of)
    return out.withColumn("closed_at", F.when((F.col("status") == "closed") & F.col("closed_at").isNull(), F.lit(as_of)).otherwise(F.col("closed_at")))


def dashboard(cases: DataFrame) -> DataFrame:
    """CS-5."""
    n = lambda c: F.count(F.when(c, 1))
    return cases.agg(F.count("*").alias("cases"), n(F.col("status").isin("open", "under_investigation")).alias("active"), n(F.col("severity").isin("critical", "high")).alias("severe"), F.coalesce(F.sum(F.col("total_loss_inr").cast("decimal(18,2)")), F.lit(0)).cast("double").alias("loss"))


def browse_entities(entities: DataFrame, kind: str | None = None, text: str = "") -> DataFrame:
    """CS-6."""
    rows = entities.where(F.upper("type") == kind.upper()) if kind else entities
    hit = F.lit(False)
    for c in ("value", "label"):
        if c in entities.columns:
            hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return rows.where(hit) if text else rows


def audit_page(log: DataFrame, user: str | None = None, action: str | None = None, case_id: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """AU-1: newest first; user and case by equality, action by prefix."""
    if user:
        log = log.where(F.col("user") == user)
    if action:
        log = log.where(F.startswith("action", F.lit(action)))
    if case_id:
        log = log.where(F.col("case_id") == case_id)
    return log.orderBy(F.desc("seq")).offset(offset).limit(limit)


def audit_compact(log: DataFrame, most: int = 50_000, drop: int = 25_000) -> DataFrame:
    """AU-2: where the log has reached `most` rows, all but the `drop` oldest (those below a cut of seq; seq is unique)."""
    n = log.count()
    if n < most:
        return log
    cut = log.select("seq").orderBy("seq").offset(drop).limit(1).first()[0]
    return log.where(F.col("seq") >= cut)


def brief(cases: DataFrame, findings: DataFrame, events: DataFrame, roles: DataFrame, predictions: DataFrame, ev: DataFrame, entities: DataFrame, sizes: DataFrame) -> DataFrame:
    """CB-1 to CB-10: one row per case with all sections. Inputs carry case_id; sizes: case_id, nodes, edges.

    Every section folds to one row per case before it joins, and lists are cut by rank (10 or 20) before they are
    collected, so no case needs more than its sections.
    """
    ids = cases.select(F.col("id").alias("case_id"), "title", "status", "severity", "fraud_pattern", "total_loss_inr", "victim_ids")
    pat = findings.groupBy("case_id").agg(F.count("*").alias("findings"), F.array_sort(F.collect_set("pattern")).alias("pattern_names"), F.max("score").alias("top_score"))
    kinds = events.groupBy("case_id", "event_type").agg(F.count("*").alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    line = kinds.groupBy("case_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("event_counts"), F.min("lo").alias("first_event"), F.max("hi").alias("last_event"))
    tally = roles.groupBy("case_id", "primary_role").agg(F.count("*").alias("n")).groupBy("case_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("primary_role", "n")))).alias("role_counts"))
    top = lambda df, n, *order: df.withColumn("_n", F.row_number().over(Window.partitionBy("case_id").orderBy(*order))).where(F.col("_n") <= n)
    best = top(roles, 20, F.desc("role_score"), "id").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("_n", "id", "primary_role", "role_score"))).alias("top_roles"))
    high = F.col("classification").isin("HIGH", "MEDIUM")
    runs = predictions.groupBy("case_id").agg(F.count("*").alias("predictions"), F.count(F.when(high, 1)).alias("high_risk"), F.min_by("model_version", "timestamp").alias("model_version"))
    risky = top(predictions.where(high), 10, F.desc("risk_score"), "entity_id").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("_n", "entity_id", "risk_score"))).alias("high_risk_entities"))
    cited = findings.select("case_id", F.explode("evidence_ids").alias("evidence_id")).distinct().withColumn("cited", F.lit(1))
    rank = 10 * F.col("is_verified").cast("int") + 5 * F.coalesce("cited", F.lit(0))
    key = top(ev.join(cited, ["case_id", "evidence_id"], "left").withColumn("rank", rank), 10, F.desc("rank"), "evidence_id").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("_n", "evidence_id", "rank"))).alias("key_evidence"))
    victims = ids.select("case_id", F.explode("victim_ids").alias("entity_id")).join(entities.where(F.upper("type").isin("VICTIM", "PERSON")).select("entity_id", "value"), "entity_id")
    victims = victims.groupBy("case_id").agg(F.array_sort(F.collect_set("value")).alias("victims"))
    out = ids
    for part in (pat, victims, line, tally, best, runs, risky, key, sizes):
        out = out.join(part, "case_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("findings", "predictions", "high_risk", "nodes", "edges")}
    out = out.withColumns(zero)
    note = F.format_string("Case %s: %d findings, loss %.2f.", F.coalesce("title", "case_id"), "findings", F.coalesce("total_loss_inr", F.lit(0.0)))
    return out.withColumn("note", note)


def save_briefs(briefs: DataFrame, path: str) -> None:
    """CB-10, IO-19: one JSON document per case, replacing those of the same cases."""
    replace_case(briefs.select("case_id", F.to_json(F.struct(*briefs.columns)).alias("document")), path)


def stored_briefs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CB-10: the briefs that save_briefs stored, with all their sections. schema: of the briefs."""
    return spark.read.parquet(path).select(F.from_json("document", schema).alias("b")).select("b.*")
