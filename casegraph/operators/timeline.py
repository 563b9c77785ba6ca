"""Unified event timeline: one row per event with timestamp text, type, entities, description, source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.functions.expr import blank_null, clean_time

COLUMNS = ("case_id", "event_id", "timestamp", "event_type", "entity_ids", "description", "source", "evidence_id")


def _event(rows: DataFrame, event_id: Column, time: Column, kind: str, entities: Column, text: Column, source: str, evidence: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    ids = F.filter(F.coalesce(entities, F.array().cast("array<string>")), lambda x: blank_null(x).isNotNull())
    return rows.select(
        F.col("case_id"), event_id.alias("event_id"), time.alias("timestamp"), F.lit(kind).alias("event_type"), ids.alias("entity_ids"), text.alias("description"), F.lit(source).alias("source"),
        (none if evidence is None else evidence.cast("string")).alias("evidence_id"),
    ).where("timestamp IS NOT NULL")


def _c(df: DataFrame, *names: str) -> Column:
    got = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*[blank_null(x) for x in got]) if got else F.lit(None).cast("string")


def _t(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def transaction_events(t: DataFrame) -> DataFrame:
    """TL-1."""
    src, dst = _c(t, "src_account", "src_id"), _c(t, "dst_account", "dst_id")
    text = F.concat(F.lit("Transaction "), _t(_c(t, "id")), F.lit(" | "), _t(src), F.lit(" → "), _t(dst), F.lit(" | "), F.coalesce(F.concat(F.lit("₹"), F.format_number("amount", 2)), F.lit("")))
    return _event(t, F.concat(F.lit("evt_tx_"), _t(_c(t, "id"))), clean_time(_c(t, "timestamp", "created_at")), "transaction", F.array(src, dst), text, "transactions", _c(t, "evidence_id"))


def call_events(c: DataFrame) -> DataFrame:
    """TL-2."""
    a, b = _c(c, "caller_id"), _c(c, "receiver_id")
    text = F.concat(F.lit("Call "), _t(a), F.lit(" → "), _t(b), F.lit(" | "), _t(_c(c, "duration_sec")), F.lit("s"))
    return _event(c, F.concat(F.lit("evt_call_"), _t(_c(c, "id"))), clean_time(_c(c, "timestamp")), "call", F.array(a, b), text, "call_records", _c(c, "evidence_id"))


def sim_events(s: DataFrame) -> DataFrame:
    """TL-3: issue; swap only where there is a swap date and a count above 0."""
    i = _c(s, "id")
    kyc = F.when(F.col("kyc_verified"), "verified").otherwise("unverified")
    issue = _event(s, F.concat(F.lit("evt_sim_issue_"), i), clean_time(_c(s, "issue_date", "created_at")), "sim_event", F.array(i, _c(s, "phone_id", "phone_number")), F.concat(F.lit("SIM "), i, F.lit(" issued | operator: "), _t(_c(s, "operator")), F.lit(" | KYC: "), kyc), "sims")
    swapped = s.where("swap_count > 0")
    swap = _event(swapped, F.concat(F.lit("evt_sim_swap_"), i), clean_time(_c(s, "last_swap_date")), "sim_event", F.array(i), F.concat(F.lit("SIM SWAP detected: "), i, F.lit(" | total swaps: "), F.col("swap_count").cast("string")), "sims")
    return issue.unionByName(swap)


def device_events(d: DataFrame) -> DataFrame:
    """TL-4: first seen; last seen only where it differs."""
    i, first, last = _c(d, "id"), _c(d, "first_seen", "created_at"), _c(d, "last_seen")
    name = F.concat_ws(" ", _c(d, "brand"), _c(d, "model"))
    seen = _event(d, F.concat(F.lit("evt_dev_first_"), i), clean_time(first), "device_association", F.array(i, _c(d, "registered_to")), F.concat(F.lit("Device first seen: "), name, F.lit(" (IMEI: "), _t(_c(d, "imei")), F.lit(") | owner: "), _t(_c(d, "registered_to"))), "devices")
    again = _event(d.where(F.coalesce(last != first, last.isNotNull())), F.concat(F.lit("evt_dev_last_"), i), clean_time(last), "device_association", F.array(i), F.concat(F.lit("Device last seen: "), name), "devices")
    return seen.unionByName(again)


def account_events(e: DataFrame) -> DataFrame:
    """TL-5."""
    rows = e.where(F.upper("type") == "BANK_ACCOUNT")
    text = F.concat(F.lit("Account entity extracted: "), _t(_c(e, "value", "entity_id")), F.lit(" | risk: "), F.coalesce(_c(e, "risk_score"), F.lit("N/A")))
    evidence = F.try_element_at("evidence_ids", F.lit(1)) if "evidence_ids" in e.columns else None
    return _event(rows, F.concat(F.lit("evt_acc_"), _c(e, "entity_id")), clean_time(_c(e, "extracted_at", "created_at")), "account_activity", F.array(_c(e, "entity_id")), text, "entities", evidence)


def case_events(c: DataFrame) -> DataFrame:
    """TL-6: opened, and closed where it is."""
    rows = c.withColumn("case_id", F.col("id"))
    title = F.coalesce(_c(c, "title"), F.col("id"))
    victims = F.col("victim_ids") if "victim_ids" in c.columns else F.array().cast("array<string>")
    opened = _event(rows, F.concat(F.lit("evt_case_open_"), F.col("id")), clean_time(_c(c, "created_at", "opened_date")), "case_event", victims, F.concat(F.lit("Case opened: "), title, F.lit(" | severity: "), _t(_c(c, "severity")), F.lit(" | pattern: "), _t(_c(c, "fraud_pattern"))), "cases")
    closed = _event(rows, F.concat(F.lit("evt_case_close_"), F.col("id")), clean_time(_c(c, "closed_at")), "case_event", F.array().cast("array<string>"), F.concat(F.lit("Case closed: "), title), "cases")
    return opened.unionByName(closed)


def evidence_events(e: DataFrame) -> DataFrame:
    """TL-7: an event of the case; 120 characters of the description."""
    text = F.concat(F.lit("Evidence collected: "), _t(_c(e, "type")), F.lit(" — "), F.substring(_t(_c(e, "description")), 1, 120))
    return _event(e, F.concat(F.lit("evt_ev_"), _t(_c(e, "id", "evidence_id"))), clean_time(_c(e, "collected_at", "created_at")), "case_event", F.array().cast("array<string>"), text, "evidence", _c(e, "id", "evidence_id"))


def build(**sources: DataFrame) -> DataFrame:
    """TL-9: the union of the sources given (transactions, calls, sims, devices, entities, cases, evidence)."""
    makers = {"transactions": transaction_events, "calls": call_events, "sims": sim_events, "devices": device_events, "entities": account_events, "cases": case_events, "evidence": evidence_events}
    out = None
    for k, (name, make) in enumerate(makers.items()):
        if name in sources:
            part = make(sources[name]).withColumn("source_ord", F.lit(k))
            out = part if out is None else out.unionByName(part)
    return out


def ordered(events: DataFrame) -> DataFrame:
    """TL-9: by the text of the timestamp, then source, then id."""
    return events.orderBy("timestamp", "source_ord", "event_id")


def counts(events: DataFrame, *by: str) -> DataFrame:
    """TL-10."""
    return events.groupBy(*by, "event_type").agg(F.count("*").alias("n"))


