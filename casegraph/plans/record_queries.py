"""Queries over text, records, timelines, evidence, cases and audit rows, made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegraph.functions.scratch import materialise, scratch_path
from casegraph.operators import cases as C
from casegraph.operators import entitystore as U
from casegraph.operators import extract as E
from casegraph.operators import resolve as R
from casegraph.operators import timeline as T
from casegraph.plans.driver_views import spread, table
from casegraph.sources import ingest as I
from casegraph.sources import io as O



def narratives(spark, d):
    """A narrative per customer, with one mention of every kind."""
    k = F.col("c_custkey")
    s = k.cast("string")
    pad = lambda n: F.lpad(s, n, "0")
    even = k % 2 == 0
    text = F.concat(
        F.lit("The victim Ramesh Kumar said +91-9"), pad(9), F.lit(" called 8"), pad(9), F.lit(" from Pune City. Paid to user"), s, F.lit("@OKAXIS and HDFC0"), pad(6), F.lit(" by TXN"), pad(10),
        F.lit(". Device "), pad(15), F.lit(" sim 89"), pad(17), F.when(even, " ip 203.0.113.").otherwise(" ip 10.0.0."), (k % 250).cast("string"), F.lit(" in FIR/"), pad(4), F.lit("/2024."),
    )
    return spread(table(spark, d, "customer").select("c_custkey"), "c_custkey").select(k.alias("doc_id"), text.alias("text"), F.concat(F.lit("c"), (k % 50).cast("string")).alias("case_id"), F.concat(F.lit("e"), (k % 80).cast("string")).alias("evidence_id"))


def extract_ip(spark, d):
    m = E.mentions(table(spark, d, "documents").select("doc_id", "text"), tuple(r for r in E.RULES if r.type == "IP_ADDRESS"))
    return m.select("doc_id", "pos", "value")


def extract_narrative(spark, d):
    good, _ = E.validate_entities(E.mentions(narratives(spark, d)))
    return good.select("doc_id", "type", "value", "confidence", "evidence_source")


def capped_mentions(spark, d):
    return E.cap(E.mentions(narratives(spark, d)), 6, 0.7).select("doc_id", "type", "value")


def relations(spark, d):
    docs = narratives(spark, d)
    return E.relationships(docs, E.mentions(docs)).select("doc_id", "source_type", "source_value", "relationship", "target_type", "target_value", "confidence")


def merge_entities(spark, d):
    entities, _, _ = R.pipeline(narratives(spark, d))
    return entities.select("type", "value", "confidence", "mentions", F.array_join("evidence_ids", ",").alias("evidence_ids"), F.array_join("case_ids", ",").alias("case_ids"))


def entities_in_batches(spark, d):
    """The entities of the narratives, merged into a store in three batches, the last third first."""
    docs, path = narratives(spark, d), scratch_path(spark)
    good, _ = E.validate_entities(E.mentions(docs, keep=R.META))
    rows = materialise(good.withColumn("seq", F.struct("doc_id", "rule_no", "pos")))
    for k in (2, 0, 1):
        U.upsert(spark, path, rows.where(F.col("doc_id") % 3 == k))
    entities = U.entities(spark, path, U.states(rows))
    return entities.select("type", "value", "confidence", "mentions", F.array_join("evidence_ids", ",").alias("evidence_ids"), F.array_join("case_ids", ",").alias("case_ids"))


def _with_keys(edges, entities):
    end = lambda e: entities.select(F.col("entity_id").alias(f"{e}_entity"), F.col("key").alias(e))
    return edges.join(end("source").hint("merge"), "source_entity").join(end("target").hint("merge"), "target_entity").select("source", "relationship", "target", "confidence", "mentions")


def merge_edges(spark, d):
    entities, edges, _ = R.pipeline(narratives(spark, d))
    return _with_keys(edges, entities)


def edges_in_batches(spark, d):
    """Entities and relationships of the narratives, merged into two stores in three batches, the last third first: the ends of a
    batch's relationships are looked up in the store of entities as it then is."""
    docs, of_entities, of_edges = narratives(spark, d), scratch_path(spark), scratch_path(spark)
    for k in (2, 0, 1):
        batch = docs.where(F.col("doc_id") % 3 == k)
        good, _ = E.validate_entities(E.mentions(batch, keep=R.META))
        rows = materialise(good.withColumn("seq", F.struct("doc_id", "rule_no", "pos")))
        linked, _ = E.validate_relationships(E.relationships(batch, rows, R.META))
        U.upsert(spark, of_entities, rows)
        linked = U.resolve_endpoints(spark, of_entities, linked, U.states(rows))
        U.upsert(spark, of_edges, linked, U.EDGES)
    return _with_keys(U.relationships(spark, of_edges, U.edge_states(linked)), U.entities(spark, of_entities, U.states(rows)))


def answers(spark, d):
    """A model's answer for each customer: types and relationships that are not known, values that are blank, confidences that are no number."""
    k, name = F.col("c_custkey"), F.col("c_name")
    nine = F.lpad(k.cast("string"), 9, "0")
    sim = F.concat(F.lit("89"), F.lpad(k.cast("string"), 17, "0"))
    struct = lambda **c: F.struct(*[(x if isinstance(x, F.Column) else F.lit(x).cast("string")).alias(n) for n, x in c.items()])
    person = struct(type=F.when(k % 5 == 0, "Alien").otherwise("person"), value=name, raw_value=None, confidence=F.when(k % 4 == 0, "high").otherwise((k % 10 / 10).cast("string")))
    phone = struct(type="PHONE", value=None, raw_value=F.when(k % 7 == 0, " ").otherwise(F.concat(F.lit("+91-9"), nine)), confidence="1.7")
    link = lambda source, rel, kind, target, confidence: struct(source_type="PERSON", source_value=source, relationship=rel, target_type=kind, target_value=target, confidence=confidence)
    links = F.array(
        link(name, "owns", "PHONE", F.concat(F.lit("9"), nine), None), link(name, F.when(k % 6 == 0, "LIKES").otherwise("USES"), "SIM", sim, F.when(k % 8 == 0, "0.2").otherwise("0.9")),
        link(F.when(k % 9 == 0, "").otherwise(name), "OWNS", "GHOST", "x", None),
    )
    body = F.to_json(F.struct(F.array(person, phone, struct(type="SIM", value=sim, raw_value=None, confidence=None)).alias("entities"), links.alias("relationships")))
    text = F.when(k % 2 == 0, F.concat(F.lit("Found: "), body, F.lit(" and no more"))).otherwise(body)
    return table(spark, d, "customer").select(k.alias("doc_id"), text.alias("response"), F.concat(F.lit("c"), (k % 50).cast("string")).alias("case_id"), F.concat(F.lit("e"), (k % 80).cast("string")).alias("evidence_id"))


def answers_edges(spark, d):
    entities, edges, _ = R.answers_pipeline(answers(spark, d))
    return _with_keys(edges, entities)


def answers_warnings(spark, d):
    return R.answers_pipeline(answers(spark, d))[2]


def merge_counts(spark, d):
    docs = narratives(spark, d)
    good = materialise(E.validate_entities(E.mentions(docs, keep=R.META))[0])
    store = R.merge_entities(good.where("doc_id % 3 = 0").withColumn("seq", F.struct("doc_id", "rule_no", "pos")))
    return R.merge_counts(store, good)


def raw_transactions(spark, d):
    """Orders as rows of text in a mixed layout: two names for the sender, day-first dates, amounts with separators."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.cast("string").alias("id"), F.when(k % 3 == 0, F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).otherwise(" ").alias("Src_Account"), F.concat(F.lit("K"), F.col("o_custkey").cast("string")).alias("sender_account"),
        F.concat(F.lit("S"), (k % 100).cast("string")).alias("to"), F.concat(F.lit("₹"), F.format_number(F.floor("o_totalprice"), 0)).alias("txn_amount"), F.col("o_orderpriority").alias("mode"), F.date_format("o_orderdate", "d/M/yyyy").alias("date"),
    )


def norm_tx(spark, d):
    return I.normalise(raw_transactions(spark, d)).select("id", "src_account", "dst_account", "amount", "currency", "method", "timestamp")


def norm_calls(spark, d):
    e = table(spark, d, "events")
    raw = e.select(F.col("user_id").cast("string").alias("a_party"), F.get_json_object("props", "$.k").alias("b_party"), F.concat(F.floor("value").cast("string"), F.when(F.col("event_id") % 4 == 0, "sec").otherwise("s")).alias("dur"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("datetime"), F.col("event_id").cast("string").alias("id"))
    return I.normalise(raw, "calls").select("id", "caller_id", "receiver_id", "duration_sec", "call_type", "timestamp")


def detect_type(spark, d):
    pages = table(spark, d, "part").select("p_partkey", F.array(F.element_at(F.array(*[F.lit(x) for x in ("IMEI", "iccid", "vpa", "caller", "ifsc", "fir", "lat", "msisdn", "debit", "other")]), (F.col("p_partkey") % 10 + 1).cast("int")), F.lit("date")).alias("header"))
    return pages.select("p_partkey", I.detect_type_of(F.col("header")).alias("record_type"))


def manifest(spark, d):
    rows = table(spark, d, "orders").select(F.concat(F.lit("f"), (F.col("o_custkey") % 20).cast("string")).alias("source_file"), F.date_format("o_orderdate", "yyyy").alias("case_id"), F.lit("transactions").alias("record_type"), F.when(F.col("o_orderkey") % 9 == 0, "bad").alias("error"))
    return I.manifest(rows)


def load_transfers(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    out = O.load_transfers(o.where("o_orderstatus <> 'F'").drop("o_orderstatus"), o.where("o_orderstatus = 'F'"))
    return out.groupBy("is_fraud_tx", "o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


def live_or_sample(spark, d):
    """Open orders of a customer are live; customers without any get their others."""
    o = table(spark, d, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("case_id"), "o_orderkey", "o_orderstatus")
    return O.live_or_sample(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus <> 'O'")).select("case_id", "o_orderkey")


def merge_updates(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("severity"))
    u = o.where("id % 5 = 0").select("id", F.when(F.col("id") % 2 == 0, "closed").alias("status"))
    return O.merge_updates(o, u, "2024-01-01T00:00:00Z")


def _time(c):
    return F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def cases(spark, d):
    """A case per customer."""
    k = F.col("c_custkey")
    pick = lambda of: F.element_at(F.array(*[F.lit(x) for x in of]), (k % len(of) + 1).cast("int"))
    return table(spark, d, "customer").select(
        F.concat(F.lit("c"), k.cast("string")).alias("id"), F.col("c_name").alias("title"), pick(C.STATUSES).alias("status"), pick(C.SEVERITIES).alias("severity"), pick(C.PATTERNS).alias("fraud_pattern"), F.col("c_acctbal").alias("total_loss_inr"),
        F.array(F.concat(F.lit("v"), k.cast("string"))).alias("victim_ids"), F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("created_at"), F.when(pick(C.STATUSES) == "closed", "2024-03-01T00:00:00+00:00Z").alias("closed_at"),
    )


def timeline_events(spark, d):
    e = table(spark, d, "events")
    i, a, b = F.col("event_id").cast("string"), F.concat(F.lit("A"), F.col("user_id").cast("string")), F.concat(F.lit("A"), F.get_json_object("props", "$.k"))
    case = F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("case_id")
    tx = e.where("event_type = 'purchase'").select(i.alias("id"), case, a.alias("src_account"), b.alias("dst_account"), F.col("value").alias("amount"), _time("ts").alias("timestamp"))
    calls = e.where("event_type IN ('click', 'view')").select(i.alias("id"), case, a.alias("caller_id"), b.alias("receiver_id"), F.floor("value").alias("duration_sec"), _time("ts").alias("timestamp"))
    return T.build(transactions=tx, calls=calls, cases=cases(spark, d))


def timeline(spark, d):
    out = timeline_events(spark, d)
    return out.select("case_id", "event_id", "timestamp", "event_type", F.array_join("entity_ids", ",").alias("entity_ids"), "source")


def timeline_counts(spark, d):
    return T.counts(timeline_events(spark, d), "case_id")


def evidence_rows(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.concat(F.lit("ev"), F.col("o_orderkey").cast("string")).alias("id"), F.date_format("o_orderdate", "yyyy").alias("case_id"), F.col("o_orderpriority").alias("type"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("entity_ids"), F.lit("order").alias("description"), (F.col("o_orderkey") % 3 == 0).alias("is_verified"), F.array(F.concat(F.lit("R"), (F.col("o_orderkey") % 10).cast("string"))).alias("relationship_ids"))


def evidence_chain(spark, d):
    ev = C.evidence(evidence_rows(spark, d))
    entities = table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("entity_id"), F.lit("PERSON").alias("type"), F.col("c_name").alias("value"))
    rels = table(spark, d, "nation").select(F.concat(F.lit("R"), F.col("n_nationkey").cast("string")).alias("relationship_id"), F.col("n_name").alias("relationship"))
    out = C.chain(ev, entities, rels)
    names = lambda c, x: F.array_join(F.transform(c, lambda s: s[x]), ",")
    return out.select("evidence_id", "type", names("entity_rows", "value").alias("entities"), names("relationship_rows", "relationship").alias("relationships"))


def cases_page(spark, d):
    return C.list_cases(cases(spark, d), 25, 10, severity="high").select("id", "title", "status", "created_at", "total")


def cases_dashboard(spark, d):
    return C.dashboard(cases(spark, d))


def audit_page(spark, d):
    e = table(spark, d, "events")
    log = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("user"), F.concat("event_type", F.lit(".run")).alias("action"), F.concat(F.lit("c"), (F.col("user_id") % 50).cast("string")).alias("case_id"))
    return C.audit_page(log, user="u3", action="cl", limit=40, offset=5)


def browse(spark, d):
    e = table(spark, d, "customer").select(F.col("c_custkey"), F.lit("PERSON").alias("type"), F.col("c_name").alias("value"))
    return C.browse_entities(e, "person", "99").select("c_custkey", "value")


def _briefs(spark, d):
    c = cases(spark, d)
    events = timeline_events(spark, d)
    e = table(spark, d, "events")
    case = F.concat(F.lit("c"), F.col("user_id").cast("string"))
    found = e.groupBy(case.alias("case_id"), F.col("event_type").alias("pattern")).agg(F.round(F.max("value") / 1000, 4).alias("score"), F.array(F.concat(F.lit("ev"), F.min("event_id").cast("string"))).alias("evidence_ids"))
    roles = e.groupBy(case.alias("case_id"), F.col("user_id").cast("string").alias("id")).agg(F.max_by("event_type", "event_id").alias("primary_role"), F.round(F.max("value") / 1000, 4).alias("role_score"))
    pred = roles.select("case_id", F.col("id").alias("entity_id"), F.col("role_score").alias("risk_score"), F.when(F.col("role_score") > 0.095, "HIGH").otherwise("LOW").alias("classification"), F.lit("v1").alias("model_version"), F.lit("t").alias("timestamp"))
    ev = e.select(case.alias("case_id"), F.concat(F.lit("ev"), F.col("event_id").cast("string")).alias("evidence_id"), (F.col("event_id") % 3 == 0).alias("is_verified"))
    ents = table(spark, d, "customer").select(F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("entity_id"), F.lit("VICTIM").alias("type"), F.col("c_name").alias("value"))
    sizes = e.groupBy(case.alias("case_id")).agg(F.countDistinct("user_id").alias("nodes"), F.count("*").alias("edges"))
    return C.brief(c, found, events, roles, pred, ev, ents, sizes)


def _sections(out):
    return out.select("case_id", "findings", F.array_join("pattern_names", ",").alias("pattern_names"), F.array_join("victims", ",").alias("victims"), "first_event", "last_event", "predictions", "high_risk", "nodes", "edges", F.size("top_roles").alias("n_roles"), F.size("key_evidence").alias("n_evidence"), F.element_at("top_roles", 1)["id"].alias("top_role"))


def brief_sections(spark, d):
    return _sections(_briefs(spark, d))


def briefs_read_back(spark, d):
    """The whole briefs of all cases, stored as one document each and read back."""
    path, made = scratch_path(spark), _briefs(spark, d)
    C.save_briefs(made, path)
    return _sections(C.stored_briefs(spark, path, made.schema))


# Oracle texts.
_N = """narr AS (SELECT c_custkey AS doc_id, 'c' || (c_custkey % 50) AS case_id, 'e' || (c_custkey % 80) AS evidence_id, 'The victim Ramesh Kumar said +91-9' || lpad(c_custkey::VARCHAR, 9, '0') || ' called 8' || lpad(c_custkey::VARCHAR, 9, '0') ||
  ' from Pune City. Paid to user' || c_custkey || '@OKAXIS and HDFC0' || lpad(c_custkey::VARCHAR, 6, '0') || ' by TXN' || lpad(c_custkey::VARCHAR, 10, '0') || '. Device ' || lpad(c_custkey::VARCHAR, 15, '0') || ' sim 89' ||
  lpad(c_custkey::VARCHAR, 17, '0') || CASE WHEN c_custkey % 2 = 0 THEN ' ip 203.0.113.' ELSE ' ip 10.0.0.' END || (c_custkey % 250) || ' in FIR/' || lpad(c_custkey::VARCHAR, 4, '0') || '/2024.' AS text FROM customer)"""
_M = """found AS (SELECT doc_id, text, case_id, evidence_id, unnest([
  {r: 0, type: 'PHONE', c: 0.92, s: 'observed', h: regexp_extract_all(text, '\\b[6-9]\\d{9}\\b')}, {r: 1, type: 'IMEI', c: 0.88, s: 'observed', h: regexp_extract_all(text, '\\b\\d{15}\\b')},
  {r: 2, type: 'SIM', c: 0.85, s: 'observed', h: regexp_extract_all(text, '\\b89\\d{17,18}\\b')}, {r: 3, type: 'UPI_ID', c: 0.95, s: 'observed', h: list_transform(regexp_extract_all(text, '\\b[\\w.-]+@OKAXIS\\b'), lambda x: lower(x))},
  {r: 4, type: 'BANK_ACCOUNT', c: 0.72, s: 'observed', h: regexp_extract_all(text, '\\b[A-Z]{4}0[A-Z0-9]{6}\\b')}, {r: 5, type: 'TRANSACTION', c: 0.89, s: 'observed', h: regexp_extract_all(text, '\\bTXN[A-Z0-9]{8,20}\\b')},
  {r: 6, type: 'CASE', c: 0.93, s: 'observed', h: regexp_extract_all(text, '\\bFIR/\\d{3,}/\\d{4}\\b')}, {r: 7, type: 'IP_ADDRESS', c: 0.82, s: 'observed', h: regexp_extract_all(text, '\\b203\\.0\\.113\\.\\d{1,3}\\b')},
  {r: 8, type: 'VICTIM', c: 0.78, s: 'observed', h: ['Ramesh Kumar']}, {r: 10, type: 'LOCATION', c: 0.65, s: 'inferred', h: ['Pune City']}]) AS f FROM narr),
men AS (SELECT doc_id, text, case_id, evidence_id, f.r AS rule_no, f.type AS type, f.c::DOUBLE AS confidence, f.s AS evidence_source, unnest(f.h) AS value FROM found)"""
_L = """ents AS (SELECT DISTINCT doc_id, text, case_id, evidence_id, type, value, CASE WHEN type = 'UPI_ID' THEN instr(lower(text), value) ELSE instr(text, value) END AS at_pos FROM men),
rules(st, rel, tt, far, c) AS (VALUES ('VICTIM', 'OWNS', 'PHONE', 150, 0.72), ('VICTIM', 'OWNS', 'BANK_ACCOUNT', 200, 0.68), ('VICTIM', 'OWNS', 'UPI_ID', 200, 0.75), ('VICTIM', 'USED_DEVICE', 'IMEI', 250, 0.66), ('VICTIM', 'VICTIM_OF', 'CASE', 100000, 0.80),
  ('UPI_ID', 'TRANSFERRED_TO', 'BANK_ACCOUNT', 200, 0.69), ('VICTIM', 'LOCATED_AT', 'LOCATION', 300, 0.61), ('TRANSACTION', 'PART_OF', 'CASE', 500, 0.77)),
rel AS (SELECT a.doc_id, a.case_id, a.evidence_id, a.type AS source_type, a.value AS source_value, rel AS relationship, b.type AS target_type, b.value AS target_value, c::DOUBLE AS confidence
  FROM ents a JOIN rules ON a.type = st JOIN ents b ON b.doc_id = a.doc_id AND b.type = tt WHERE a.at_pos > 0 AND b.at_pos > 0 AND abs(a.at_pos - b.at_pos) < far
  UNION ALL SELECT doc_id, case_id, evidence_id, 'PHONE', '9' || lpad(doc_id::VARCHAR, 9, '0'), 'CALLED', 'PHONE', '8' || lpad(doc_id::VARCHAR, 9, '0'), 0.91 FROM narr)"""
_CASES = """cs AS (SELECT 'c' || c_custkey AS id, c_name AS title, ['open', 'under_investigation', 'closed', 'chargesheeted', 'archived'][c_custkey % 5 + 1] AS status, ['critical', 'high', 'medium', 'low'][c_custkey % 4 + 1] AS severity,
  c_acctbal AS loss, '2024-01-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') AS created_at FROM customer)"""
_EV = """ev AS (SELECT event_id, 'c' || user_id AS case_id, 'A' || user_id AS a, 'A' || (props->>'k') AS b, event_type, value, user_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS t FROM events)"""
_TL = f"""{_CASES}, {_EV}, tl AS (SELECT case_id, 'evt_tx_' || event_id AS event_id, t AS timestamp, 'transaction' AS event_type, a || ',' || b AS entity_ids, 'transactions' AS source FROM ev WHERE event_type = 'purchase'
  UNION ALL SELECT case_id, 'evt_call_' || event_id, t, 'call', a || ',' || b, 'call_records' FROM ev WHERE event_type IN ('click', 'view')
  UNION ALL SELECT id, 'evt_case_open_' || id, created_at || 'T00:00:00Z', 'case_event', 'v' || id[2:], 'cases' FROM cs UNION ALL SELECT id, 'evt_case_close_' || id, '2024-03-01T00:00:00Z', 'case_event', '', 'cases' FROM cs WHERE status = 'closed')"""

QUERIES = {
    "extract_ip": extract_ip, "extract_narrative": extract_narrative, "capped_mentions": capped_mentions, "relations": relations, "merge_entities": merge_entities, "entities_in_batches": entities_in_batches, "merge_edges": merge_edges, "edges_in_batches": edges_in_batches, "answers_edges": answers_edges, "answers_warnings": answers_warnings, "merge_counts": merge_counts,
    "norm_tx": norm_tx, "norm_calls": norm_calls, "detect_type": detect_type, "manifest": manifest, "load_transfers": load_transfers, "live_or_sample": live_or_sample, "merge_updates": merge_updates, "timeline": timeline,
    "timeline_counts": timeline_counts, "evidence_chain": evidence_chain, "cases_page": cases_page, "cases_dashboard": cases_dashboard, "audit_page": audit_page, "browse": browse, "brief_sections": brief_sections, "briefs_read_back": briefs_read_back,
}
ORACLES = {
    "extract_ip": r"""SELECT * FROM (SELECT doc_id, (generate_subscripts(h, 1) - 1)::INTEGER AS pos, unnest(h) AS value FROM (SELECT doc_id, regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b') AS h FROM documents))
      WHERE NOT regexp_matches(value, '^(10|172\.(1[6-9]|2\d|3[01])|192\.168)\.')""",
    "extract_narrative": f"WITH {_N}, {_M} SELECT doc_id, type, value, confidence, evidence_source FROM men",
    "capped_mentions": f"WITH {_N}, {_M} SELECT doc_id, type, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rule_no, value DESC) AS k FROM men) WHERE k <= 6 AND confidence >= 0.7",
    "relations": f"WITH {_N}, {_M}, {_L} SELECT doc_id, source_type, source_value, relationship, target_type, target_value, confidence FROM rel",
    "merge_entities": f"WITH {_N}, {_M} SELECT type, value, max(confidence) AS confidence, count(*) AS mentions, string_agg(DISTINCT evidence_id, ',' ORDER BY evidence_id) AS evidence_ids, string_agg(DISTINCT case_id, ',' ORDER BY case_id) AS case_ids FROM men GROUP BY type, value",
    "merge_edges": f"WITH {_N}, {_M}, {_L} SELECT source_type || '::' || upper(source_value) AS source, relationship, target_type || '::' || upper(target_value) AS target, max(confidence) AS confidence, count(*) AS mentions FROM rel GROUP BY 1, 2, 3",
    "merge_counts": f"WITH {_N}, {_M}, k AS (SELECT type, upper(value) AS v, count(*) AS n, bool_or(doc_id % 3 = 0) AS known FROM men GROUP BY 1, 2) SELECT count(*) FILTER (NOT known) AS new, (sum(n) - count(*) FILTER (NOT known))::BIGINT AS merged FROM k",
    "norm_tx": "SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'C' ELSE 'K' END || o_custkey AS src_account, 'S' || (o_orderkey % 100) AS dst_account, floor(o_totalprice)::DOUBLE AS amount, 'INR' AS currency, o_orderpriority AS method, strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS timestamp FROM orders",
    "norm_calls": "SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS caller_id, props->>'k' AS receiver_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE floor(value)::INTEGER END AS duration_sec, 'unknown' AS call_type, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp FROM events",
    "detect_type": "SELECT p_partkey, ['devices', 'sims', 'upi_ids', 'calls', 'bank_accounts', 'complaints', 'locations', 'phones', 'transactions', 'unknown'][p_partkey % 10 + 1] AS record_type FROM part",
    "manifest": "SELECT 'f' || (o_custkey % 20) AS source_file, strftime(o_orderdate, '%Y') AS case_id, 'transactions' AS record_type, count(*) AS total_rows, count(*) FILTER (o_orderkey % 9 <> 0) AS normalised, count(*) FILTER (o_orderkey % 9 = 0) AS skipped FROM orders GROUP BY 1, 2",
    "load_transfers": "SELECT (o_orderstatus = 'F')::INTEGER AS is_fraud_tx, CASE WHEN o_orderstatus = 'F' THEN 'F' END AS o_orderstatus, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders GROUP BY 1, 2",
    "live_or_sample": "WITH o AS (SELECT 'C' || o_custkey AS case_id, o_orderkey, o_orderstatus FROM orders) SELECT case_id, o_orderkey FROM o WHERE o_orderstatus = 'O' OR case_id NOT IN (SELECT case_id FROM o WHERE o_orderstatus = 'O')",
    "merge_updates": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'closed' ELSE o_orderstatus END AS status, o_orderpriority AS severity, CASE WHEN o_orderkey % 5 = 0 THEN '2024-01-01T00:00:00Z' END AS updated_at FROM orders",
    "timeline": f"WITH {_TL} SELECT * FROM tl", "timeline_counts": f"WITH {_TL} SELECT case_id, event_type, count(*) AS n FROM tl GROUP BY 1, 2",
    "evidence_chain": "SELECT 'ev' || o_orderkey AS evidence_id, o_orderpriority AS type, c_name AS entities, n_name AS relationships FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = o_orderkey % 10",
    "cases_page": f"WITH {_CASES} SELECT id, title, status, created_at, count(*) OVER () AS total FROM cs WHERE severity = 'high' ORDER BY created_at DESC, id LIMIT 25 OFFSET 10",
    "cases_dashboard": f"WITH {_CASES} SELECT count(*) AS cases, count(*) FILTER (status IN ('open', 'under_investigation')) AS active, count(*) FILTER (severity IN ('critical', 'high')) AS severe, sum(loss::DECIMAL(18,2))::DOUBLE AS loss FROM cs",
    "audit_page": "SELECT event_id AS seq, 'u' || (user_id % 10) AS user, event_type || '.run' AS action, 'c' || (user_id % 50) AS case_id FROM events WHERE user_id % 10 = 3 AND event_type LIKE 'cl%' ORDER BY seq DESC LIMIT 40 OFFSET 5",
    "browse": "SELECT c_custkey, c_name AS value FROM customer WHERE contains(c_name, '99')",
    "brief_sections": f"""WITH {_TL}, f AS (SELECT case_id, event_type AS pattern FROM ev GROUP BY 1, 2), r AS (SELECT case_id, user_id, max(value) / 1000 AS s FROM ev GROUP BY 1, 2), q AS (SELECT *, round(s, 4) AS rs FROM r),
      best AS (SELECT case_id, user_id::VARCHAR AS top_role FROM q QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY rs DESC, user_id::VARCHAR) = 1)
      SELECT cs.id AS case_id, coalesce((SELECT count(*) FROM f WHERE f.case_id = cs.id), 0) AS findings, (SELECT string_agg(pattern, ',' ORDER BY pattern) FROM f WHERE f.case_id = cs.id) AS pattern_names, cs.title AS victims,
        (SELECT min(timestamp) FROM tl WHERE tl.case_id = cs.id) AS first_event, (SELECT max(timestamp) FROM tl WHERE tl.case_id = cs.id) AS last_event, coalesce((SELECT count(*) FROM q WHERE q.case_id = cs.id), 0) AS predictions,
        coalesce((SELECT count(*) FROM q WHERE q.case_id = cs.id AND rs > 0.095), 0) AS high_risk, coalesce((SELECT count(DISTINCT user_id) FROM ev WHERE ev.case_id = cs.id), 0) AS nodes, coalesce((SELECT count(*) FROM ev WHERE ev.case_id = cs.id), 0) AS edges,
        (SELECT least(count(*), 20) FROM q WHERE q.case_id = cs.id HAVING count(*) > 0)::INTEGER AS n_roles, (SELECT least(count(*), 10) FROM ev WHERE ev.case_id = cs.id HAVING count(*) > 0)::INTEGER AS n_evidence, best.top_role
      FROM cs LEFT JOIN best ON best.case_id = cs.id""",
}
ORACLES["briefs_read_back"] = ORACLES["brief_sections"]
ORACLES["entities_in_batches"] = ORACLES["merge_entities"]
ORACLES["edges_in_batches"] = ORACLES["merge_edges"]
_PERSON = "c_custkey % 5 <> 0 AND (c_custkey % 4 = 0 OR c_custkey % 10 >= 3)"
ORACLES["answers_edges"] = f"""SELECT 'PERSON::' || upper(c_name) AS source, 'OWNS' AS relationship, 'PHONE::9' || lpad(c_custkey::VARCHAR, 9, '0') AS target, 0.5::DOUBLE AS confidence, 1::BIGINT AS mentions FROM customer WHERE {_PERSON} AND c_custkey % 7 <> 0
  UNION ALL SELECT 'PERSON::' || upper(c_name), 'USES', 'SIM::89' || lpad(c_custkey::VARCHAR, 17, '0'), 0.9, 1 FROM customer WHERE {_PERSON} AND c_custkey % 6 <> 0 AND c_custkey % 8 <> 0"""
ORACLES["answers_warnings"] = """SELECT doc_id, 'c' || (doc_id % 50) AS case_id, kind, pos::INTEGER AS pos, reason, what FROM (
  SELECT c_custkey AS doc_id, 'entity' AS kind, 0 AS pos, 'unknown type' AS reason, 'ALIEN' AS what FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'entity', 1, 'empty value', 'PHONE' FROM customer WHERE c_custkey % 7 = 0
  UNION ALL SELECT c_custkey, 'relationship', 1, 'unknown relationship', 'LIKES' FROM customer WHERE c_custkey % 6 = 0
  UNION ALL SELECT c_custkey, 'relationship', 2, CASE WHEN c_custkey % 9 = 0 THEN 'empty endpoint' ELSE 'unknown endpoint type' END, 'PERSON::' || CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_name END || ' -> GHOST::x' FROM customer)"""
