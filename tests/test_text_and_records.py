"""Text, ingestion, feature and timeline fixtures of FIXTURES.md, sections 3 to 6."""

import json

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from casegraph.operators import cases as C
from casegraph.operators import extract as E
from casegraph.operators import entitystore as U
from casegraph.operators import features as X
from casegraph.operators import model as M
from casegraph.operators import resolve as R
from casegraph.operators import timeline as T
from casegraph.plans import case_queries
from casegraph.plans.driver_views import spread, table
from casegraph.plans.record_queries import narratives
from casegraph.sources import ingest as I
from casegraph.sources import io as O
from casegraph.streaming import jobs

TEXT = "Suspect Mr. Ramesh Kumar used phone 9876543210 with IMEI 354321098765432. Paid via Fraud123@paytm to HDFC0001234. Server 8.8.8.8 and 10.1.2.3. 9876543210 called 9123456789 under FIR/123/2024 by TXNIMPS12345678."


def test_extraction(spark):
    docs = spark.createDataFrame([(1, TEXT, "c1", "e1"), (2, None, "c1", "e1"), (3, "", "c1", "e1"), (4, TEXT, "c2", "e0")], "doc_id long, text string, case_id string, evidence_id string")
    m = {(r["type"], r["value"]) for r in E.mentions(docs.where("doc_id = 1")).collect()}
    assert {("PERSON", "Ramesh Kumar"), ("PHONE", "9876543210"), ("PHONE", "9123456789"), ("IMEI", "354321098765432"), ("UPI_ID", "fraud123@paytm"), ("BANK_ACCOUNT", "HDFC0001234"), ("IP_ADDRESS", "8.8.8.8"), ("CASE", "FIR/123/2024"), ("TRANSACTION", "TXNIMPS12345678")} <= m
    assert not any(v == "10.1.2.3" for _, v in m)
    ents, rels, warnings = R.pipeline(docs)
    phone = ents.where("value = '9876543210'").first()
    assert (phone["case_ids"], phone["evidence_ids"], phone["mentions"], phone["source_texts"]) == (["c1", "c2"], ["e0", "e1"], 4, [TEXT[:200]])
    kinds = {r["relationship"] for r in rels.collect()}
    assert {"OWNS", "USED_DEVICE", "CALLED", "TRANSFERRED_TO", "INVOLVED_IN", "PART_OF"} <= kinds and warnings.count() == 0
    assert R.for_case(ents, "c2").count() == ents.count()


def test_validation_and_responses(spark):
    rows = spark.createDataFrame([("phone", " 1 ", "2.5", "X", "t"), ("what", "v", None, None, "t"), ("SIM", " ", "0.5", "inferred", "t")], "type string, value string, confidence string, evidence_source string, source_text string")
    good, bad = E.validate_entities(rows)
    assert [(r["type"], r["value"], r["confidence"], r["evidence_source"]) for r in good.collect()] == [("PHONE", "1", 1.0, "observed")] and bad.count() == 2
    answers = spark.createDataFrame([('```json\n{"entities": [{"type": "PHONE", "value": "1"}]}\n```',), ('so: {"entities": [{"type": "SIM", "value": "2"}]} done',), ("none",)], "response string")
    got = [r["parsed"]["entities"][0]["value"] if r["parsed"] and r["parsed"]["entities"] else None for r in E.parse_responses(answers).collect()]
    assert got == ["1", "2", None]


def test_answers(spark):
    body = '{"entities": [{"type": "phone", "value": "+91 9876543210", "confidence": "x"}, {"type": "PERSON", "value": "al bo", "raw_value": " ", "confidence": 7}, {"type": "what", "value": "v"}, {"type": "SIM"}, {"type": "IMEI", "value": "1", "confidence": 0.2}], "relationships": [%s]}'
    links = [
        '{"source_type": "person", "source_value": "AL  BO", "relationship": "owns", "target_type": "PHONE", "target_value": "9876543210", "confidence": "0.75"}',
        '{"source_type": "PERSON", "source_value": "al bo", "relationship": "OWNS", "target_type": "IMEI", "target_value": "1"}',
        '{"source_type": "PERSON", "source_value": "", "relationship": "OWNS", "target_type": "GHOST", "target_value": "1"}',
        '{"source_type": "PERSON", "source_value": "al bo", "relationship": "KNOWS", "target_type": "PHONE", "target_value": "9876543210"}',
        'null',
    ]
    rows = [(1, body % ", ".join(links), "c1", "e1"), (2, "```json\n" + body % links[0] + "\n```", "c2", "e1"), (3, "nothing", "c1", "e1"), (4, None, None, None), (5, '{"entities": null}', None, None)]
    answers = spark.createDataFrame(rows, "doc_id long, response string, case_id string, evidence_id string")
    entities, edges, warnings = R.answers_pipeline(answers)
    got = {(r["type"], r["value"]): (r["confidence"], r["mentions"], r["case_ids"]) for r in entities.collect()}
    assert got == {("PHONE", "9876543210"): (0.5, 2, ["c1", "c2"]), ("PERSON", "Al Bo"): (1.0, 2, ["c1", "c2"])}
    assert [(r["relationship"], r["confidence"], r["mentions"]) for r in edges.collect()] == [("OWNS", 0.75, 2)]
    told = sorted((r["doc_id"], r["kind"], r["pos"], r["reason"], r["what"]) for r in warnings.collect())
    both = [("entity", 2, "unknown type", "WHAT"), ("entity", 3, "empty value", "SIM")]
    assert told == [(1, *x) for x in both] + [(1, "relationship", 2, "empty endpoint", "PERSON:: -> GHOST::1"), (1, "relationship", 3, "unknown relationship", "KNOWS")] + [(2, *x) for x in both]
    assert R.answers_pipeline(answers, most=2)[2].count() == 0


def test_normalise(spark):
    raw = spark.createDataFrame([(" ", "B1", "C1", "₹1,200.50", "2024-01-15"), ("A1", "B2", "C2", "x", "5/1/2024"), ("A2", None, None, None, "soon")], "src_account string, sender_account string, to string, amount string, date string")
    got = I.normalise(raw).collect()
    assert [(r["src_account"], r["dst_account"], r["amount"], r["timestamp"], r["currency"]) for r in got] == [("B1", "C1", 1200.5, "2024-01-15T00:00:00Z", "INR"), ("A1", "C2", None, "2024-01-05T00:00:00Z", "INR"), ("A2", None, None, "soon", "INR")]
    calls = spark.createDataFrame([("1", "2", "120s"), ("1", "2", "120sec")], "caller string, receiver string, duration string")
    assert [r["duration_sec"] for r in I.normalise(calls).collect()] == [120, None]
    assert [r["duration_sec"] for r in I.normalise(calls, lenient=True).collect()] == [120, 120]
    upi = I.normalise(spark.createDataFrame([("a@ybl", "3"), ("b@ybl", "many")], "vpa string, txn_count string"))
    good, bad = I.good_and_bad(upi)
    assert good.count() == 1 and bad.count() == 1
    loc = I.normalise(spark.createDataFrame([("Pune", "1.5", "north")], "city string, lat string, lng string")).first()
    assert loc["lat"] is None and loc["lon"] is None
    for header, kind in (("IMEI brand", "devices"), ("ICCID x", "sims"), ("vpa", "upi_ids"), ("caller x", "calls"), ("ifsc", "bank_accounts"), ("fir", "complaints"), ("lat", "locations"), ("msisdn", "phones"), ("debit", "transactions"), ("zzz", "unknown")):
        assert I.detect_type(header.split()) == kind
    assert "payload" in I.normalise(spark.createDataFrame([("q",)], "zzz string")).columns


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("src_account,dst_account,amount\nA,B,5\nC,D,7\n")
    (tmp_path / "one.json").write_text(json.dumps({"records": [{"caller": "1", "receiver": "2"}]}))
    (tmp_path / "t.txt").write_text("caller|receiver\n1|2\n3|4\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "bad.json").write_text("{nope")
    (tmp_path / "x.exe").write_text("MZ")
    got = I.with_provenance(O.read_csv(spark, str(tmp_path / "a.csv")), "c1", "e1", "now")
    assert [(r["source_file"], r["source_record_id"]) for r in got.orderBy("source_record_id").collect()] == [("a.csv", 0), ("a.csv", 1)]
    assert [r["caller"] for r in O.read_json(spark, str(tmp_path / "one.json")).collect()] == ["1"]
    assert sorted(r["fields"]["receiver"] for r in O.read_delimited(spark, str(tmp_path / "t.txt")).collect()) == ["2", "4"]
    assert O.read_lines(spark, str(tmp_path / "t.txt")).count() == 3
    files = O.validate_files(spark.read.format("binaryFile").load(str(tmp_path)))
    errors = {r["path"].rsplit("/", 1)[1]: r["errors"] for r in files.collect()}
    assert errors["a.csv"] == [] and "empty.csv" not in errors and errors["x.exe"] == ["extension not allowed"] and errors["bad.json"] == ["not JSON"]
    O.replace_case(spark.createDataFrame([("c1", 1), ("c2", 2)], "case_id string, n int"), str(tmp_path / "store"))
    O.replace_case(spark.createDataFrame([("c1", 9)], "case_id string, n int"), str(tmp_path / "store"))
    assert {(r["case_id"], r["n"]) for r in spark.read.parquet(str(tmp_path / "store")).collect()} == {("c1", 9), ("c2", 2)}
    O.append(spark.createDataFrame([("a",)], "v string"), str(tmp_path / "log"), "t0")
    O.append(spark.createDataFrame([("b",)], "v string"), str(tmp_path / "log"), "t1")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for k in range(2):
        (tmp_path / "in" / f"f{k}.csv").write_text("vpa,txn_count\na@ybl,1\nb@ybl,no\n")
        jobs.run_ingest(jobs.ingest_stream(spark, str(tmp_path / "in"), ["vpa", "txn_count"], "upi_ids"), out, ck).awaitTermination()
    got = spark.read.parquet(out)
    assert got.where("ok = 'true'").count() == 2 and got.where("ok = 'false'").count() == 2


def test_features(spark):
    rows = [("n1", "n2", 500.0, "salary payment"), ("n2", "n3", 250.0, "rent payment"), ("n3", "n1", 100.0, "utility bill"), ("f1", "f2", 9999.0, "structuring deposit below threshold"), ("f2", "f1", 9999.0, "Rapid movement of funds between accounts")]
    t = spark.createDataFrame(rows, "src string, dst string, amount double, description string")
    fraud = X.labels(spark.createDataFrame([("f1| f2 |",)], "involved_accounts string"), t.limit(0))
    got = {r["account"]: r for r in X.account_features(t, fraud, spark.createDataFrame([("idle",)], "account string")).collect()}
    assert (got["n1"]["out_volume"], got["n1"]["in_volume"], round(got["n1"]["fwd_ratio"], 6), got["n1"]["tx_count"], got["n1"]["round_amount_ratio_out"], got["n1"]["is_fraud"]) == (500, 100, 4.950495, 2, 1, 0)
    assert round(got["f1"]["fwd_ratio"], 6) == 0.9999 and got["f1"]["near_threshold_ratio"] == got["f1"]["suspicious_desc_ratio"] == got["f1"]["is_fraud"] == 1
    assert got["idle"]["tx_count"] == 0 and got["n2"]["unique_peers"] == 2 and got["n2"]["std_tx_amount"] == 0


def test_models(spark):
    rows = spark.range(60).select(F.col("id").cast("string").alias("account"), (F.col("id") % 2).cast("int").alias("is_fraud"), *[((F.col("id") % 2) * 5 + F.col("id") % 7).cast("double").alias(f) for f in X.FEATURES])
    parts = {r["part"]: r["count"] for r in X.split(rows, "account", "is_fraud").groupBy("part").count().collect()}
    assert parts == {"train": 36, "validation": 12, "test": 12}
    models = M.train(rows, trees=5, rounds=3)
    got = M.evaluate(models, rows)
    assert M.select_best(got).first()["average_precision"] > 0.8 and got.count() == 3
    assert M.importance(models["forest"], spark).count() == 10


def test_timeline_and_cases(spark):
    tx = spark.createDataFrame([("t1", "c1", "a", "b", 50000.0, "2024-01-10T09:00:00Z")], "id string, case_id string, src_account string, dst_account string, amount double, timestamp string")
    call = spark.createDataFrame([("k1", "c1", "x", "y", 5, "2024-01-10T10:00:00Z")], "id string, case_id string, caller_id string, receiver_id string, duration_sec int, timestamp string")
    cases = spark.createDataFrame([("c1", "T", "open", "high", 150000.0, ["v"], "2024-01-01")], "id string, title string, status string, severity string, total_loss_inr double, victim_ids array<string>, created_at string")
    ev = spark.createDataFrame([("e1", "c1", "doc", "d", "2024-01-11T08:00:00+00:00Z")], "id string, case_id string, type string, description string, collected_at string")
    got = [(r["event_type"], r["timestamp"]) for r in T.ordered(T.build(transactions=tx, calls=call, cases=cases, evidence=ev)).collect()]
    assert got == [("case_event", "2024-01-01T00:00:00Z"), ("transaction", "2024-01-10T09:00:00Z"), ("call", "2024-01-10T10:00:00Z"), ("case_event", "2024-01-11T08:00:00Z")]
    good, bad = C.create_cases(spark.createDataFrame([("A", "HIGH"), ("", "low"), ("B", "worst")], "title string, severity string"), "me", "now")
    assert [r["severity"] for r in good.collect()] == ["high"] and bad.count() == 2
    done = C.update_cases(cases.withColumn("closed_at", F.lit(None).cast("string")), spark.createDataFrame([("c1", "closed", "nobody")], "id string, status string, id2 string"), "t9").first()
    assert (done["status"], done["closed_at"], done["updated_at"], done["title"]) == ("closed", "t9", "t9", "T")
    log = spark.range(10).withColumnRenamed("id", "seq")
    assert C.audit_compact(log, 10, 4).count() == 6 and C.audit_compact(log, 11, 4).count() == 10
    e = C.evidence(ev).first()
    assert (e["evidence_id"], e["timestamp"], e["entities"], e["is_verified"]) == ("e1", "2024-01-11T08:00:00+00:00Z", [], False)


def test_profile(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (0.0,)], "x double")
    r = X.profile_numeric(df, ["x"]).first()
    assert (r["rows"], r["missing"], r["distinct"], r["median"], r["zeros"]) == (4, 1, 3, 1.0, 1)
    assert pytest.approx(r["mean"]) == 1.0 and X.duplicate_rows(df.union(df)).first()[0] == 4


def test_rows_made_from_small_ones_are_not_broadcast(spark):
    """Texts and entities made from a narrow column look small to the optimiser, whatever they take."""
    docs = narratives(spark, "/root/testdata/sf0.001")
    entities, edges, _ = R.pipeline(docs)
    known = entities.where("type = 'CASE'").select("entity_id")
    links = R.relate(docs, E.mentions(docs), entities)
    for df in (entities, edges, links, R.by_id(entities, known), R.merge_counts(entities, E.mentions(docs)), U.states(E.mentions(docs, keep=R.META).withColumn("seq", F.col("doc_id")))):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_narratives_are_made_in_many_tasks(spark):
    assert narratives(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() == 2  # 15,000 rows in one file


def test_files_of_one_row_are_written_by_many_tasks(spark):
    assert spread(table(spark, "/root/testdata/sf0.1", "supplier"), "s_suppkey", 512).rdd.getNumPartitions() == 2  # 1,000 rows in one file


def test_wrapped_documents_are_written_by_many_tasks(spark, monkeypatch):
    """150 documents of 100 customers: 64 files of a task, not all of one."""
    seen, read = [], O.read_json
    monkeypatch.setattr(O, "read_json", lambda s, path: seen.append(path) or read(s, path))
    assert case_queries.io_json_wrapped(spark, "/root/testdata/sf0.1").count() == 15_000
    assert len({p.name.split("-")[1] for p in Path(seen[0]).glob("part-*")}) > 1
