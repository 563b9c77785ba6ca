"""Queries over every record type, file round trips, timelines of all sources, evidence, cases and stored results.

Raw rows are made from the given tables in layouts that the normalisers have to read; round trips write below the scratch
folder and read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from casegraph.functions.expr import detector_time
from casegraph.functions.scratch import materialise, scratch_path
from casegraph.operators import cases as C
from casegraph.operators import extract as E
from casegraph.operators import graph as G
from casegraph.operators import resolve as R
from casegraph.operators import timeline as T
from casegraph.plans.driver_views import spread, table
from casegraph.plans.record_queries import _M, _N, _L, _time, cases, evidence_rows, narratives, timeline_events
from casegraph.plans.record_queries import _CASES, _EV, _TL
from casegraph.sources import ingest as I
from casegraph.sources import io as O
from casegraph.sources import mixed as MX
from casegraph.streaming import jobs

DAY = "yyyy-MM-dd"


def _s(c):
    return F.col(c).cast("string")


def _nth(key, *values):
    """One of the values by key, in turn; None is null."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _sql_nth(key, *values):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][{key} % {len(values)} + 1]"


# Records of every type (IN-4 to IN-17).

KYC, SWAPS, FLAGS, COUNTS, LAT = ("Verified", "no", " YES ", "1", None), ("2", "x", None, "0"), ("true", "Active", "0", None), ("3", "many", None, " 7 "), ("12.5", "north", None, "-3")


def raw_sims(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        _s("c_custkey").alias("id"), F.when(k % 3 == 0, F.concat(F.lit("89"), F.lpad(_s("c_custkey"), 17, "0"))).alias("ICCID"), F.concat(F.lit("88"), F.lpad(_s("c_custkey"), 17, "0")).alias("sim_serial"), F.col("c_mktsegment").alias("Telecom"),
        F.concat(F.lit("9"), F.lpad(_s("c_custkey"), 9, "0")).alias("MSISDN"), F.col("c_name").alias("subscriber"), _nth("c_custkey", *KYC).alias("KYC"), _nth("c_custkey", *SWAPS).alias("swaps"),
        F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("activation_date"), F.when(k % 2 == 0, F.lit("05/02/2024")).alias("swap_date"),
    )


def norm_sims(spark, d):
    return I.normalise(raw_sims(spark, d)).select("id", "iccid", "imsi", "operator", "phone_number", "registered_to", "kyc_verified", "swap_count", "issue_date", "last_swap_date")


def raw_devices(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        _s("p_partkey").alias("id"), F.lpad(_s("p_partkey"), 15, "3").alias("imei_number"), F.col("p_brand").alias("Make"), F.col("p_type").alias("device_model"), F.lit("").alias("os"), F.col("p_name").alias("platform"),
        F.concat(F.lit("C"), (k % 50).cast("string")).alias("owner"), F.concat(F.lit("2024-03-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("first_used"), F.when(k % 3 > 0, F.concat(F.lit("2024-03-"), F.lpad((k % 14 + 1).cast("string"), 2, "0"))).alias("last_active"),
    )


def norm_devices(spark, d):
    return I.normalise(raw_devices(spark, d)).select("id", "imei", "brand", "model", "os", "registered_to", "first_seen", "last_seen")


def norm_accounts(spark, d):
    raw = table(spark, d, "supplier").select(
        _s("s_suppkey").alias("acno"), F.lit("HDFC").alias("bank_name"), F.concat(F.lit("HDFC0"), F.lpad(_s("s_suppkey"), 6, "0")).alias("IFSC"), F.col("s_name").alias("account_holder"), F.concat(F.lit("S"), _s("s_suppkey")).alias("customer_id"),
        F.concat(F.lit("₹"), F.format_number(F.floor("s_acctbal"), 0)).alias("avail_bal"), F.lit("01-04-2020").alias("opening_date"), _nth("s_suppkey", "true", "YES", "0", None).alias("blocked"), _nth("s_suppkey", "done", None).alias("kyc"),
    )
    return I.normalise(raw).select("account_number", "bank", "ifsc", "account_type", "holder_name", "holder_id", "balance", "opened_date", "is_frozen", "kyc_status")


def raw_upi(spark, d):
    return table(spark, d, "customer").select(F.concat(F.lit("user"), _s("c_custkey"), F.lit("@ybl")).alias("VPA"), F.col("c_name").alias("holder"), F.concat(F.lit("A"), _s("c_custkey")).alias("account_id"), _nth("c_custkey", *FLAGS).alias("status"), _nth("c_custkey", *COUNTS).alias("total_txns"))


def _upi(spark, d):
    return I.normalise(raw_upi(spark, d))


def norm_upi(spark, d):
    good = _upi(spark, d).where("error IS NULL")
    return good.select("vpa", "registered_to", "linked_account", "is_active", "txn_count")


def upi_errors(spark, d):
    return _upi(spark, d).where("error IS NOT NULL").groupBy("error").agg(F.count("*").alias("n"))


def raw_complaints(spark, d):
    return table(spark, d, "orders").select(
        F.concat(F.lit("FIR/"), _s("o_orderkey")).alias("FIR"), F.col("o_orderpriority").alias("category"), F.concat(F.lit("Order of "), F.date_format("o_orderdate", DAY)).alias("details"), F.concat(F.floor("o_totalprice").cast("string"), F.lit(" ")).alias("claim_amount"),
        F.date_format("o_orderdate", "d-M-yyyy").alias("crime_date"), F.date_format("o_orderdate", "yyyy-M-d H:m:s").alias("filing_date"), F.concat(F.lit("PS "), _s("o_custkey")).alias("ps"),
    )


def norm_complaints(spark, d):
    return I.normalise(raw_complaints(spark, d)).select("complaint_number", "fraud_type", "narrative", "loss_amount", "currency", "incident_date", "reported_date", "police_station")


def norm_phones(spark, d):
    raw = table(spark, d, "customer").select(F.lit(" ").alias("number"), F.concat(F.lit("9"), F.lpad(_s("c_custkey"), 9, "0")).alias("contact"), F.col("c_mktsegment").alias("network"), F.concat(F.lit("N"), _s("c_nationkey")).alias("telecom_circle"), F.col("c_name").alias("owner"), _nth("c_custkey", *FLAGS).alias("active"))
    return I.normalise(raw, "phones").select("number", "operator", "circle", "registered_to", "is_active")


def raw_locations(spark, d):
    return table(spark, d, "customer").select(F.concat(F.lit("Town "), _s("c_nationkey")).alias("town"), F.col("c_mktsegment").alias("province"), F.lpad(_s("c_custkey"), 6, "4").alias("zip"), F.col("c_name").alias("place"), _nth("c_custkey", *LAT).alias("latitude"), _s("c_nationkey").alias("gps_lon"))


def norm_locations(spark, d):
    return I.normalise(raw_locations(spark, d)).select("city", "state", "pincode", "address", "lat", "lon")


def ingest_mixed(spark, d):
    """SIMs, devices, complaints and locations as CSV and UPI ids as TXT in one folder, read and typed in one scan."""
    path = scratch_path(spark)
    put = lambda df, name: df.write.option("header", True).option("quoteAll", True).csv(f"{path}/{name}")
    put(raw_sims(spark, d), "a")
    put(raw_devices(spark, d), "b")
    put(raw_complaints(spark, d), "c")
    put(raw_locations(spark, d), "d")
    upi = raw_upi(spark, d)
    lines = upi.select(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in upi.columns]).alias("value"))
    spark.createDataFrame([("|".join(upi.columns),)], "value string").unionByName(lines).coalesce(1).write.text(f"{path}/e")
    out = MX.normalise_mixed(MX.read_mixed(spark, path))
    at = lambda *names: F.coalesce(*[F.get_json_object("record", f"$.{n}") for n in names])
    return out.select("kind", at("iccid", "imei", "complaint_number", "city", "vpa").alias("one"), at("phone_number", "brand", "loss_amount", "lat", "txn_count").alias("two"), at("last_swap_date", "last_seen", "reported_date", "pincode", "is_active").alias("three"), "error")


def ingest_multiline(spark, d):
    """Documents as complaints in a folder of CSV files, their texts as narratives that span lines."""
    path = scratch_path(spark)
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("FIR"), F.col("text").alias("details"))
    docs.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{path}/a")
    rows = MX.of_kind(MX.normalise_mixed(MX.read_mixed(spark, path, multiline=True)), "complaints")
    return rows.select("complaint_number", F.md5("narrative").alias("narrative_md5"))


def norm_unknown(spark, d):
    return I.normalise(table(spark, d, "customer").select("c_custkey", "c_name")).select("payload")


def norm_dates(spark, d):
    """The ten layouts of times in turn, from the events' times."""
    from casegraph.functions.expr import INGEST_LAYOUTS, ingest_time

    wide = [f.replace("-M-", "-MM-").replace("-d", "-dd").replace("d/M/", "dd/MM/").replace("d-M-", "dd-MM-").replace("M/d/", "MM/dd/").replace("ddd", "dd").replace("H:m:s", "HH:mm:ss") for f in INGEST_LAYOUTS]
    ts = F.col("ts").cast("timestamp")
    text = F
    for k, f in enumerate(wide):
        text = text.when(F.col("event_id") % len(wide) == k, F.date_format(ts, f))
    return table(spark, d, "events").select("event_id", ingest_time(text).alias("t"))


def detector_dates(spark, d):
    """Times as the detectors read them: with and without zone, to the minute or the day; one with a blank is none."""
    ts = F.col("ts").cast("timestamp")
    day, clock = F.date_format(ts, DAY), F.date_format(ts, "HH:mm:ss")
    made = [F.concat(day, F.lit("T"), clock, F.lit(z)) for z in ("", "Z", "+00:00", "+00:00Z")] + [F.concat(day, F.lit("T"), F.substring(clock, 1, 5)), day, F.concat(day, F.lit(" "), clock)]
    text = F
    for k, x in enumerate(made):
        text = text.when(F.col("event_id") % len(made) == k, x)
    return table(spark, d, "events").select("event_id", F.date_format(detector_time(text), "yyyy-MM-dd HH:mm:ss").alias("t"))


# File round trips (IO-1 to IO-20).

def _files_of_customers(spark, d):
    """Text files of 100 customers each at most, a line a customer under a header, with four separators in turn: the folder."""
    path = scratch_path(spark)
    group = F.floor(F.col("c_custkey") / 100)
    sep = F.element_at(F.array(*[F.lit(s) for s in O.SEPARATORS]), (F.col("g") % 4 + 1).cast("int"))
    rows = table(spark, d, "customer").select(group.alias("g"), F.struct("c_custkey", "c_name", "c_mktsegment").alias("r"))
    rows = spread(rows.groupBy("g").agg(F.array_sort(F.collect_list("r")).alias("rs")), "g", 64).withColumn("sep", sep)  # 100 at most; files of a task
    lines = F.transform("rs", lambda r: F.concat_ws("", r["c_custkey"].cast("string"), F.col("sep"), r["c_name"], F.col("sep"), r["c_mktsegment"]))
    head = F.concat_ws("", F.lit("key"), F.col("sep"), F.lit("name"), F.col("sep"), F.lit("segment"))
    rows.select(F.concat(head, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n\n"))).write.option("maxRecordsPerFile", 1).text(path)
    return path


def io_csv(spark, d):
    path = scratch_path(spark)
    O.write_csv(table(spark, d, "customer"), path, ["c_custkey", "c_name", "phone", "c_nationkey"])
    return O.read_csv(spark, path)


def io_json(spark, d):
    path = scratch_path(spark)
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    O.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


def io_json_wrapped(spark, d):
    """Documents that wrap up to 100 records each in a field."""
    path = scratch_path(spark)
    rows = table(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 100).alias("g")).agg(F.collect_list(F.struct(F.col("c_custkey").alias("caller"), F.col("c_name").alias("receiver"))).alias("calls"))
    spread(rows, "g", 64).select(F.to_json(F.struct("calls")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)  # files of a task
    return O.read_json(spark, path).select("caller", "receiver")


def io_delimited(spark, d):
    rows = O.read_delimited(spark, _files_of_customers(spark, d))
    return rows.select(F.col("row").cast("long").alias("row"), *[F.col("fields")[c].alias(c) for c in ("key", "name", "segment")])


def io_lines(spark, d):
    path = scratch_path(spark)
    k = F.col("c_custkey")
    table(spark, d, "customer").select(F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")))).write.text(path)
    return O.read_lines(spark, path)


def io_append(spark, d):
    path = scratch_path(spark)
    c = table(spark, d, "customer")
    O.append(c.where("c_custkey % 2 = 0").select("c_name"), path, "t0")
    O.append(c.where("c_custkey % 2 = 1").select("c_name", F.when(F.col("c_custkey") % 3 == 0, _s("c_custkey")).alias("id")), path, "t1")
    return spark.read.parquet(path).select("id", "c_name", "created_at")


def io_store(spark, d):
    path = scratch_path(spark)
    rows = raw_sims(spark, d).select("id", F.concat(F.lit("c"), F.col("id")).alias("case_id"), F.lit("sims").alias("record_type")).withColumn("case_id", F.substring("case_id", 1, 2))
    O.store(rows, path)
    O.store(rows.where("id < '5'").withColumn("record_type", F.lit("phones")), path)
    return spark.read.parquet(path).groupBy("case_id", "record_type").agg(F.count("*").alias("n"))


def io_replace(spark, d):
    path = scratch_path(spark)
    rows = table(spark, d, "customer").select(F.concat(F.lit("n"), _s("c_nationkey")).alias("case_id"), "c_custkey", F.lit(1).alias("version"))
    O.replace_case(rows, path)
    O.replace_case(rows.where("case_id < 'n2'").withColumn("version", F.lit(2)), path)
    return spark.read.parquet(path).select("case_id", "c_custkey", "version")


def io_find(spark, d):
    return O.find(table(spark, d, "orders"), (F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "O")).select("o_orderkey", "o_totalprice")


def io_of_case(spark, d):
    """The rows of a case, and all rows for a case that has none."""
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("case_id"), "c_custkey")
    some, none = O.of_case(rows, "HOUSEHOLD"), O.of_case(rows, "nothing")
    return some.withColumn("asked", F.lit("one")).unionByName(O.of_case(rows, "nothing", fallback_all=True).withColumn("asked", F.lit("all"))).unionByName(none.withColumn("asked", F.lit("none")))


def io_validate(spark, d):
    """Files of one supplier each in four formats, and one of all, judged by extension, size and content."""
    path = scratch_path(spark)
    rows = spread(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", 512)  # files of a task
    one = lambda name, df=rows: df.write.option("maxRecordsPerFile", 1)
    one("csv").option("header", True).csv(f"{path}/headed")
    one("csv").csv(f"{path}/bare")
    one("json").json(f"{path}/json")
    rows.select("s_name").write.option("maxRecordsPerFile", 1).text(f"{path}/text")
    rows.write.option("maxRecordsPerFile", 1).orc(f"{path}/orc")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    kind = F.regexp_extract("path", r"/([a-z]+)/[^/]*$", 1)
    return O.validate_files(files).groupBy(kind.alias("folder"), F.array_join("errors", ",").alias("errors")).agg(F.count("*").alias("n"))


def provenance(spark, d):
    rows = I.with_provenance(spark.read.text(_files_of_customers(spark, d)), "c1", "e1", "2024-01-01T00:00:00Z")
    return rows.where("value <> ''").select("value", "source_record_id", "case_id", "evidence_id", "ingested_at")


def first_rows(spark, d):
    return O.first_per_file(spark.read.text(_files_of_customers(spark, d)), 3)


def stream_ingest(spark, d):
    """Files that arrive in a folder, read by a stream until they are through: good and rejected rows."""
    path = scratch_path(spark)
    raw = table(spark, d, "customer").select(F.concat(_s("c_custkey"), F.lit("@ybl")).alias("vpa"), _nth("c_custkey", *COUNTS).alias("txn_count"))
    raw.write.option("header", True).csv(f"{path}/in")
    jobs.run_ingest(jobs.ingest_stream(spark, f"{path}/in", ["vpa", "txn_count"], "upi_ids"), f"{path}/out", f"{path}/check").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("vpa", "txn_count", "error", F.col("ok").cast("string").alias("ok"))


# Text (EX-10, EX-12, EX-16, EX-17, ER-6, ER-7).

def organisations(spark, d):
    text = F.concat(F.lit("paid by "), F.translate(F.initcap("c_mktsegment"), "0123456789", ""), F.lit(" Finance, order "), _s("c_custkey"), F.lit("; then Union "), F.initcap("c_mktsegment"), F.lit(" Bank."))
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text"))
    return E.mentions(docs, tuple(r for r in E.RULES if r.type == "ORGANIZATION")).select("doc_id", "pos", "value", "confidence")


def optional_mentions(spark, d):
    text = F.concat(F.lit("imsi 404"), F.lpad(_s("o_orderkey"), 12, "0"), F.lit(" paid Rs. "), F.floor("o_totalprice").cast("string"), F.lit(".50 or inr 7"))
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))
    return E.mentions(docs, E.OPTIONAL_RULES).select("doc_id", "type", "raw_value")


def extract_documents(spark, d):
    """Marks with fixed layouts in the whole texts of documents."""
    rules = tuple(r for r in E.RULES if r.type in ("PHONE", "IMEI", "SIM", "UPI_ID", "BANK_ACCOUNT", "TRANSACTION", "CASE", "IP_ADDRESS")) + E.OPTIONAL_RULES
    return E.mentions(E.requests(table(spark, d, "documents").select("doc_id", "text")), rules).select("doc_id", "type", "pos", "raw_value")


def requests(spark, d):
    docs = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") == 0, F.lit("  ")).otherwise(F.col("text")).alias("text"))
    return E.requests(docs).groupBy("conv_id").agg(F.count("*").alias("n"))


def responses(spark, d):
    """Collected answers: fenced JSON, JSON in a sentence, no JSON."""
    body = F.concat(F.lit('{"entities": [{"type": "PERSON", "value": "'), F.col("c_name"), F.lit('", "confidence": 0.5}], "relationships": []}'))
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 3 == 1, F.concat(F.lit("I found: "), body, F.lit(" and no more"))).otherwise("nothing")
    out = E.parse_responses(table(spark, d, "customer").select("c_custkey", text.alias("response")))
    return out.select("c_custkey", F.get("parsed.entities", F.lit(0))["value"].alias("value"))


def relate(spark, d):
    """Relationships among the accounts and handles supplied, looked up in the store of all entities."""
    docs = narratives(spark, d)
    found = materialise(E.mentions(docs, keep=R.META))
    store = R.merge_entities(E.validate_entities(found)[0].withColumn("seq", F.struct("doc_id", "rule_no", "pos")))
    return R.relate(docs, found.where("type IN ('UPI_ID', 'BANK_ACCOUNT')"), store).select("doc_id", "relationship", "source_value", "target_value")


def entities_of_case(spark, d):
    entities, _, _ = R.pipeline(narratives(spark, d))
    return R.for_case(entities, "c7").select("type", "value")


def entities_by_id(spark, d):
    entities, _, _ = R.pipeline(narratives(spark, d))
    return R.by_id(entities, entities.where("type = 'CASE'").select("entity_id")).select("value")


# Graph projections (GR-1, GR-2, GR-4, GR-5, GR-12).

def _raw_entities(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.when(k % 2 == 0, F.concat(F.lit("C"), _s("c_custkey"))).alias("entity_id"), F.concat(F.lit("X"), _s("c_custkey")).alias("id"), F.when(k % 3 > 0, F.lit("PERSON")).alias("type"), F.when(k % 5 > 0, F.col("c_name")).alias("value"),
        F.when(k % 4 == 0, F.lit(0.5)).alias("confidence"), F.when(k % 2 == 0, F.array(F.concat(F.lit("n"), _s("c_nationkey")), F.lit("n99"))).otherwise(F.array().cast("array<string>")).alias("case_ids"), F.concat(F.lit("n"), _s("c_nationkey")).alias("case_id"),
        F.array(F.concat(F.lit("ev"), _s("c_custkey"))).alias("evidence_ids"),
    )


def graph_vertices(spark, d):
    v = G.project_vertices(_raw_entities(spark, d))
    return v.select("id", "type", "label", "value", "confidence", F.array_join("case_ids", ",").alias("case_ids"), F.array_join("evidence_ids", ",").alias("evidence_ids"))


def _raw_relationships(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.when(k % 2 == 0, F.concat(F.lit("r"), _s("o_orderkey"))).alias("relationship_id"), F.concat(F.lit("C"), _s("o_custkey")).alias("source"), F.concat(F.lit("O"), _s("o_orderkey")).alias("target"), F.when(k % 3 > 0, F.lit("OWNS")).alias("relationship"), F.when(k % 4 == 0, F.lit(0.25)).alias("confidence"), F.concat(F.lit("c"), _s("o_custkey")).alias("case_id"))


def graph_edges(spark, d):
    e = G.project_edges(_raw_relationships(spark, d))
    return e.select("edge_id", "src", "dst", "rel", "confidence", "evidence_source", F.array_join("case_ids", ",").alias("case_ids"))


def graph_in_case(spark, d):
    return G.in_case(_raw_entities(spark, d), "n7").select("id")


def graph_export(spark, d):
    v, e = G.export(G.project_vertices(_raw_entities(spark, d)), G.project_edges(_raw_relationships(spark, d)))
    v = v.select("id", F.col("type").alias("kind"), "evidence_id", F.col("metadata.confidence").alias("confidence"), F.size("metadata.case_ids").alias("cases"))
    return v.unionByName(e.select(F.concat_ws(">", "src", "dst").alias("id"), F.col("rel").alias("kind"), "evidence_id", F.col("metadata.confidence").alias("confidence"), F.size("metadata.case_ids").alias("cases")))


def node_evidence(spark, d):
    ev = C.evidence(evidence_rows(spark, d)).select("evidence_id", "type")
    return G.node_evidence(G.project_vertices(_raw_entities(spark, d)), ev).select("id", "evidence_id", "type")


# Timelines of all sources (TL-1 to TL-10).

def timeline_whole(spark, d):
    """Events of all seven sources: transfers, calls, SIMs, devices, account entities, cases, evidence."""
    sims = norm_sims(spark, d).withColumn("case_id", F.concat(F.lit("c"), F.col("id")))
    devices = norm_devices(spark, d).withColumn("case_id", F.concat(F.lit("c"), F.col("id")))
    k = F.col("s_suppkey")
    accounts = table(spark, d, "supplier").select(F.concat(F.lit("S"), _s("s_suppkey")).alias("entity_id"), F.when(k % 2 == 0, "bank_account").otherwise("PERSON").alias("type"), F.col("s_name").alias("value"), F.concat(F.lit("c"), _s("s_suppkey")).alias("case_id"), F.lit(" 2024-02-02 ").alias("extracted_at"))
    o = table(spark, d, "orders")
    ev = o.select(F.concat(F.lit("ev"), _s("o_orderkey")).alias("id"), F.concat(F.lit("c"), _s("o_custkey")).alias("case_id"), F.col("o_orderpriority").alias("type"), F.rpad(F.col("o_orderstatus"), 150, "y").alias("description"), F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00Z"))).alias("collected_at"))
    some = T.build(sims=sims, devices=devices, entities=accounts, evidence=ev).drop("source_ord")
    out = timeline_events(spark, d).drop("source_ord").unionByName(some)
    return out.select("case_id", "event_id", "timestamp", "event_type", F.array_join("entity_ids", ",").alias("entity_ids"), "source", F.length("description").alias("n_text"))


# Evidence, cases, audit, stored results (EV-2, EV-4, CS-1, CS-3, CS-4, AU-2, CB-10).

def evidence_of_case(spark, d):
    return C.evidence_of(C.evidence(evidence_rows(spark, d)), "1998").select("evidence_id", "type")


def evidence_search(spark, d):
    return C.search_evidence(C.evidence(evidence_rows(spark, d)), "URGENT").select("evidence_id", "type")


def evidence_fields(spark, d):
    ev = C.evidence(evidence_rows(spark, d).withColumnsRenamed({"id": "evidence_id"}).withColumn("note", F.concat(F.lit("n"), F.col("case_id"))))
    return ev.select("evidence_id", "source_file", "is_verified", F.array_join("entities", ",").alias("entities"), F.col("extra")["note"].alias("note"))


def _new_cases(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.when(k % 7 == 0, F.lit("  ")).when(k % 11 == 0, F.rpad(F.col("c_name"), 301, "x")).otherwise(F.col("c_name")).alias("title"), _nth("c_custkey", "HIGH", "low", None, "worst").alias("severity"), _nth("c_custkey", "Open", None, "closed").alias("status"),
        _nth("c_custkey", "sim_swap", None).alias("fraud_pattern"), _nth("c_custkey", "12.5", "x", None).alias("total_loss_inr"),
    )


def cases_created(spark, d):
    good, _ = C.create_cases(_new_cases(spark, d), "me", "2024-01-01T00:00:00Z")
    return good.select("title", "severity", "status", "fraud_pattern", "total_loss_inr", "created_by", "created_at")


def cases_rejected(spark, d):
    _, bad = C.create_cases(_new_cases(spark, d), "me", "2024-01-01T00:00:00Z")
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


def case_by_id(spark, d):
    return C.case_by_id(cases(spark, d), "c77").select("id", "title", "status", "severity")


def cases_updated(spark, d):
    """Changes of a case in three: a field that may change, one that may not, and values that are not known."""
    k = F.col("c_custkey")
    u = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("c"), _s("c_custkey")).alias("id"), _nth("c_custkey", "closed", "open", "gone").alias("status"), F.when(k % 2 == 0, F.lit("new")).alias("title"), F.lit("x").alias("created_at"))
    return C.update_cases(cases(spark, d), u, "2024-06-01T00:00:00Z").select("id", "title", "status", "created_at", "updated_at", "closed_at")


def audit_kept(spark, d):
    """The log after compaction: at 1000 rows or more the 500 oldest go."""
    return C.audit_compact(table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("action")), 1000, 500)


def briefs_stored(spark, d):
    """Briefs written as one document for each case, one of them read back by its case."""
    path = scratch_path(spark)
    rows = cases(spark, d).select(F.col("id").alias("case_id"), "title", "status", "severity")
    C.save_briefs(rows, path)
    doc = O.of_stored(spark, path, "c12")
    return doc.select("case_id", F.get_json_object("document", "$.title").alias("title"), F.get_json_object("document", "$.severity").alias("severity"))


QUERIES = {f.__name__: f for f in (
    norm_sims, norm_devices, norm_accounts, norm_upi, upi_errors, norm_complaints, norm_phones, norm_locations, ingest_mixed, ingest_multiline, norm_unknown, norm_dates, detector_dates, io_csv, io_json, io_json_wrapped, io_delimited, io_lines, io_append, io_store, io_replace, io_find, io_of_case,
    io_validate, provenance, first_rows, stream_ingest, organisations, optional_mentions, extract_documents, requests, responses, relate, entities_of_case, entities_by_id, graph_vertices, graph_edges, graph_in_case, graph_export, node_evidence, timeline_whole,
    evidence_of_case, evidence_search, evidence_fields, cases_created, cases_rejected, case_by_id, cases_updated, audit_kept, briefs_stored,
)}

# Oracle texts.
_FLAG = f"coalesce(lower({_sql_nth('c_custkey', *FLAGS)}), 'true') IN ('true', 'active', 'yes', '1')"
_UPI = f"""SELECT 'user' || c_custkey || '@ybl' AS vpa, c_name AS registered_to, 'A' || c_custkey AS linked_account, {_FLAG} AS is_active, trim({_sql_nth('c_custkey', *COUNTS)}) AS t FROM customer"""
_LINES = """SELECT g, c_custkey, c_name, c_mktsegment, [',', chr(9), '|', ';'][g % 4 + 1] AS sep, row_number() OVER (PARTITION BY g ORDER BY c_custkey) AS r FROM (SELECT *, c_custkey // 100 AS g FROM customer)"""
_SIMS = f"""SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 3 = 0 THEN '89' ELSE '88' END || lpad(c_custkey::VARCHAR, 17, '0') AS iccid, NULL::VARCHAR AS imsi, c_mktsegment AS operator, '9' || lpad(c_custkey::VARCHAR, 9, '0') AS phone_number, c_name AS registered_to,
  coalesce(lower(trim({_sql_nth('c_custkey', *KYC)})) IN ('true', 'yes', '1', 'verified'), false) AS kyc_verified, coalesce(try_cast({_sql_nth('c_custkey', *SWAPS)} AS INTEGER), 0) AS swap_count,
  '2024-01-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00Z' AS issue_date, CASE WHEN c_custkey % 2 = 0 THEN '2024-02-05T00:00:00Z' END AS last_swap_date FROM customer"""
_DEVICES = """SELECT p_partkey::VARCHAR AS id, lpad(p_partkey::VARCHAR, 15, '3') AS imei, p_brand AS brand, p_type AS model, p_name AS os, 'C' || (p_partkey % 50) AS registered_to, '2024-03-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00Z' AS first_seen,
  CASE WHEN p_partkey % 3 > 0 THEN '2024-03-' || lpad((p_partkey % 14 + 1)::VARCHAR, 2, '0') || 'T00:00:00Z' END AS last_seen FROM part"""
_RAW = """raw AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'C' || c_custkey END AS entity_id, 'X' || c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN 'PERSON' END AS type, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS value,
  CASE WHEN c_custkey % 4 = 0 THEN 0.5::DOUBLE END AS confidence, CASE WHEN c_custkey % 2 = 0 THEN ['n' || c_nationkey, 'n99'] ELSE ['n' || c_nationkey] END AS case_ids, 'ev' || c_custkey AS evidence_id FROM customer)"""
_NEW = f"""nw AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN rpad(c_name, 301, 'x') ELSE c_name END AS title, lower(coalesce({_sql_nth('c_custkey', 'HIGH', 'low', None, 'worst')}, 'medium')) AS severity,
  lower(coalesce({_sql_nth('c_custkey', 'Open', None, 'closed')}, 'open')) AS status, coalesce({_sql_nth('c_custkey', 'sim_swap', None)}, 'unknown') AS fraud_pattern, coalesce(try_cast({_sql_nth('c_custkey', '12.5', 'x', None)} AS DOUBLE), 0.0) AS total_loss_inr FROM customer),
jd AS (SELECT *, CASE WHEN title = '' THEN 'title is required' WHEN length(title) > 300 THEN 'title is too long' WHEN severity = 'worst' THEN 'unknown severity' END AS reason FROM nw)"""
_YEARS = "CASE WHEN day(ts) <= 12 THEN make_timestamp(year(ts), day(ts), month(ts), {h}) ELSE make_timestamp(year(ts), month(ts), day(ts), {h}) END"

ORACLES = {
    "norm_sims": _SIMS, "norm_devices": _DEVICES,
    "norm_accounts": f"SELECT s_suppkey::VARCHAR AS account_number, 'HDFC' AS bank, 'HDFC0' || lpad(s_suppkey::VARCHAR, 6, '0') AS ifsc, 'savings' AS account_type, s_name AS holder_name, 'S' || s_suppkey AS holder_id, floor(s_acctbal)::DOUBLE AS balance, '2020-04-01T00:00:00Z' AS opened_date, coalesce(lower({_sql_nth('s_suppkey', 'true', 'YES', '0', None)}) IN ('true', 'yes', '1'), false) AS is_frozen, coalesce({_sql_nth('s_suppkey', 'done', None)}, 'unknown') AS kyc_status FROM supplier",
    "norm_upi": f"SELECT vpa, registered_to, linked_account, is_active, coalesce(try_cast(t AS INTEGER), 0) AS txn_count FROM ({_UPI}) WHERE t IS NULL OR try_cast(t AS INTEGER) IS NOT NULL",
    "upi_errors": f"SELECT 'txn_count is no whole number: ' || t AS error, count(*) AS n FROM ({_UPI}) WHERE try_cast(t AS INTEGER) IS NULL AND t IS NOT NULL GROUP BY 1",
    "norm_complaints": "SELECT 'FIR/' || o_orderkey AS complaint_number, o_orderpriority AS fraud_type, 'Order of ' || strftime(o_orderdate, '%Y-%m-%d') AS narrative, floor(o_totalprice)::DOUBLE AS loss_amount, 'INR' AS currency, strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS incident_date, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS reported_date, 'PS ' || o_custkey AS police_station FROM orders",
    "norm_phones": f"SELECT '9' || lpad(c_custkey::VARCHAR, 9, '0') AS number, c_mktsegment AS operator, 'N' || c_nationkey AS circle, c_name AS registered_to, {_FLAG} AS is_active FROM customer",
    "norm_locations": f"SELECT 'Town ' || c_nationkey AS city, c_mktsegment AS state, lpad(c_custkey::VARCHAR, 6, '4') AS pincode, c_name AS address, CASE WHEN l <> 'north' OR l IS NULL THEN try_cast(l AS DOUBLE) END AS lat, CASE WHEN l <> 'north' OR l IS NULL THEN c_nationkey::DOUBLE END AS lon FROM (SELECT *, {_sql_nth('c_custkey', *LAT)} AS l FROM customer)",
    "norm_unknown": """SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' AS payload FROM customer""",
    "norm_dates": f"""SELECT event_id, strftime(CASE event_id % 10 WHEN 0 THEN f WHEN 1 THEN f WHEN 2 THEN f WHEN 3 THEN d WHEN 4 THEN f WHEN 5 THEN d WHEN 6 THEN f WHEN 7 THEN d WHEN 8 THEN {_YEARS.format(h='hour(ts), minute(ts), floor(second(ts))')} ELSE {_YEARS.format(h='0, 0, 0')} END, '%Y-%m-%dT%H:%M:%SZ') AS t
      FROM (SELECT event_id, ts, date_trunc('second', ts) AS f, date_trunc('day', ts)::TIMESTAMP AS d FROM events)""",
    "detector_dates": "SELECT event_id, strftime(CASE WHEN event_id % 7 < 4 THEN date_trunc('second', ts) WHEN event_id % 7 = 4 THEN date_trunc('minute', ts) WHEN event_id % 7 = 5 THEN date_trunc('day', ts)::TIMESTAMP END, '%Y-%m-%d %H:%M:%S') AS t FROM events",
    "io_csv": "SELECT c_custkey::VARCHAR AS c_custkey, c_name, NULL::VARCHAR AS phone, c_nationkey::VARCHAR AS c_nationkey FROM customer",
    "io_json": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders",
    "io_json_wrapped": "SELECT c_custkey::VARCHAR AS caller, c_name AS receiver FROM customer",
    "io_delimited": f"SELECT r - 1 AS row, c_custkey::VARCHAR AS key, c_name AS name, c_mktsegment AS segment FROM ({_LINES})",
    "io_lines": "SELECT c_name AS text FROM customer WHERE c_custkey % 3 <> 0",
    "io_append": """SELECT CASE WHEN c_custkey % 2 = 1 AND c_custkey % 3 = 0 THEN c_custkey::VARCHAR ELSE 'rec_' || substr(sha256('{"c_name":"' || c_name || '"}'), 1, 12) END AS id, c_name, CASE WHEN c_custkey % 2 = 0 THEN 't0' ELSE 't1' END AS created_at FROM customer""",
    "io_store": "WITH r AS (SELECT c_custkey::VARCHAR AS id, 'c' || substr(c_custkey::VARCHAR, 1, 1) AS case_id FROM customer) SELECT case_id, record_type, count(*) AS n FROM (SELECT case_id, 'sims' AS record_type FROM r UNION ALL SELECT case_id, 'phones' FROM r WHERE id < '5') GROUP BY 1, 2",
    "io_replace": "SELECT 'n' || c_nationkey AS case_id, c_custkey, CASE WHEN 'n' || c_nationkey < 'n2' THEN 2 ELSE 1 END AS version FROM customer",
    "io_find": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'",
    "io_of_case": "SELECT c_mktsegment AS case_id, c_custkey, 'one' AS asked FROM customer WHERE c_mktsegment = 'HOUSEHOLD' UNION ALL SELECT c_mktsegment, c_custkey, 'all' FROM customer",
    "io_validate": "SELECT f AS folder, e AS errors, count(*) AS n FROM supplier, (VALUES ('headed', ''), ('bare', 'no data row'), ('json', ''), ('text', ''), ('orc', 'extension not allowed')) v(f, e) GROUP BY 1, 2",
    "provenance": f"SELECT v AS value, n AS source_record_id, 'c1' AS case_id, 'e1' AS evidence_id, '2024-01-01T00:00:00Z' AS ingested_at FROM (SELECT c_custkey || sep || c_name || sep || c_mktsegment AS v, r AS n FROM ({_LINES}) UNION ALL SELECT DISTINCT ON (g) 'key' || sep || 'name' || sep || 'segment', 0 FROM ({_LINES}))",
    "first_rows": f"SELECT c_custkey || sep || c_name || sep || c_mktsegment AS value FROM ({_LINES}) WHERE r <= 2 UNION ALL SELECT 'key' || sep || 'name' || sep || 'segment' FROM (SELECT DISTINCT g, sep FROM ({_LINES}))",
    "stream_ingest": f"SELECT c_custkey || '@ybl' AS vpa, coalesce(try_cast(t AS INTEGER), 0) AS txn_count, CASE WHEN bad THEN 'txn_count is no whole number: ' || t END AS error, CASE WHEN bad THEN 'false' ELSE 'true' END AS ok FROM (SELECT *, t IS NOT NULL AND try_cast(t AS INTEGER) IS NULL AS bad FROM (SELECT c_custkey, trim({_sql_nth('c_custkey', *COUNTS)}) AS t FROM customer))",
    "organisations": """SELECT doc_id, pos, value, 0.71::DOUBLE AS confidence FROM (SELECT c_custkey AS doc_id, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS m FROM customer), LATERAL (SELECT 0 AS pos, m || ' Finance' AS value UNION ALL SELECT 1, 'Union ' || m || ' Bank')""",
    "optional_mentions": """SELECT o_orderkey AS doc_id, unnest(['IMSI', 'ACCOUNT_NUMBER', 'AMOUNT', 'AMOUNT']) AS type, unnest(['404' || lpad(o_orderkey::VARCHAR, 12, '0'), '404' || lpad(o_orderkey::VARCHAR, 12, '0'), 'Rs. ' || floor(o_totalprice)::BIGINT || '.50', 'inr 7']) AS raw_value FROM orders""",
    "extract_documents": r"""SELECT * FROM (SELECT doc_id, type, (generate_subscripts(h, 1) - 1)::INTEGER AS pos, unnest(h) AS raw_value FROM (SELECT doc_id, unnest([
      {type: 'PHONE', h: list_transform(regexp_extract_all(text, '\b(?:\+91[-\s]?)?[6-9]\d{9}\b'), lambda x: regexp_replace(x, '[\s\-]', '', 'g'))}, {type: 'IMEI', h: regexp_extract_all(text, '\b\d{15}\b')}, {type: 'SIM', h: regexp_extract_all(text, '\b89\d{17,18}\b')},
      {type: 'UPI_ID', h: regexp_extract_all(text, '(?i)\b[\w.\-]+@(?:okaxis|oksbi|okicici|okhdfcbank|ybl|ibl|paytm|upi|apl|axl)\b')}, {type: 'BANK_ACCOUNT', h: regexp_extract_all(text, '\b[A-Z]{4}0[A-Z0-9]{6}\b')},
      {type: 'TRANSACTION', h: regexp_extract_all(text, '(?i)\b(?:TXN|UTR|IMPS|NEFT|UPI)[A-Z0-9]{8,20}\b')}, {type: 'CASE', h: regexp_extract_all(text, '(?i)\b(?:FIR|CMP|CASE)[/\-]\d{3,}[/\-]\d{4}\b')},
      {type: 'IP_ADDRESS', h: regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b')}, {type: 'IMSI', h: regexp_extract_all(text, '\b404\d{10,12}\b')}, {type: 'ACCOUNT_NUMBER', h: regexp_extract_all(text, '\b\d{9,18}\b')},
      {type: 'AMOUNT', h: regexp_extract_all(text, '(?i)(?:Rs\.?|INR|₹)\s?[\d,]+(?:\.\d{1,2})?')}], recursive := true) FROM documents)) WHERE type <> 'IP_ADDRESS' OR NOT regexp_matches(raw_value, '^(10|172\.(1[6-9]|2\d|3[01])|192\.168)\.')""",
    "requests": "SELECT conv_id, count(*) AS n FROM conversations WHERE turn <> 0 AND trim(text) <> '' GROUP BY conv_id",
    "responses": "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS value FROM customer",
    "relate": f"WITH {_N}, {_M}, {_L} SELECT doc_id, relationship, source_value, target_value FROM rel WHERE source_type IN ('UPI_ID', 'BANK_ACCOUNT') AND target_type IN ('UPI_ID', 'BANK_ACCOUNT')",
    "entities_of_case": f"WITH {_N}, {_M} SELECT DISTINCT type, value FROM men WHERE case_id = 'c7'",
    "entities_by_id": f"WITH {_N}, {_M} SELECT DISTINCT value FROM men WHERE type = 'CASE'",
    "graph_vertices": f"WITH {_RAW} SELECT coalesce(entity_id, id) AS id, coalesce(type, 'UNKNOWN') AS type, coalesce(value, entity_id, id) AS label, value, coalesce(confidence, 1.0) AS confidence, array_to_string(case_ids, ',') AS case_ids, evidence_id AS evidence_ids FROM raw",
    "graph_edges": "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'r' || o_orderkey ELSE 'C' || o_custkey || '__' || rel || '__O' || o_orderkey END AS edge_id, 'C' || o_custkey AS src, 'O' || o_orderkey AS dst, rel, CASE WHEN o_orderkey % 4 = 0 THEN 0.25 ELSE 1.0 END::DOUBLE AS confidence, 'observed' AS evidence_source, 'c' || o_custkey AS case_ids FROM (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN 'OWNS' ELSE 'RELATED_TO' END AS rel FROM orders)",
    "graph_in_case": f"WITH {_RAW} SELECT id FROM raw WHERE list_contains(case_ids, 'n7')",
    "graph_export": f"""WITH {_RAW} SELECT coalesce(entity_id, id) AS id, coalesce(type, 'UNKNOWN') AS kind, evidence_id, coalesce(confidence, 1.0) AS confidence, len(case_ids)::INTEGER AS cases FROM raw
      UNION ALL SELECT 'C' || o_custkey || '>O' || o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'OWNS' ELSE 'RELATED_TO' END, NULL, CASE WHEN o_orderkey % 4 = 0 THEN 0.25 ELSE 1.0 END, 1 FROM orders""",
    "node_evidence": f"WITH {_RAW} SELECT coalesce(entity_id, id) AS id, evidence_id, o_orderpriority AS type FROM raw JOIN orders ON evidence_id = 'ev' || o_orderkey",
    "timeline_whole": f"""WITH {_TL}, s AS ({_SIMS}), dv AS ({_DEVICES}), oth AS (
      SELECT 'c' || id AS case_id, 'evt_sim_issue_' || id AS event_id, issue_date AS timestamp, 'sim_event' AS event_type, id || ',' || phone_number AS entity_ids, 'sims' AS source, length('SIM ' || id || ' issued | operator: ' || operator || ' | KYC: ' || CASE WHEN kyc_verified THEN 'verified' ELSE 'unverified' END) AS n_text FROM s
      UNION ALL SELECT 'c' || id, 'evt_sim_swap_' || id, last_swap_date, 'sim_event', id, 'sims', length('SIM SWAP detected: ' || id || ' | total swaps: ' || swap_count) FROM s WHERE swap_count > 0 AND last_swap_date IS NOT NULL
      UNION ALL SELECT 'c' || id, 'evt_dev_first_' || id, first_seen, 'device_association', id || ',' || registered_to, 'devices', length('Device first seen: ' || brand || ' ' || model || ' (IMEI: ' || imei || ') | owner: ' || registered_to) FROM dv
      UNION ALL SELECT 'c' || id, 'evt_dev_last_' || id, last_seen, 'device_association', id, 'devices', length('Device last seen: ' || brand || ' ' || model) FROM dv WHERE last_seen <> first_seen
      UNION ALL SELECT 'c' || s_suppkey, 'evt_acc_S' || s_suppkey, '2024-02-02T00:00:00Z', 'account_activity', 'S' || s_suppkey, 'entities', length('Account entity extracted: ' || s_name || ' | risk: N/A') FROM supplier WHERE s_suppkey % 2 = 0
      UNION ALL SELECT 'c' || o_custkey, 'evt_ev_ev' || o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'), 'case_event', '', 'evidence', length('Evidence collected: ' || o_orderpriority || ' — ') + 120 FROM orders WHERE o_orderkey % 4 > 0)
      SELECT case_id, event_id, timestamp, event_type, entity_ids, source, n_text::INTEGER AS n_text FROM (SELECT case_id, event_id, timestamp, event_type, entity_ids, source, n_text FROM (SELECT tl.*, CASE event_type WHEN 'transaction' THEN length('Transaction ' || event_id[8:] || ' | ' || a || ' → ' || b || ' | ₹' || format('{{:,.2f}}', value)) WHEN 'call' THEN length('Call ' || a || ' → ' || b || ' | ' || floor(value)::BIGINT || 's')
        ELSE CASE WHEN event_id LIKE 'evt_case_open%' THEN length('Case opened: ' || cs.title || ' | severity: ' || severity || ' | pattern: ' || pattern) ELSE length('Case closed: ' || cs.title) END END AS n_text
        FROM (SELECT tl.*, ev.a, ev.b, ev.value FROM tl LEFT JOIN ev ON tl.event_id IN ('evt_tx_' || ev.event_id, 'evt_call_' || ev.event_id)) tl LEFT JOIN (SELECT *, ['sim_swap', 'mule_network', 'transaction_layering', 'shared_device', 'shared_sim', 'communication_hub', 'rapid_multi_hop', 'legitimate', 'unknown'][id[2:]::BIGINT % 9 + 1] AS pattern FROM cs) cs ON cs.id = tl.case_id AND tl.source = 'cases')
      UNION ALL SELECT * FROM oth)""",
    "evidence_of_case": "SELECT 'ev' || o_orderkey AS evidence_id, o_orderpriority AS type FROM orders WHERE year(o_orderdate) = 1998",
    "evidence_search": "SELECT 'ev' || o_orderkey AS evidence_id, o_orderpriority AS type FROM orders WHERE contains(lower(o_orderpriority), 'urgent')",
    "evidence_fields": "SELECT 'ev' || o_orderkey AS evidence_id, o_orderpriority AS source_file, o_orderkey % 3 = 0 AS is_verified, 'C' || o_custkey AS entities, 'n' || year(o_orderdate) AS note FROM orders",
    "cases_created": f"WITH {_NEW} SELECT title, severity, status, fraud_pattern, total_loss_inr, 'me' AS created_by, '2024-01-01T00:00:00Z' AS created_at FROM jd WHERE reason IS NULL",
    "cases_rejected": f"WITH {_NEW} SELECT reason, count(*) AS n FROM jd WHERE reason IS NOT NULL GROUP BY reason",
    "case_by_id": f"WITH {_CASES} SELECT id, title, status, severity FROM cs WHERE id = 'c77'",
    "cases_updated": f"""WITH {_CASES}, u AS (SELECT 'c' || c_custkey AS id, {_sql_nth('c_custkey', 'closed', 'open', 'gone')} AS st, CASE WHEN c_custkey % 2 = 0 THEN 'new' END AS t FROM customer WHERE c_custkey % 3 = 0)
      SELECT cs.id, coalesce(u.t, title) AS title, coalesce(u.st, status) AS status, created_at, CASE WHEN u.id IS NOT NULL THEN '2024-06-01T00:00:00Z' END AS updated_at,
        CASE WHEN status = 'closed' THEN '2024-03-01T00:00:00+00:00Z' WHEN coalesce(u.st, status) = 'closed' THEN '2024-06-01T00:00:00Z' END AS closed_at FROM cs LEFT JOIN u ON u.id = cs.id AND u.st <> 'gone'""",
    "audit_kept": "SELECT event_id AS seq, event_type AS action FROM events WHERE (SELECT count(*) FROM events) < 1000 OR event_id >= (SELECT event_id FROM events ORDER BY event_id OFFSET 500 LIMIT 1)",
    "briefs_stored": f"WITH {_CASES} SELECT id AS case_id, title, severity FROM cs WHERE id = 'c12'",
}
_UPI_ROWS = ORACLES["norm_upi"].replace(" WHERE t IS NULL OR try_cast(t AS INTEGER) IS NOT NULL", "").replace("AS txn_count FROM", "AS txn_count, t FROM")
ORACLES["ingest_mixed"] = f"""SELECT 'sims' AS kind, iccid AS one, phone_number AS two, last_swap_date AS three, NULL::VARCHAR AS error FROM ({ORACLES['norm_sims']})
  UNION ALL SELECT 'devices', imei, brand, last_seen, NULL FROM ({ORACLES['norm_devices']}) UNION ALL SELECT 'complaints', complaint_number, loss_amount::VARCHAR, reported_date, NULL FROM ({ORACLES['norm_complaints']})
  UNION ALL SELECT 'locations', city, lat::VARCHAR, pincode, NULL FROM ({ORACLES['norm_locations']})
  UNION ALL SELECT 'upi_ids', vpa, txn_count::VARCHAR, is_active::VARCHAR, CASE WHEN t IS NOT NULL AND try_cast(t AS INTEGER) IS NULL THEN 'txn_count is no whole number: ' || t END FROM ({_UPI_ROWS})"""
ORACLES["ingest_multiline"] = "SELECT doc_id::VARCHAR AS complaint_number, md5(nullif(trim(text), '')) AS narrative_md5 FROM documents"
