"""Normalisers: rows of text columns of any layout to the canonical tables. All are projections inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegraph.functions.expr import amount, blank_null, ingest_time, yes

# The names each field may have, in the order they are tried; the first non-blank one of a row counts.
ALIASES = {
    "transactions": {
        "src_account": ("src_account", "source", "from_account", "sender_account", "src_id", "from"),
        "dst_account": ("dst_account", "destination", "to_account", "receiver_account", "dst_id", "to"),
        "amount": ("amount", "txn_amount", "transaction_amount", "debit", "value"),
        "currency": ("currency", "ccy"),
        "method": ("method", "mode", "payment_mode", "channel", "type", "txn_type"),
        "narration": ("narration", "description", "remarks", "note", "memo", "desc"),
        "timestamp": ("timestamp", "date", "txn_date", "datetime", "time", "created_at"),
    },
    "calls": {
        "caller_id": ("caller", "caller_id", "from", "calling_number", "a_party", "msisdn_a"),
        "receiver_id": ("receiver", "receiver_id", "to", "called_number", "b_party", "msisdn_b"),
        "duration_sec": ("duration", "duration_sec", "dur", "call_duration", "seconds"),
        "call_type": ("call_type", "type", "direction"),
        "cell_tower": ("cell_tower", "tower", "cell_id", "bts", "site"),
        "timestamp": ("timestamp", "date", "call_date", "datetime", "start_time"),
    },
    "sims": {
        "iccid": ("iccid", "sim_id", "sim_serial"),
        "imsi": ("imsi",),
        "operator": ("operator", "telecom", "service_provider", "network"),
        "phone_number": ("phone", "phone_number", "msisdn", "mobile"),
        "registered_to": ("registered_to", "subscriber", "owner", "holder"),
        "kyc_verified": ("kyc", "kyc_verified", "kyc_status", "verified"),
        "swap_count": ("swap_count", "swaps", "sim_swaps", "number_of_swaps"),
        "issue_date": ("issue_date", "activation_date", "created_at", "date"),
        "last_swap_date": ("last_swap_date", "swap_date", "last_swap"),
    },
    "devices": {
        "imei": ("imei", "device_id", "imei_number"),
        "brand": ("brand", "make", "manufacturer"),
        "model": ("model", "device_model"),
        "os": ("os", "operating_system", "platform"),
        "registered_to": ("registered_to", "owner", "user", "holder"),
        "first_seen": ("first_seen", "first_used", "registered_date"),
        "last_seen": ("last_seen", "last_used", "last_active"),
    },
    "bank_accounts": {
        "account_number": ("account_number", "acc_number", "account_no", "acno", "account"),
        "bank": ("bank", "bank_name", "bank_code", "ifsc_bank"),
        "ifsc": ("ifsc", "ifsc_code"),
        "account_type": ("account_type", "type", "acct_type"),
        "holder_name": ("holder_name", "account_holder", "name", "customer_name"),
        "holder_id": ("holder_id", "person_id", "customer_id"),
        "balance": ("balance", "current_balance", "avail_bal"),
        "opened_date": ("opened_date", "opening_date", "account_open_date"),
        "is_frozen": ("is_frozen", "frozen", "blocked", "frozen_flag"),
        "kyc_status": ("kyc_status", "kyc", "kyc_verified"),
    },
    "upi_ids": {
        "vpa": ("vpa", "upi_id", "upi", "virtual_payment_address"),
        "registered_to": ("registered_to", "holder", "person_id", "customer_id"),
        "linked_account": ("linked_account", "account_id", "account_number"),
        "is_active": ("is_active", "active", "status"),
        "txn_count": ("txn_count", "transaction_count", "total_txns"),
    },
    "complaints": {
        "complaint_number": ("complaint_number", "complaint_id", "fir", "fir_number", "complaint_no"),
        "fraud_type": ("fraud_type", "type", "category", "crime_type"),
        "narrative": ("narrative", "description", "complaint_text", "details", "text", "body"),
        "loss_amount": ("loss_amount", "amount", "loss", "claim_amount"),
        "currency": ("currency",),
        "incident_date": ("incident_date", "date_of_incident", "crime_date", "date"),
        "reported_date": ("reported_date", "report_date", "filing_date"),
        "police_station": ("police_station", "ps", "station", "ps_name"),
    },
    "phones": {
        "number": ("number", "phone", "phone_number", "mobile", "msisdn", "contact"),
        "operator": ("operator", "telecom", "network", "service_provider"),
        "circle": ("circle", "state", "region", "telecom_circle"),
        "registered_to": ("registered_to", "subscriber", "owner", "name"),
        "is_active": ("is_active", "active", "status"),
    },
    "locations": {
        "city": ("city", "town", "district"),
        "state": ("state", "province", "region"),
        "pincode": ("pincode", "pin", "postal_code", "zip"),
        "address": ("address", "addr", "location", "place"),
        "lat": ("lat", "latitude", "gps_lat"),
        "lon": ("lon", "lng", "longitude", "gps_lon", "gps_lng"),
    },
}
# Header names that tell a record type, in the order of the types' priority.
TYPE_KEYS = {
    "devices": ("imei", "device_id", "device_model"),
    "sims": ("iccid", "imsi", "sim_serial", "sim_swaps"),
    "upi_ids": ("vpa", "upi_id", "virtual_payment_address"),
    "calls": ("caller", "caller_id", "msisdn_a", "a_party", "b_party", "call_duration"),
    "bank_accounts": ("account_number", "acc_number", "ifsc", "account_holder"),
    "complaints": ("complaint_number", "fir", "narrative", "complaint_text", "crime_type"),
    "locations": ("lat", "latitude", "longitude", "gps_lat"),
    "phones": ("msisdn", "phone_number", "mobile", "telecom", "circle"),
    "transactions": ("amount", "txn_amount", "src_account", "dst_account", "sender_account", "debit"),
}
TIMES = {"timestamp", "issue_date", "last_swap_date", "first_seen", "last_seen", "opened_date", "incident_date", "reported_date"}
DEFAULTS = {"currency": "INR", "call_type": "unknown", "account_type": "savings", "kyc_status": "unknown"}


def pick(columns: list[str], names: tuple[str, ...]) -> Column:
    """IN-1: the first non-blank value among the names that the table has, whatever their case."""
    have = {c.lower().strip(): c for c in reversed(columns)}
    found = [blank_null(F.col(f"`{have[n]}`").cast("string")) for n in names if n in have]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def detect_type(columns: list[str]) -> str:
    """IN-14 on a table's header."""
    have = {c.lower().strip() for c in columns}
    return next((t for t, keys in TYPE_KEYS.items() if have & set(keys)), "unknown")


def detect_type_of(header: Column) -> Column:
    """IN-14 on a column with the header names of each file (array of text)."""
    low = F.transform(header, lambda h: F.lower(F.trim(h)))
    out = F
    for t, keys in TYPE_KEYS.items():
        out = out.when(F.arrays_overlap(low, F.array(*[F.lit(k) for k in keys])), t)
    return out.otherwise("unknown")


def _seconds(x: Column, lenient: bool) -> Column:
    """Text of a duration; strictly "120sec" is none, as the s goes before sec is looked for."""
    if lenient:
        return F.regexp_extract(x, r"^\s*(\d+)", 1).try_cast("int")
    return F.trim(F.replace(F.replace(x, F.lit("s"), F.lit("")), F.lit("sec"), F.lit(""))).try_cast("int")


def _field(kind: str, field: str, x: Column, lenient: bool) -> Column:
    if field in ("amount", "loss_amount", "balance"):
        return amount(x)
    if field in TIMES:
        return ingest_time(x)
    if field == "duration_sec":
        return _seconds(x, lenient)
    if field in ("swap_count", "txn_count"):
        return F.coalesce(F.trim(x).try_cast("int"), F.lit(0))
    if field in ("lat", "lon"):
        return F.trim(x).try_cast("double")
    if field == "kyc_verified":
        return F.coalesce(yes(x, "true", "yes", "1", "verified"), F.lit(False))
    if field == "is_frozen":
        return F.coalesce(yes(x, "true", "yes", "1"), F.lit(False))
    if field == "is_active":
        return yes(x, "true", "active", "yes", "1", default="true")
    return F.coalesce(x, F.lit(DEFAULTS[field])) if field in DEFAULTS else x


def canonical(kind: str, value: Callable[[tuple[str, ...]], Column], lenient: bool = False) -> tuple[dict[str, Column], Column]:
    """The canonical fields of a record type and the error of a row; value: the text of a row under any of some names."""
    texts = {f: value(names) for f, names in ALIASES[kind].items()}
    fields = {f: _field(kind, f, x, lenient) for f, x in texts.items()}
    error = F.lit(None).cast("string")
    if kind == "upi_ids":  # a count that is no whole number fails the row
        bad = texts["txn_count"].isNotNull() & F.trim(texts["txn_count"]).try_cast("int").isNull()
        error = F.when(bad, F.concat(F.lit("txn_count is no whole number: "), texts["txn_count"]))
    if kind == "locations":  # both or none
        bad = (texts["lat"].isNotNull() & fields["lat"].isNull()) | (texts["lon"].isNotNull() & fields["lon"].isNull())
        fields |= {c: F.when(~bad, fields[c]) for c in ("lat", "lon")}
    return fields, error


def normalise(raw: DataFrame, kind: str | None = None, lenient: bool = False) -> DataFrame:
    """IN-2 to IN-15: the canonical columns of a record type, the columns of `provenance` that raw has, and `error`
    (null for good rows). An unknown type keeps its columns as one JSON text. kind overrides what the header tells."""
    kind = kind or detect_type(raw.columns)
    kept = [F.col(c) for c in ("source_file", "source_record_id", "case_id", "evidence_id", "ingested_at") if c in raw.columns]
    if kind not in ALIASES:
        return raw.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns])).alias("payload"), *kept, F.lit(None).cast("string").alias("error"))
    fields, error = canonical(kind, lambda names: pick(raw.columns, names), lenient)
    ids = pick(raw.columns, ("id",))
    return raw.select(ids.alias("id"), *[x.alias(f) for f, x in fields.items()], *kept, error.alias("error"))


def good_and_bad(rows: DataFrame, first: int = 20) -> tuple[DataFrame, DataFrame]:
    """IN-17: good rows, and the first error messages."""
    return rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL").select("error").limit(first)


def numbered(rows: DataFrame, name: str, file: str = "source_file") -> DataFrame:
    """rows of a file source with the name of their file and their number in it from 0, in the order of the file.

    Rows are counted by block of a file (what one task reads), and numbered inside it on top of the blocks before.
    """
    rows = rows.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b")).withColumn("_m", F.monotonically_increasing_id())
    blocks = rows.groupBy("_f", "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("_f", "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    n = F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_m")) - 1
    return rows.withColumn("_n", n).join(blocks, ["_f", "_b"]).withColumn(name, (F.col("_before") + F.col("_n")).cast("long")).drop("_f", "_b", "_m", "_n", "_before")


def with_provenance(raw: DataFrame, case_id: str, evidence_id: str, as_of: str) -> DataFrame:
    """IN-16: file name, row number inside the file from 0, case, evidence and time. For file sources."""
    return numbered(raw, "source_record_id").withColumns({"case_id": F.lit(case_id), "evidence_id": F.lit(evidence_id), "ingested_at": F.lit(as_of)})


def manifest(rows: DataFrame) -> DataFrame:
    """IO-17: per file, case and record type: total, normalised and skipped rows."""
    return rows.groupBy("source_file", "case_id", "record_type").agg(F.count("*").alias("total_rows"), F.count(F.when(F.col("error").isNull(), 1)).alias("normalised"), F.count(F.when(F.col("error").isNotNull(), 1)).alias("skipped"))
