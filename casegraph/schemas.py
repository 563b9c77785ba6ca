"""Canonical schemas, enumerations and type families."""

from __future__ import annotations

from pyspark.sql import types as T

# Entity types, relationship types and evidence sources that validation accepts.
ENTITY_TYPES = (
    "PERSON", "PHONE", "SIM", "DEVICE", "IMEI", "BANK_ACCOUNT", "UPI_ID", "TRANSACTION", "VICTIM", "SUSPECT",
    "LOCATION", "IP_ADDRESS", "CASE", "ORGANIZATION", "EVIDENCE",
)
RELATIONSHIP_TYPES = (
    "OWNS", "USES", "CONTROLS", "CALLED", "TRANSFERRED_TO", "PAID_TO", "ASSOCIATED_WITH", "USED_DEVICE",
    "REGISTERED_TO", "LOCATED_AT", "INVOLVED_IN", "VICTIM_OF", "SUSPECTED_IN", "PART_OF",
)
EVIDENCE_SOURCES = ("observed", "inferred", "ai_generated")

# Type families of the graph algorithms; types are compared upper-cased.
ACCOUNT = ("BANK_ACCOUNT", "UPI_ID", "ACCOUNT")
DEVICE = ("DEVICE", "IMEI")
SIM_SWAP = ("SIM", "SIM_CARD")
SIM = ("SIM", "SIM_CARD", "ICCID")
MONEY = ("TRANSFERRED_TO", "PAID_TO")
PHONE_OR_PERSON = ("PHONE", "PERSON")
TECHNICAL = ("DEVICE", "IMEI", "SIM", "SIM_CARD", "ICCID", "IP_ADDRESS")


def _struct(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "i": T.IntegerType(), "l": T.LongType(), "b": T.BooleanType(), "as": T.ArrayType(T.StringType()), "m": T.MapType(T.StringType(), T.StringType()), "t": T.TimestampType()}
    return T.StructType([T.StructField(n, kinds[k or "s"]) for n, _, k in (x.partition(":") for x in spec.split())])


PROVENANCE = "source_file source_record_id:l case_id evidence_id ingested_at"
TRANSACTIONS = _struct(f"id src_account dst_account amount:d currency method narration timestamp risk_score:d flagged:b {PROVENANCE}")
CALLS = _struct(f"id caller_id receiver_id duration_sec:i call_type cell_tower timestamp {PROVENANCE}")
SIMS = _struct(f"id iccid imsi operator phone_number registered_to kyc_verified:b swap_count:i issue_date last_swap_date {PROVENANCE}")
DEVICES = _struct(f"id imei brand model os registered_to first_seen last_seen {PROVENANCE}")
BANK_ACCOUNTS = _struct(f"id account_number bank ifsc account_type holder_name holder_id balance:d opened_date is_frozen:b kyc_status {PROVENANCE}")
UPI_IDS = _struct(f"id vpa registered_to linked_account is_active:b txn_count:i {PROVENANCE}")
COMPLAINTS = _struct(f"id complaint_number fraud_type narrative loss_amount:d currency incident_date reported_date police_station {PROVENANCE}")
PHONES = _struct(f"id number operator circle registered_to is_active:b {PROVENANCE}")
LOCATIONS = _struct(f"id city state pincode address lat:d lon:d {PROVENANCE}")
EVIDENCE = _struct("id case_id type record_type filename raw_path processed_path total_rows:l normalised:l skipped:l uploaded_by uploaded_at")
ENTITIES = _struct("entity_id type value raw_value confidence:d evidence_source evidence_ids:as case_ids:as source_texts:as attributes:m extracted_at updated_at")
RELATIONSHIPS = _struct("relationship_id source_entity source_type source_value relationship target_entity target_type target_value confidence:d evidence_source evidence_ids:as case_ids:as source_text attributes:m extracted_at updated_at")
CASES = _struct("id title description fraud_pattern severity status jurisdiction assigned_to total_loss_inr:d victim_ids:as suspect_ids:as tags:as created_by created_at updated_at closed_at")
AUDIT = _struct("id timestamp user user_id action case_id entity_id status metadata:m ip_address")
VERTICES = _struct("id type label value confidence:d risk:d case_ids:as evidence_ids:as attributes:m seq:l")
EDGES = _struct("edge_id src dst rel confidence:d evidence_source case_ids:as evidence_ids:as attributes:m seq:l")
