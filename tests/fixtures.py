"""The pattern fixture of FIXTURES.md, section 1."""

from __future__ import annotations

VERTICES = [(i, t, i, r) for i, t, r in [
    ("p_001", "PERSON", 0.8), ("p_002", "PERSON", 0.7), ("p_003", "VICTIM", 0.05), ("ph_001", "PHONE", 0.5), ("ph_002", "PHONE", 0.5), ("ph_003", "PHONE", 0.5), ("acc_001", "BANK_ACCOUNT", 0.6), ("acc_002", "BANK_ACCOUNT", 0.6),
    ("acc_003", "BANK_ACCOUNT", 0.6), ("acc_004", "BANK_ACCOUNT", 0.6), ("sim_001", "SIM", 0.5), ("dev_001", "DEVICE", 0.5),
]]
EDGES = [
    ("ph_001", "sim_001", "USES", 0.9), ("ph_002", "sim_001", "USES", 0.9), ("p_001", "ph_001", "OWNS", 0.9), ("p_002", "ph_002", "OWNS", 0.9), ("p_001", "acc_001", "OWNS", 0.9), ("p_002", "acc_002", "OWNS", 0.9),
    ("dev_001", "acc_001", "LINKED_TO", 0.9), ("dev_001", "acc_002", "LINKED_TO", 0.9), ("dev_001", "acc_003", "LINKED_TO", 0.9), ("ph_001", "acc_001", "LINKED_TO", 0.8), ("p_001", "p_003", "ASSOCIATED_WITH", 0.7),
    ("acc_001", "acc_002", "LINKED_TO", 0.8), ("acc_002", "acc_003", "LINKED_TO", 0.8), ("acc_003", "acc_001", "LINKED_TO", 0.8), ("ph_001", "ph_002", "CALLED", 0.9), ("ph_001", "ph_003", "CALLED", 0.9), ("ph_003", "acc_004", "LINKED_TO", 0.8),
]
_T = [(1, 1, 2, 100000, 8), (2, 1, 2, 80000, 9), (3, 2, 3, 90000, 10), (4, 2, 4, 80000, 11), (5, 3, 4, 50000, 10.5), (6, 1, 3, 10000, 12), (7, 1, 4, 15000, 13), (8, 1, 2, 20000, 14), (9, 1, 3, 5000, 15), (10, 1, 4, 7000, 16)]
TRANSFERS = [(i, "c1", f"acc_00{a}", f"acc_00{b}", float(x), int(h * 3_600_000_000), "") for i, a, b, x, h in _T]
CALLS = [("c1", a, b) for a, b in [
    *[("ph_001", x) for x in ("ph_002", "ph_003", "9111111111", "9222222222", "9333333333", "9444444444")], ("ph_002", "ph_003"), ("ph_003", "ph_002"),
    ("9500000001", "ph_001"), ("9500000002", "ph_001"), ("9500000003", "ph_002"), ("9500000004", "ph_003"), ("9500000005", "ph_003"),
]]


def frames(spark):
    v = spark.createDataFrame(VERTICES, "id string, type string, label string, risk double")
    e = spark.createDataFrame([(*x, "observed") for x in EDGES], "src string, dst string, rel string, confidence double, evidence_source string")
    t = spark.createDataFrame(TRANSFERS, "id long, case_id string, src string, dst string, amount double, us long, description string")
    c = spark.createDataFrame(CALLS, "case_id string, caller string, receiver string")
    return v, e, t, c
