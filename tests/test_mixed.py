"""A folder of files of every record type, typed in one scan, equals the single types."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from casegraph.sources import ingest as I
from casegraph.sources import mixed as MX

FILES = {
    "tx.csv": 'txn_amount,from_account,to_account,remarks\n"1,200.50",A1,A2,"paid, in part"\n7,A3,A4,\n',
    "calls.csv": "a_party,b_party,dur\n9,8,12s\n",
    "sims.txt": "iccid|swaps\n8901|2\n8902|x\n",
    "devices.txt": "IMEI;Make\n3001;Acme\n",
    "accounts.csv": "acno,IFSC,blocked\n1,HDFC0000001,YES\n",
    "upi.csv": "VPA,total_txns\nu@ybl,3\nv@ybl,many\n",
    "phones.csv": "contact,telecom\n9000000000,Air\n",
    "places.csv": "town,latitude,gps_lon\nPune,12.5,3\nGoa,north,3\n",
    "other.csv": "colour,Colour,size\nred,blue,1\n",
    "empty.csv": "vpa,total_txns\n",
}
JSONS = {"cases.json": [{"FIR": "F/1", "loss": "5"}, {"FIR": "F/2", "details": None}], "wrapped.json": {"note": 1, "complaints": [{"fir": "F/3"}]}, "one.json": {"fir": "F/4", "loss": 7}}


def test_a_folder_of_all_types(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    for name, value in JSONS.items():
        (tmp_path / name).write_text(json.dumps(value))
    mixed = MX.normalise_mixed(MX.read_mixed(spark, str(tmp_path)))
    got = {}
    for r in mixed.collect():
        got.setdefault(r["kind"], []).append((r["source_file"], r["row"], json.loads(r["record"]), r["error"]))
    assert {k: len(v) for k, v in got.items()} == {"transactions": 2, "calls": 1, "sims": 2, "devices": 1, "bank_accounts": 1, "upi_ids": 2, "complaints": 4, "phones": 1, "locations": 2, "unknown": 1}
    assert [x[2] for x in got["unknown"]] == [{"colour": "red", "size": "1"}]
    tx = sorted((r["row"], r["src_account"], r["amount"], r["narration"]) for r in MX.of_kind(mixed, "transactions").collect())
    assert tx == [(0, "A1", 1200.5, "paid, in part"), (1, "A3", 7.0, None)]
    assert sorted((r["vpa"], r["txn_count"], r["error"]) for r in MX.of_kind(mixed, "upi_ids").collect()) == [("u@ybl", 3, None), ("v@ybl", 0, "txn_count is no whole number: many")]
    assert sorted((r["complaint_number"], r["loss_amount"]) for r in MX.of_kind(mixed, "complaints").collect()) == [("F/1", 5.0), ("F/2", None), ("F/3", None), ("F/4", 7.0)]
    single = I.normalise(spark.read.option("header", True).csv(str(tmp_path / "places.csv"))).drop("error")
    assert sorted(map(str, MX.of_kind(mixed, "locations").select(*single.columns).collect())) == sorted(map(str, single.collect()))
    hinted = MX.normalise_mixed(MX.read_mixed(spark, str(tmp_path)).selectExpr("*", "if(source_file = 'phones.csv', 'sims', NULL) AS hint"))
    assert hinted.where("kind = 'sims'").count() == 3


def test_quoted_values_over_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\n  \ntxn_amount,from_account,to_account,remarks\n1,A1,B1,"one\n\n  \n""two"", three"\n,,,\n\n2,A2,B2,5" pipe\n')
    (tmp_path / "b.csv").write_text('"narrative","FIR"\n"lost, all\nof it",F/1\n')
    (tmp_path / "c.txt").write_text('iccid|swaps\n"8901|2\n')
    (tmp_path / "empty.csv").write_text("vpa,total_txns\n")
    (tmp_path / "nothing.csv").write_text("")
    (tmp_path / "d.json").write_text('{"fir": "F/4"}')
    mixed = MX.normalise_mixed(MX.read_mixed(spark, str(tmp_path), multiline=True))
    tx = sorted((r["row"], r["src_account"], r["amount"], r["narration"]) for r in MX.of_kind(mixed, "transactions").collect())
    assert tx == [(0, "A1", 1.0, 'one\n\n  \n"two", three'), (1, None, None, None), (2, "A2", 2.0, '5" pipe')]
    assert sorted((r["row"], r["complaint_number"], r["narrative"]) for r in MX.of_kind(mixed, "complaints").collect()) == [(0, "F/1", "lost, all\nof it"), (0, "F/4", None)]
    assert [r["iccid"] for r in MX.of_kind(mixed, "sims").collect()] == ['"8901']


def test_whole_lines_are_the_same_either_way(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    read = lambda **how: sorted(map(str, MX.read_mixed(spark, str(tmp_path), **how).withColumn("fields", F.array_sort(F.map_entries("fields"))).collect()))
    assert read() == read(multiline=True)
