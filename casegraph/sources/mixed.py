"""IN-14, IN-15, IO-1 to IO-3 for folders whose files hold records of different types: one scan, typed file by file.

Every row is a map from its file's header to its values. The header tells the record type of the file, and the canonical fields of
that type are one column of JSON, so that no type needs a pass of its own; `of_kind` gives a type's rows as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.functions.expr import blank_null
from casegraph.sources import ingest as I
from casegraph.sources.io import SEPARATORS, WRAPPERS

MAPS = "array<map<string,string>>"


QUOTES = {"quote": '"', "escape": '"'}


def _records(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """path, source_file, line_no (of the record, the header being 0) and cells of CSV files whose quoted values may span lines."""
    raw = spark.read.schema(", ".join(f"{n} string" for n in names)).options(recursiveFileLookup=True, pathGlobFilter="*.csv", multiLine=True, **QUOTES).csv(folder)
    raw = raw.select(F.array(*names).alias("cells"), F.col("_metadata.file_path").alias("path"), "_metadata")
    blank = (F.trim(F.get("cells", F.lit(0))) == "") & (F.size(F.array_compact("cells")) == 1)  # the reader leaves empty lines out
    return I.numbered(raw.where(~F.coalesce(blank, F.lit(False))), "line_no")


def _split_lines(spark: SparkSession, folder: str, multiline: bool) -> DataFrame:
    """Rows of CSV files (commas, quoted values) and of TXT files (the first separator that splits the header)."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{csv,txt}").text(folder).where(F.trim("value") != "")
    lines = I.numbered(lines.select("value", F.col("_metadata.file_path").alias("path"), "_metadata"), "line_no")
    heads = lines.groupBy("path").agg(F.min(F.struct("line_no", "value")).alias("h"), F.count("*").alias("n")).select("path", "n", "h.*").withColumnsRenamed({"line_no": "head_no", "value": "head"})
    csv, sep = F.endswith(F.lower("path"), F.lit(".csv")), F
    for s in SEPARATORS:
        sep = sep.when(F.contains("head", F.lit(s)), F.lit(s))
    heads = heads.withColumn("sep", F.when(csv, F.lit(",")).otherwise(sep)).where("sep IS NOT NULL")
    wide = heads.agg(F.max(F.size(F.split("head", ","))).alias("n")).first()["n"] or 1  # one number
    names = [f"c{k}" for k in range(wide)]
    parsed = lambda c: F.array(*[F.from_csv(c, ", ".join(f"{n} string" for n in names), QUOTES)[n] for n in names])
    plain = lambda c: F.split(c, F.concat(F.lit(r"\Q"), F.col("sep"), F.lit(r"\E")), -1)
    cells = lambda c: F.when(F.endswith(F.lower("path"), F.lit(".csv")), parsed(c)).otherwise(plain(c))
    heads = heads.withColumn("names", F.filter(F.transform(cells("head"), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False))))
    if multiline:
        records = _records(spark, folder, names).join(heads.select("path", F.lit(0).alias("head_no"), "names"), "path")
        lines, heads = lines.where(~csv), heads.where(~csv)
    rows = lines.join(heads.select("path", "head_no", "sep", "names"), "path").withColumn("cells", cells("value")).select("source_file", "line_no", "head_no", "names", "cells")
    rows = (rows.unionByName(records.select(*rows.columns)) if multiline else rows).where("line_no > head_no")
    entries = F.transform("names", lambda n, k: F.struct(n.alias("key"), F.trim(F.get("cells", k)).alias("value")))
    return rows.select("source_file", (F.col("line_no") - F.col("head_no") - 1).alias("row"), _by_name(entries).alias("fields"))


def _json_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of JSON files: an array of objects, one object, or an object that wraps the records in a known field."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", True).text(folder).select(F.col("_metadata.file_name").alias("source_file"), F.trim("value").alias("value"))
    found = [F.get_json_object("value", f"$.{w}") for w in WRAPPERS]
    inside = F.coalesce(*[F.when(F.startswith(x, F.lit("[")), x) for x in found])
    records = F.when(F.startswith("value", F.lit("[")), F.from_json("value", MAPS)).when(inside.isNotNull(), F.from_json(inside, MAPS)).otherwise(F.array(F.from_json("value", "map<string,string>")))
    rows = files.select("source_file", F.posexplode(records).alias("row", "fields")).where("fields IS NOT NULL")
    return rows.select("source_file", F.col("row").cast("long").alias("row"), _by_name(F.map_entries("fields")).alias("fields"))


def _by_name(entries: Column) -> Column:
    """A map by lower-cased names; of equal ones the first counts."""
    low = F.transform(entries, lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(F.filter(low, lambda e, k: ~F.exists(F.slice(low, F.lit(1), k), lambda s: s["key"] == e["key"])))


def read_mixed(spark: SparkSession, folder: str, multiline: bool = False) -> DataFrame:
    """source_file, row (from 0 in its file) and fields (a map by lower-cased header) of all CSV, TXT and JSON files below folder.

    multiline: quoted values of CSV files may span lines (headers may not). A CSV file is then read by one task, and its lines once
    more for the headers; without it, files are split like any text.
    """
    return _split_lines(spark, folder, multiline).unionByName(_json_files(spark, folder))


def normalise_mixed(rows: DataFrame, lenient: bool = False) -> DataFrame:
    """source_file, row, kind, record (JSON of the canonical fields, or of what an unknown type holds) and error.

    rows: as of read_mixed; where they have a column `hint`, it overrides what the header tells.
    """
    told = I.detect_type_of(F.map_keys("fields"))
    rows = rows.withColumn("kind", F.coalesce("hint", told) if "hint" in rows.columns else told)
    # What a type's fields may be called, and which of its fields are times, are looked up by type, so that each is one expression and not
    # one for each field of each type.
    of = {kind: [*names.values(), ("id",)] for kind, names in I.ALIASES.items()}
    place = {kind: {names: k for k, names in enumerate(found)} for kind, found in of.items()}
    times = {kind: [k for k, f in enumerate(names) if f in I.TIMES] for kind, names in I.ALIASES.items()}
    table = lambda values, one: F.create_map(*[x for kind, found in values.items() for x in (F.lit(kind), F.array(*[one(v) for v in found]))])
    names_of = F.try_element_at(table(of, lambda v: F.array(*[F.lit(n) for n in v])), F.col("kind"))
    times_of = F.try_element_at(table(times, F.lit).cast("map<string,array<int>>"), F.col("kind"))
    first = lambda names: F.get(F.filter(F.transform(names, lambda n: blank_null(F.try_element_at("fields", n))), lambda x: x.isNotNull()), F.lit(0))
    rows = rows.withColumn("texts", F.transform(names_of, first)).withColumn("times", F.transform(times_of, lambda k: I.ingest_time(F.get("texts", k))))
    record, error = F, F
    for kind, found in I.ALIASES.items():
        fields, bad = I.canonical(kind, lambda names, kind=kind: F.get("texts", F.lit(place[kind][names])), lenient)
        fields |= {f: F.get("times", F.lit(k)) for k, f in enumerate(x for x in found if x in I.TIMES)}
        record = record.when(F.col("kind") == kind, F.to_json(F.struct(F.get("texts", F.lit(len(found))).alias("id"), *[x.alias(f) for f, x in fields.items()])))
        error = error.when(F.col("kind") == kind, bad)
    return rows.select("source_file", "row", "kind", record.otherwise(F.to_json("fields")).alias("record"), error.alias("error"))


def of_kind(mixed: DataFrame, kind: str) -> DataFrame:
    """The rows of one type with its canonical columns, as ingest.normalise gives them."""
    spark = mixed.sparkSession
    schema = I.normalise(spark.createDataFrame([], "id string"), kind).drop("error").schema
    return mixed.where(F.col("kind") == kind).select("source_file", "row", F.from_json("record", schema).alias("r"), "error").select("source_file", "row", "r.*", "error")
