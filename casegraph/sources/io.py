"""File sources and sinks, stores keyed by case, and searches over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegraph.functions.expr import key12
from casegraph.functions.scratch import exists, materialise, passing
from casegraph.sources.ingest import numbered

# Fields that may hold the records of a JSON object, in the order they are tried.
WRAPPERS = ("records", "data", "items", "results", "rows", "transactions", "calls", "sims", "devices", "bank_accounts", "upi_ids", "complaints", "phones", "locations")
SEPARATORS = (",", "\t", "|", ";")
EXTENSIONS = ("csv", "json", "txt", "xlsx")
BUCKETS = 64  # of the cases in a store of results


def read_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """IO-1: all columns as text, header from the file; broken UTF-8 is replaced."""
    return spark.read.option("header", True).option("encoding", "UTF-8").option("inferSchema", False).option("enforceSchema", False).csv(paths)


def read_json(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """IO-2: an array of objects, one object, or an object that wraps the records in a known field; values as text."""
    raw = spark.read.option("multiLine", True).option("primitivesAsString", True).option("mode", "PERMISSIVE").json(paths)
    wrapped = [f.name for w in WRAPPERS for f in raw.schema if f.name == w and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if not wrapped:
        return raw
    names = {n for w in wrapped for n in raw.schema[w].dataType.elementType.names}
    struct = lambda w: F.transform(w, lambda r: F.struct(*[(r[n] if n in raw.schema[w].dataType.elementType.names else F.lit(None).cast("string")).alias(n) for n in sorted(names)]))
    return raw.select(F.inline(F.coalesce(*[struct(w) for w in wrapped])))


def read_delimited(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """IO-3: text files with a header, each with the first separator that splits it: source_file, row (from 0) and `fields`, a map from header to value.

    Files are read by line, so one of any size is split over tasks; a table of one header for each file joins back.
    """
    lines = numbered(spark.read.text(paths).where(F.trim("value") != ""), "line_no")
    first = F.min(F.struct("line_no", "value"))
    heads = lines.groupBy("source_file").agg(first["line_no"].alias("head_no"), first["value"].alias("head"), F.count("*").alias("n"))
    sep = F
    for s in SEPARATORS:
        sep = sep.when(F.contains("head", F.lit(s)) & (F.col("n") > 1), F.lit(s))
    literal = lambda c: F.concat(F.lit(r"\Q"), F.col(c), F.lit(r"\E"))
    heads = heads.withColumn("sep", sep).where("sep IS NOT NULL").withColumn("names", F.split("head", literal("sep")))
    rows = lines.join(heads.select("source_file", "head_no", "sep", "names"), "source_file").where("line_no > head_no")
    values = F.split("value", literal("sep"), -1)
    fields = F.map_from_arrays(F.transform("names", lambda n: F.trim(n)), F.transform(F.sequence(F.lit(1), F.size("names")), lambda k: F.trim(F.try_element_at(values, k))))
    return rows.select("source_file", (F.col("line_no") - F.col("head_no") - 1).alias("row"), fields.alias("fields"))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """IO-4: each non-blank line, trimmed."""
    return spark.read.text(paths).select(F.trim("value").alias("text")).where(F.length("text") > 0)


def load_transfers(normal: DataFrame, fraud: DataFrame) -> DataFrame:
    """IO-5: both tables with is_fraud_tx 0 or 1; columns that one lacks are null."""
    return normal.withColumn("is_fraud_tx", F.lit(0)).unionByName(fraud.withColumn("is_fraud_tx", F.lit(1)), allowMissingColumns=True)


def first_per_file(df: DataFrame, n: int) -> DataFrame:
    """IO-5: at most n rows of each file (a row cap that the caller asks for)."""
    return numbered(df, "_no", "_file").where(F.col("_no") < n).drop("_no", "_file")


def write_json(df: DataFrame, path: str) -> None:
    """IO-7."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """IO-8: the named fields that df has, null where it lacks one."""
    df.select(*[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields]).write.mode("overwrite").option("header", True).csv(path)


def append(df: DataFrame, path: str, as_of: str, id_field: str = "id", prefix: str = "rec_") -> None:
    """IO-9: append; an id and created_at are filled in where missing (the id from the row's content)."""
    have = df.columns
    made = key12(prefix, F.to_json(F.struct(*[F.col(c) for c in have if c != id_field])))
    out = df.withColumn(id_field, F.coalesce(F.col(id_field), made) if id_field in have else made)
    out = out.withColumn("created_at", F.coalesce(F.col("created_at"), F.lit(as_of)) if "created_at" in have else F.lit(as_of))
    out.write.mode("append").parquet(path)


def store(df: DataFrame, path: str) -> None:
    """IO-10: append into a store by case and record type."""
    df.write.mode("append").partitionBy("case_id", "record_type").parquet(path)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("case_id"), F.lit(BUCKETS)).cast("int")


def replace_case(df: DataFrame, path: str) -> None:
    """IO-11, IO-19: replace the results of the cases in df, leave those of others.

    The store has a fixed number of buckets of cases, not a folder for each: the buckets touched are written anew.
    """
    spark = df.sparkSession
    with passing():
        new = materialise(df.withColumn("bucket", _bucket()))
        if exists(spark, path):
            old = spark.read.parquet(path).join(F.broadcast(new.select("bucket").distinct()), "bucket", "left_semi")  # BUCKETS rows
            old = old.join(new.select("case_id").distinct(), "case_id", "left_anti")
            new = materialise(new.unionByName(old, allowMissingColumns=True))
        new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def of_stored(spark: SparkSession, path: str, case_id: str) -> DataFrame:
    """PT-12, RO-10, CB-10: what replace_case stored for a case; only its bucket is read."""
    rows = spark.read.parquet(path).where(F.col("case_id") == case_id)
    number = spark.range(1).select(F.lit(case_id).alias("case_id")).select(_bucket()).first()[0]
    return rows.where(F.col("bucket") == number).drop("bucket")


def merge_updates(rows: DataFrame, updates: DataFrame, as_of: str, key: str = "id") -> DataFrame:
    """IO-12: rows with the non-null values of the updates; updated_at is set where one applies."""
    u = updates.select(F.col(key), *[F.col(c).alias(f"_u_{c}") for c in updates.columns if c != key], F.lit(True).alias("_hit"))
    out = rows.join(u, key, "left")
    fields = {c: F.coalesce(F.col(f"_u_{c}"), F.col(c)) if c in rows.columns else F.col(f"_u_{c}") for c in updates.columns if c != key}
    stamp = F.when(F.col("_hit"), F.lit(as_of))
    fields["updated_at"] = F.coalesce(stamp, F.col("updated_at")) if "updated_at" in rows.columns else stamp
    return out.withColumns(fields).drop("_hit", *[f"_u_{c}" for c in updates.columns if c != key])


def find(rows: DataFrame, where: Column) -> DataFrame:
    """IO-13."""
    return rows.where(where)


def live_or_sample(live: DataFrame, sample: DataFrame, key: str = "case_id") -> DataFrame:
    """IO-14: live rows, and sample rows of the cases without any."""
    return live.unionByName(sample.join(live.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def of_case(rows: DataFrame, case_id: str, fallback_all: bool = False) -> DataFrame:
    """IO-15: rows of the case; with fallback_all, all rows where none carries it."""
    mine = rows.where(F.col("case_id") == case_id)
    return rows if fallback_all and mine.isEmpty() else mine


def validate_files(files: DataFrame, max_mb: float = 50) -> DataFrame:
    """IO-16: rows of the binaryFile source with the errors of each: extension, size, length of the name, missing data rows, broken JSON.

    Spark's file sources skip files without a byte: one that was listed but has no row here is empty. Names and lengths are judged
    alone; contents are read of CSV and JSON files within the size only (the source takes the bound on length before it reads).
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    text = F.decode("content", "UTF-8")
    lines = F.size(F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != ""))
    checks = [(~ext.isin(*EXTENSIONS), "extension not allowed"), (F.col("length") == 0, "empty file"), (F.col("length") > max_mb * 1024 * 1024, "too large"), (F.length(name) > 255, "name too long")]
    told = lambda of: F.array_compact(F.array(*[F.when(c, F.lit(e)) for c, e in of]))
    inside = [((ext == "csv") & (lines < 2), "no data row"), ((ext == "json") & F.try_parse_json(text).isNull(), "not JSON")]
    read = files.where(F.col("length").between(1, int(max_mb * 1024 * 1024)) & ext.isin("csv", "json")).select("path", told(inside).alias("inside")).where(F.size("inside") > 0)
    errors = F.concat("errors", F.coalesce("inside", F.array().cast("array<string>")))
    return files.select("path", "length", told(checks).alias("errors")).join(read, "path", "left").select("path", "length", errors.alias("errors"))
