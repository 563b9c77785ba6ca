"""Rule-based entities and relationships from text, as Catalyst expressions over a table of documents (doc_id, text)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegraph import schemas as S
from casegraph.functions.expr import blank_null, key12

SNIPPET = 200


@dataclass(frozen=True)
class Rule:
    """One extractor: type, pattern, group, confidence; value turns the match into the value."""

    type: str
    pattern: str
    confidence: float
    group: int = 0
    source: str = "observed"


# Patterns and confidences of the entity rules. (?U) makes classes Unicode-aware; the UPI handles and
# transaction prefixes are matched whatever the case.
RULES = (
    Rule("PHONE", r"(?U)\b(?:\+91[-\s]?)?[6-9]\d{9}\b", 0.92),
    Rule("IMEI", r"(?U)\b\d{15}\b", 0.88),
    Rule("SIM", r"(?U)\b89\d{17,18}\b", 0.85),
    Rule("UPI_ID", r"(?iU)\b[\w.\-]+@(?:okaxis|oksbi|okicici|okhdfcbank|ybl|ibl|paytm|upi|apl|axl)\b", 0.95),
    Rule("BANK_ACCOUNT", r"(?U)\b[A-Z]{4}0[A-Z0-9]{6}\b", 0.72),
    Rule("TRANSACTION", r"(?iU)\b(?:TXN|UTR|IMPS|NEFT|UPI)[A-Z0-9]{8,20}\b", 0.89),
    Rule("CASE", r"(?iU)\b(?:FIR|CMP|CASE)[/\-]\d{3,}[/\-]\d{4}\b", 0.93),
    Rule("IP_ADDRESS", r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.82),
    Rule("PERSON", r"(?U)\b(?:accused|suspect|victim|complainant|named|person|individual|called|Mr\.?|Ms\.?|Mrs\.?|Sh\.?|Smt\.?)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b", 0.78),
    Rule("ORGANIZATION", r"(?U)\b((?:[A-Z][A-Za-z&\s]+)\s+(?:Ltd|Limited|Pvt|Private|Bank|Finance|Insurance|Corp|Corporation|Agency|Bureau|Foundation|Trust|Co\.))\b", 0.71, 1),
    Rule("LOCATION", r"(?U)\b(?:at|in|from|near|located at)\s+([A-Z][a-zA-Z\s,]{4,60}?)(?:\.|,|;|\n|$)", 0.65, 1, "inferred"),
)
PRIVATE_IP = r"^(?:10|172\.(?:1[6-9]|2\d|3[01])|192\.168)\."
CUE = r"(?U)^(accused|suspect|victim|complainant|named|person|individual|called|Mr\.?|Ms\.?|Mrs\.?|Sh\.?|Smt\.?)\s+"
#: Off unless asked for by name.
OPTIONAL_RULES = (
    Rule("IMSI", r"(?U)\b404\d{10,12}\b", 0.5),
    Rule("ACCOUNT_NUMBER", r"(?U)\b\d{9,18}\b", 0.5),
    Rule("AMOUNT", r"(?iU)(?:Rs\.?|INR|₹)\s?[\d,]+(?:\.\d{1,2})?", 0.5),
)
PEOPLE = ("PERSON", "SUSPECT", "VICTIM")
# Source types, relationship, target types, distance below which it holds (None: anywhere), confidence.
LINKS = (
    (PEOPLE, "OWNS", ("PHONE",), 150, 0.72), (PEOPLE, "OWNS", ("BANK_ACCOUNT",), 200, 0.68), (PEOPLE, "OWNS", ("UPI_ID",), 200, 0.75), (PEOPLE, "USED_DEVICE", ("IMEI",), 250, 0.66),
    (("VICTIM",), "VICTIM_OF", ("CASE",), None, 0.80), (("SUSPECT",), "SUSPECTED_IN", ("CASE",), None, 0.80), (("PERSON",), "INVOLVED_IN", ("CASE",), None, 0.80),
    (("UPI_ID",), "TRANSFERRED_TO", ("BANK_ACCOUNT",), 200, 0.69), (PEOPLE, "LOCATED_AT", ("LOCATION",), 300, 0.61), (("TRANSACTION",), "PART_OF", ("CASE",), 500, 0.77),
)
CALLED = r"(?iU)(\d{10})\s+(?:called|contacted|rang)\s+(\d{10})"


def normal_value(kind: Column, raw: Column) -> Column:
    """The value that entities are compared by."""
    digits = F.regexp_replace(raw, r"[\s\-()+]", "")
    phone = F.when((F.length(digits) == 12) & F.startswith(digits, F.lit("91")), F.substring(digits, 3, 10)).otherwise(digits)
    tight = F.regexp_replace(raw, r"\s", "")
    name = F.initcap(F.trim(F.regexp_replace(raw, r"\s+", " ")))
    return (
        F.when(kind == "PHONE", phone).when(kind.isin("BANK_ACCOUNT", "IMEI", "SIM"), tight).when(kind == "UPI_ID", F.lower(F.trim(raw)))
        .when(kind.isin("PERSON", "VICTIM", "SUSPECT", "ORGANIZATION", "LOCATION"), name).otherwise(F.trim(raw))
    )


def mentions(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """EX-1 to EX-12: one row per match: doc_id, rule_no, pos, type, raw_value, value, confidence, evidence_source, role_hint, the columns of docs to keep."""
    per_rule = F.array(*[
        F.struct(F.lit(k).alias("rule_no"), F.lit(r.type).alias("rule"), F.lit(r.confidence).alias("confidence"), F.lit(r.source).alias("evidence_source"), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)).alias("found"))
        for k, r in enumerate(rules)
    ])
    rows = docs.select("doc_id", *keep, F.substring("text", 1, SNIPPET).alias("source_text"), F.inline(per_rule)).where(F.size("found") > 0)
    rows = rows.select("doc_id", *keep, "source_text", "rule_no", "rule", "confidence", "evidence_source", F.posexplode("found").alias("pos", "hit"))
    cue = F.when(F.col("rule") == "PERSON", F.lower(F.regexp_replace(F.regexp_extract("hit", CUE, 1), r"\.+$", "")))
    raw = F.when(F.col("rule") == "PERSON", F.regexp_replace("hit", CUE, "")).when(F.col("rule") == "PHONE", F.regexp_replace("hit", r"[\s\-]", ""))
    raw = raw.when(F.col("rule") == "LOCATION", F.regexp_replace(F.trim("hit"), "[,;.]+$", "")).otherwise(F.trim("hit"))
    kind = F.when(F.col("role_hint").isin("victim", "complainant"), "VICTIM").when(F.col("role_hint").isin("accused", "suspect"), "SUSPECT").otherwise(F.col("rule"))
    rows = rows.withColumns({"role_hint": cue, "raw_value": raw}).withColumn("type", kind)
    rows = rows.where(~((F.col("type") == "IP_ADDRESS") & F.rlike("raw_value", F.lit(PRIVATE_IP)))).where((F.col("type") != "LOCATION") | (F.length("raw_value") > 3))
    rows = rows.withColumn("value", normal_value(F.col("type"), F.col("raw_value")))
    return rows.select("doc_id", "rule_no", "pos", "type", "raw_value", "value", "confidence", "evidence_source", "role_hint", "source_text", *keep)


def validate_entities(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """EX-13: (good, rejected with a reason): known type, non-empty value, confidence in [0, 1] at 4 places, known source."""
    confidence = F.round(F.least(F.greatest(F.coalesce(F.col("confidence").cast("string").try_cast("double"), F.lit(0.5)), F.lit(0.0)), F.lit(1.0)), 4)
    source = F.when(F.lower("evidence_source").isin(*S.EVIDENCE_SOURCES), F.lower("evidence_source")).otherwise("observed")
    rows = rows.withColumns({"type": F.upper(F.trim("type")), "value": F.trim("value"), "confidence": confidence, "evidence_source": source, "source_text": F.substring("source_text", 1, 500)})
    reason = F.when(~F.coalesce(F.col("type").isin(*S.ENTITY_TYPES), F.lit(False)), "unknown type").when(blank_null(F.col("value")).isNull(), "empty value")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL")


def validate_relationships(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """EX-14: as EX-13 for relationships; endpoints are normalised again."""
    confidence = F.round(F.least(F.greatest(F.coalesce(F.col("confidence"), F.lit(0.5)), F.lit(0.0)), F.lit(1.0)), 4)
    source = F.when(F.lower("evidence_source").isin(*S.EVIDENCE_SOURCES), F.lower("evidence_source")).otherwise("inferred")
    rows = rows.withColumns({"relationship": F.upper(F.trim("relationship")), "source_type": F.upper("source_type"), "target_type": F.upper("target_type"), "confidence": confidence, "evidence_source": source})
    rows = rows.withColumns({f"{e}_value": normal_value(F.col(f"{e}_type"), F.col(f"{e}_value")) for e in ("source", "target")})
    known = lambda c, of: F.coalesce(F.col(c).isin(*of), F.lit(False))
    reason = F.when(~known("relationship", S.RELATIONSHIP_TYPES), "unknown relationship").when(blank_null(F.col("source_value")).isNull() | blank_null(F.col("target_value")).isNull(), "empty endpoint")
    reason = reason.when(~known("source_type", S.ENTITY_TYPES) | ~known("target_type", S.ENTITY_TYPES), "unknown endpoint type")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL")


def cap(rows: DataFrame, n: int = 100, least: float = 0.3, order: tuple[str, ...] = ("rule_no", "pos")) -> DataFrame:
    """EX-15: the first n rows of each document, then those of at least the given confidence (caps are the feature)."""
    if not 1 <= n <= 1000 or not 0 <= least <= 1:
        raise ValueError("n must be 1 to 1000, least 0 to 1")
    w = Window.partitionBy("doc_id").orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).where(F.col("confidence") >= least).drop("_n")


def requests(docs: DataFrame) -> DataFrame:
    """EX-16: documents with a non-blank text."""
    return docs.where(blank_null(F.col("text")).isNotNull())


def relationships(docs: DataFrame, found: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """RL-1 to RL-9: pairs of a document's entities near one another (distance of the first places of their raw values).

    Entities fold to one array a document, and pairs are made inside its row: nothing leaves the document. keep: columns of docs to add.
    Texts made from small rows look small to the optimiser, so that the join has to be told not to broadcast them.
    """
    ents = found.groupBy("doc_id").agg(F.collect_set(F.struct("type", "value", "raw_value")).alias("ents"))
    rows = docs.select("doc_id", "text", *keep).join(ents.hint("merge"), "doc_id")
    placed = F.transform("ents", lambda e: F.struct(e["type"].alias("type"), e["value"].alias("value"), F.instr(F.col("text"), e["raw_value"]).alias("at")))
    rows = rows.withColumn("ents", F.filter(placed, lambda e: e["at"] > 0))

    def of(kinds: tuple[str, ...]) -> Column:
        return F.filter("ents", lambda e: e["type"].isin(*kinds))

    def pairs(sources, rel, targets, far, conf) -> Column:
        def one(a: Column) -> Column:
            near = of(targets) if far is None else F.filter(of(targets), lambda b: F.abs(a["at"] - b["at"]) < far)
            return F.transform(near, lambda b: F.struct(a["type"].alias("source_type"), a["value"].alias("source_value"), F.lit(rel).alias("relationship"), b["type"].alias("target_type"), b["value"].alias("target_value"), F.lit(conf).alias("confidence"), F.lit("inferred").alias("evidence_source")))

        return F.flatten(F.transform(of(sources), one))

    callers, called = F.regexp_extract_all("text", F.lit(CALLED), F.lit(1)), F.regexp_extract_all("text", F.lit(CALLED), F.lit(2))
    phones = F.transform(of(("PHONE",)), lambda e: e["value"])
    calls = F.zip_with(callers, called, lambda a, b: F.struct(F.lit("PHONE").alias("source_type"), a.alias("source_value"), F.lit("CALLED").alias("relationship"), F.lit("PHONE").alias("target_type"), b.alias("target_value"), F.lit(0.91).alias("confidence"), F.lit("observed").alias("evidence_source")))
    calls = F.filter(calls, lambda c: F.array_contains(phones, c["source_value"]) & F.array_contains(phones, c["target_value"]))
    return rows.select("doc_id", *keep, F.inline(F.concat(*[pairs(*x) for x in LINKS], calls))).where("source_type <> target_type OR source_value <> target_value")


def parse_responses(rows: DataFrame, column: str = "response") -> DataFrame:
    """EX-17: entities from the JSON of collected model answers: fences off, else the outermost braces, else none."""
    schema = "entities array<struct<type:string,value:string,raw_value:string,confidence:string,evidence_source:string,source_text:string>>, relationships array<struct<source_type:string,source_value:string,relationship:string,target_type:string,target_value:string,confidence:string,evidence_source:string>>"
    bare = F.trim(F.regexp_replace(column, r"(?m)^\s*```[a-zA-Z]*\s*$", ""))
    parsed = F.coalesce(F.when(F.startswith(bare, F.lit("{")), F.from_json(bare, schema)), F.from_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), schema))
    return rows.withColumn("parsed", parsed)


def entity_key(kind: Column, value: Column) -> Column:
    return F.concat_ws("::", F.upper(kind), F.upper(value))


def entity_id(kind: Column, value: Column) -> Column:
    return key12("ent_", entity_key(kind, value))
