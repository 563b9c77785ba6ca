"""Entity and relationship resolution: one row per key, merged from a store and new mentions.

Joins by key are told to merge: rows made from small ones look small to the optimiser, which would send them through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casegraph.functions.expr import blank_null, key12
from casegraph.functions.scratch import materialise
from casegraph.operators.extract import entity_id, entity_key, mentions, normal_value, parse_responses, relationships, validate_entities, validate_relationships


META = ("case_id", "evidence_id")  # of a document


def merge_entities(rows: DataFrame) -> DataFrame:
    """ER-1: rows (seq, type, value, raw_value, confidence, evidence_source, evidence_id, case_id, source_text) by TYPE and upper value.

    Highest confidence, sorted unions of evidence and cases, the first values by seq, and the first three source texts.
    """
    first = lambda c: F.min_by(c, F.col("seq"))
    ids = lambda c: F.array_sort(F.collect_set(c))
    key = entity_key(F.col("type"), F.col("value"))
    # Equal texts fold, and tasks pass on the first three of an entity at most, before any are collected.
    texts = rows.where("source_text IS NOT NULL").groupBy(key.alias("key"), "source_text").agg(F.min("seq").alias("at"))
    texts = texts.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("at", "source_text"))).where("place <= 3")
    texts = texts.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "source_text"))), lambda t: t["source_text"]).alias("source_texts"))
    out = rows.groupBy(key.alias("key")).agg(
        first("type").alias("type"), first("value").alias("value"), first("raw_value").alias("raw_value"), F.max("confidence").alias("confidence"), first("evidence_source").alias("evidence_source"),
        ids("evidence_id").alias("evidence_ids"), ids("case_id").alias("case_ids"), F.count("*").alias("mentions"),
    )
    out = out.join(texts.hint("merge"), "key", "left").withColumn("source_texts", F.coalesce("source_texts", F.array().cast("array<string>")))
    return out.withColumn("entity_id", entity_id(F.col("type"), F.col("value")))


def merge_counts(store: DataFrame, rows: DataFrame) -> DataFrame:
    """ER-2: how many rows are new (first of a key that the store lacks) and how many merge."""
    keyed = rows.select(entity_key(F.col("type"), F.col("value")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    known = store.select("key").distinct().withColumn("known", F.lit(1))
    out = keyed.join(known.hint("merge"), "key", "left").agg(F.count(F.when(F.col("known").isNull(), 1)).alias("new"), F.sum("n").alias("rows"))
    return out.select("new", (F.coalesce("rows", F.lit(0)) - F.col("new")).alias("merged"))


def resolve_endpoints(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """ER-3: relationships with both ends among the entities, with their ids."""
    ids = entities.select("key", "entity_id").hint("merge")
    key = lambda e: entity_key(F.col(f"{e}_type"), F.col(f"{e}_value"))
    out = rows.withColumns({"s_key": key("source"), "t_key": key("target")})
    out = out.join(ids.withColumnsRenamed({"key": "s_key", "entity_id": "source_entity"}), "s_key")
    return out.join(ids.withColumnsRenamed({"key": "t_key", "entity_id": "target_entity"}), "t_key").drop("s_key", "t_key")


def merge_relationships(rows: DataFrame) -> DataFrame:
    """ER-4: one row per (source, relationship, target): highest confidence, unions of evidence and cases."""
    ids = lambda c: F.array_sort(F.collect_set(c))
    out = rows.groupBy("source_entity", "relationship", "target_entity").agg(
        F.max("confidence").alias("confidence"), F.min("evidence_source").alias("evidence_source"), ids("evidence_id").alias("evidence_ids"), ids("case_id").alias("case_ids"), F.count("*").alias("mentions")
    )
    return out.withColumn("relationship_id", key12("rel_", F.col("source_entity"), F.col("relationship"), F.col("target_entity")))


def pipeline(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ER-5: (entities, relationships, warnings) of documents (doc_id, text, case_id, evidence_id)."""
    good, bad = validate_entities(mentions(docs, keep=META))
    good = materialise(good)  # read for the texts, the entities, the relationships and each end of them
    entities = merge_entities(good.withColumn("seq", F.struct("doc_id", "rule_no", "pos")))
    linked, bad_links = validate_relationships(relationships(docs, good, META))
    edges = merge_relationships(resolve_endpoints(linked, entities))
    warnings = bad.select("doc_id", "reason", F.col("value").alias("what")).unionByName(bad_links.select("doc_id", "reason", F.col("source_value").alias("what")))
    return entities, edges, warnings


def answers_pipeline(answers: DataFrame, most: int = 100, least: float = 0.3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ER-5 over collected model answers (doc_id, response, case_id, evidence_id): (entities, relationships, warnings).

    Of each answer the first `most` entities and relationships are judged (the cap of EX-15); valid ones of at least the confidence
    `least` count. Ends of a relationship have to be among the entities of the same answer. warnings: doc_id, case_id, kind
    (entity or relationship), pos (in the answer), reason, what. A relationship whose ends are not found gives none, nor does an
    answer without JSON.
    """
    if not 1 <= most <= 1000 or not 0 <= least <= 1:
        raise ValueError("most must be 1 to 1000, least 0 to 1")
    parsed = parse_responses(answers).select("doc_id", "case_id", "evidence_id", "parsed")
    meta = ("doc_id", "case_id", "evidence_id", "pos")
    listed = lambda c: parsed.select("doc_id", "case_id", "evidence_id", F.posexplode(F.slice(f"parsed.{c}", 1, most)).alias("pos", "x")).where("x IS NOT NULL").select(*meta, "x.*")
    kind, raw = F.upper(F.trim("type")), F.trim(F.coalesce(blank_null(F.col("raw_value")), F.col("value")))
    good, bad = validate_entities(listed("entities").withColumns({"raw_value": raw, "value": normal_value(kind, raw)}))
    good = good.where(F.col("confidence") >= least)
    links, bad_links = validate_relationships(listed("relationships").withColumn("confidence", F.col("confidence").try_cast("double")))
    entities = merge_entities(good.withColumn("seq", F.struct("doc_id", "pos")))
    links = links.where(F.col("confidence") >= least)
    known = good.select("doc_id", entity_key(F.col("type"), F.col("value")).alias("key")).distinct()
    for e in ("source", "target"):
        links = links.withColumns({"key": entity_key(F.col(f"{e}_type"), F.col(f"{e}_value")), f"{e}_entity": entity_id(F.col(f"{e}_type"), F.col(f"{e}_value"))})
        links = links.join(known.hint("merge"), ["doc_id", "key"], "left_semi").drop("key")
    told = lambda df, kind, what: df.select("doc_id", "case_id", F.lit(kind).alias("kind"), "pos", "reason", what.alias("what"))
    of_link = F.when(F.col("reason") == "unknown relationship", F.col("relationship")).otherwise(F.concat_ws(" -> ", F.concat_ws("::", "source_type", "source_value"), F.concat_ws("::", "target_type", "target_value")))
    warnings = told(bad, "entity", F.col("type")).unionByName(told(bad_links, "relationship", of_link))
    return entities, merge_relationships(links), warnings


def relate(docs: DataFrame, supplied: DataFrame, store: DataFrame) -> DataFrame:
    """ER-6: relationships among supplied entities of the documents, ends looked up in the whole store."""
    good, _ = validate_relationships(relationships(docs, supplied))
    return resolve_endpoints(good, store)


def for_case(rows: DataFrame, case_id: str) -> DataFrame:
    """ER-7."""
    return rows.where(F.array_contains("case_ids", case_id))


def by_id(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """ER-7: the entities named in ids (entity_id)."""
    return entities.join(ids.select("entity_id").distinct().hint("merge"), "entity_id", "left_semi")
