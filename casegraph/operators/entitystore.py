"""ER-1, ER-3, ER-4, IO-12 batch by batch: stores of merged entities and relationships that take new mentions without reading or
shuffling all of what they hold.

A store is a table partitioned by a part of the key's hash and bucketed by the key inside each part. A batch folds to one row for
each key, is shuffled once to the store's buckets, and meets the old rows there as they lie; only the parts that the batch
touches are read and written anew. Merging in batches gives what merging all mentions at once does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegraph.functions.expr import key12
from casegraph.functions.scratch import exists, materialise, passing
from casegraph.operators.extract import entity_id, entity_key

PARTS = 8
BUCKETS = 32  # of a part
TEXTS = 3


def states(rows: DataFrame) -> DataFrame:
    """One row for each key of mentions (as resolve.merge_entities takes them), holding what is needed to merge it with others."""
    key = entity_key(F.col("type"), F.col("value"))
    # Equal texts fold, and tasks pass on the first three of an entity at most, before any are collected.
    texts = rows.where("source_text IS NOT NULL").groupBy(key.alias("key"), "source_text").agg(F.min("seq").alias("at"))
    texts = texts.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("at", "source_text"))).where(F.col("place") <= TEXTS)
    texts = texts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "source_text"))).alias("texts"))
    first = F.min(F.struct("seq", "type", "value", "raw_value", "evidence_source")).alias("first")
    ids = lambda c: F.array_sort(F.collect_set(c)).alias(f"{c}s")
    out = rows.groupBy(key.alias("key")).agg(first, F.max("confidence").alias("confidence"), ids("evidence_id"), ids("case_id"), F.count("*").alias("mentions"))
    return out.join(texts.hint("merge"), "key", "left")


def edge_states(rows: DataFrame) -> DataFrame:
    """One row for each key of resolved relationships (as resolve.merge_relationships takes them)."""
    ends = ("source_entity", "relationship", "target_entity")
    ids = lambda c: F.array_sort(F.collect_set(c)).alias(f"{c}s")
    out = rows.groupBy(*ends).agg(F.max("confidence").alias("confidence"), F.min("evidence_source").alias("evidence_source"), ids("evidence_id"), ids("case_id"), F.count("*").alias("mentions"))
    return out.select(F.concat_ws("::", *ends).alias("key"), *out.columns)


def _joined(old: DataFrame, c: str) -> Column:
    return F.concat(*[F.coalesce(F.col(f"{x}.{c}"), F.array().cast(old.schema[c].dataType)) for x in "on"])


def _union(old: DataFrame, c: str) -> Column:
    return F.array_sort(F.array_distinct(_joined(old, c))).alias(c)


def _met(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.alias("o").join(new.alias("n"), F.col("o.key") == F.col("n.key"), "full_outer")


def _of_both(fold: Callable[..., Column], c: str) -> Column:
    return fold(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)


def _mentions() -> Column:
    return (F.coalesce("o.mentions", F.lit(0)) + F.coalesce("n.mentions", F.lit(0))).alias("mentions")


def _both(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new states of the same entities as one."""
    by_text = F.array_sort(_joined(old, "texts"))  # by place, so the first of a text is its earliest
    kept = F.filter(by_text, lambda t, k: ~F.exists(F.slice(by_text, F.lit(1), k), lambda s: s["source_text"] == t["source_text"]))
    return _met(old, new).select(
        _of_both(F.coalesce, "key"), _of_both(F.least, "first"), _of_both(F.greatest, "confidence"), _union(old, "evidence_ids"), _union(old, "case_ids"), _mentions(), F.slice(kept, 1, TEXTS).alias("texts"),
    )


def _both_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new states of the same relationships as one."""
    same = [_of_both(F.coalesce, c) for c in ("key", "source_entity", "relationship", "target_entity")]
    return _met(old, new).select(*same, _of_both(F.greatest, "confidence"), _of_both(F.least, "evidence_source"), _union(old, "evidence_ids"), _union(old, "case_ids"), _mentions())


@dataclass(frozen=True)
class Kind:
    """What a store holds: how new rows fold to one state for each key, and how two states of a key become one."""

    name: str
    states: Callable[[DataFrame], DataFrame]
    both: Callable[[DataFrame, DataFrame], DataFrame]


ENTITIES, EDGES = Kind("entities", states, _both), Kind("relationships", edge_states, _both_edges)


def _part(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def opened(spark: SparkSession, path: str, like: DataFrame, kind: Kind = ENTITIES) -> str:
    """The name in this session's catalog of the store at path, made where there is none. like: states of the kind."""
    name = f"{kind.name}_{hashlib.sha256(path.encode()).hexdigest()[:12]}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema)
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} ({columns}, part INT) USING parquet PARTITIONED BY (part) CLUSTERED BY (key) INTO {BUCKETS} BUCKETS LOCATION '{path}'")
        if exists(spark, path):
            spark.catalog.recoverPartitions(name)
    return name


def upsert(spark: SparkSession, path: str, rows: DataFrame, kind: Kind = ENTITIES) -> list[int]:
    """Merge mentions (or resolved relationships) into the store at path; returns the parts written anew. A batch that fails half way
    leaves the store as it was in each part that it had not come to; a batch must not be given twice."""
    with passing():
        new = materialise(kind.states(rows).withColumn("part", _part("key")))
        touched = sorted(r[0] for r in new.select("part").distinct().collect())  # PARTS at most
        if touched:
            name = opened(spark, path, new.drop("part"), kind)
            merged = merged_with(spark, name, new, touched, kind)
            made = materialise(merged.withColumn("part", _part("key")))
            for part in touched:  # one job for each part, which replaces that part alone
                spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (part = {part}) SELECT {', '.join(c for c in made.columns if c != 'part')} FROM {{made}} WHERE part = {part}", made=made)
    return touched


def merged_with(spark: SparkSession, name: str, new: DataFrame, touched: list[int], kind: Kind = ENTITIES) -> DataFrame:
    """The touched parts of the store with the new states: the old rows stay where they lie (no exchange on their side)."""
    old = spark.table(name).where(F.col("part").isin(touched)).drop("part")
    return kind.both(old, new.drop("part").repartition(BUCKETS, "key"))


def resolve_endpoints(spark: SparkSession, path: str, rows: DataFrame, like: DataFrame) -> DataFrame:
    """ER-3 against the store of entities at path: relationships with both ends in it, with their ids.

    An id is a function of the key, so of the store only the keys are read, in their buckets; the rows are dealt to them, once for
    each end.
    """
    keys = spark.table(opened(spark, path, like)).select(F.col("key").alias("known")).hint("merge")
    for e in ("source", "target"):
        key = entity_key(F.col(f"{e}_type"), F.col(f"{e}_value"))
        rows = rows.withColumns({"_key": key, f"{e}_entity": entity_id(F.col(f"{e}_type"), F.col(f"{e}_value"))})
        rows = rows.repartition(BUCKETS, "_key").join(keys, F.col("_key") == F.col("known"), "left_semi").drop("_key")
    return rows


def entities(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The store's entities, as resolve.merge_entities gives them."""
    s = spark.table(opened(spark, path, like)).drop("part")
    out = s.select("key", "first.type", "first.value", "first.raw_value", "confidence", "first.evidence_source", "evidence_ids", "case_ids", "mentions", F.transform("texts", lambda t: t["source_text"]).alias("source_texts"))
    return out.withColumn("entity_id", entity_id(F.col("type"), F.col("value")))


def relationships(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The store's relationships, as resolve.merge_relationships gives them. like: edge_states()."""
    s = spark.table(opened(spark, path, like, EDGES)).drop("part", "key")
    return s.withColumn("relationship_id", key12("rel_", F.col("source_entity"), F.col("relationship"), F.col("target_entity")))
