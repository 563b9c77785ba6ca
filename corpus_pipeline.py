"""The corpus pipeline: documents in, a mixed training corpus out.

Every stage is one operator of casegraph.llm with its production parameters, judged on what the stage before kept.
All but the last return the columns of documents; the last adds `copy` (1 for a document's first copy).

In every stage whole texts count, however long; an empty table gives an empty one; ties go to the smaller doc_id (line dedup and near
dedup keep that of the first document) or don't arise (the others judge each document alone or by its source).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegraph.functions.scratch import release
from casegraph.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from casegraph.llm.common import fresh, materialise, others, passing, quoted, small, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts have no feature and are judged by the bias alone;
    repeated rows are judged each and alike."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _judged(docs, lambda thin: quality.classify(thin, model), "predicted = 1")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen earlier go; a document goes only if it lost lines and nothing but blanks is left of it. Null and empty texts
    stay; the lines of a repeated row are copies of those of the first."""
    return _judged(docs, line_dedup.dedup_lines, "n_removed = 0 OR trim(text) <> ''")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays.

    Documents without words are in no group and stay. Rows of one doc_id are one document: the one of the least text stays.
    Rows without doc_id stay as they are.
    """
    gone = materialise(near_dedup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct())
    left = docs.join(small(gone), "doc_id", "left_anti").select(*quoted(docs.columns))
    again = materialise(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return left
    place = fresh(docs, "place")
    once = left.join(small(again), "doc_id", "left_semi").withColumn(place, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))).where(F.col(place) == 1)
    return left.join(small(again), "doc_id", "left_anti").unionByName(once.drop(place)).select(*quoted(docs.columns))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by test items go. Null and empty texts have no words and stay; repeated rows are judged alike."""
    bench = table(spark, sf_dir, "benchmark")
    return _judged(docs, lambda thin: decontaminate.decontaminate(thin, bench), "NOT contaminated")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Null texts have no words and follow the rate of their source; repeated
    rows are taken alike."""
    docs = docs.select(*quoted(others(docs, "copy")))
    return _judged(docs, lambda thin: mixing.emit(mixing.mix(thin)), "true", "copy")


def _judged(docs: DataFrame, judge, keep: str, *more: str) -> DataFrame:
    """The columns of docs (and more) of what judge leaves by its own columns. Those of docs that it has no use for travel in
    one struct, so that none is replaced by a result of the same name."""
    used = ("doc_id", "text", "source")
    rest = [c for c in docs.columns if c not in used]
    held = docs.select(*[c for c in used if c in docs.columns], F.struct(*quoted(rest)).alias("others")) if rest else docs
    out = judge(held).where(keep)
    return out.select(*[F.col(f"others.`{c}`").alias(c) if c in rest else F.col(c) for c in docs.columns], *more)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]
#: A trained classifier can't be expressed in SQL; the tests compare the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each writes Parquet that the next one reads."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with passing() as kept:  # what a stage wrote on its way goes at its end, its input once it is read
            kept.append(materialise(stage(spark, docs, sf_dir)))
        if before is not None:
            release(before)
        docs = before = kept[0]
    return STAGES[-1][1](spark, docs, sf_dir)
