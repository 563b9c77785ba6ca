"""Helpers shared by the corpus operators: reading tables, column clashes. Materialising is that of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.functions.scratch import materialise, passing

__all__ = ["corpus_bytes", "fresh", "materialise", "others", "passing", "quoted", "small", "table"]
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def others(df: DataFrame, *taken: str) -> list[str]:
    """Columns of df that do not clash with the names in taken (compared without case): those clashing are dropped."""
    lower = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in lower]


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    lower = {c.lower() for c in df.columns}
    while name.lower() in lower:
        name += "_"
    return name


def quoted(names: list[str]) -> list:
    return [F.col(f"`{n}`") for n in names]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (materialised, narrow rows), marked for broadcast where its counted rows are few."""
    return F.broadcast(df) if df.count() <= rows else df


def corpus_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts: what block and bucket counts are derived from."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
