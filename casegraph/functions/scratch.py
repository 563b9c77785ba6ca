"""Tables that cut lineage: written below the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_OPEN: list[list[DataFrame]] = []  # tables of the blocks of passing() that are open
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A temporary one is made in local mode only; a cluster has to name one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="casegraph-")
        sc.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/casegraph/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """df as Parquet below the shared folder, read back: short lineage that survives lost executors.

    The shuffle files of the write are not needed after it and go at its end.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


@contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """A block whose tables of materialise() are deleted at its end, but for those put into the list it gives."""
    made, kept = [], []
    _OPEN.append(made)
    try:
        yield kept
    finally:
        _OPEN.pop()
        left = {t.scratch for t in kept}
        release(*[t for t in made if t.scratch not in left])
        if _OPEN:
            _OPEN[-1].extend(kept)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator with its result written and every other table that it made deleted."""

    @wraps(operator)
    def run(*args, **named) -> DataFrame:
        with passing() as kept:
            kept.append(materialise(operator(*args, **named)))
        return kept[0]

    return run


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def release(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing will read again."""
    for t in tables:
        remove(t.sparkSession, t.scratch)
