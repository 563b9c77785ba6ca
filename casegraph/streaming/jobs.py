"""Structured Streaming: incremental ingest of record files, exact velocity of accounts, windowed transfer counts.

What a stream writes goes to a folder of its own for each batch, which a redone batch replaces: a batch that is run again
after a lost commit, or after a failure half way, counts once.
"""

from __future__ import annotations

import hashlib

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from casegraph.functions.expr import HOUR_US
from casegraph.operators.patterns import legs, velocity_told
from casegraph.sources.ingest import normalise

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest_stream(spark: SparkSession, folder: str, columns: list[str], kind: str | None = None, files: int | None = None) -> DataFrame:
    """IO-20: CSV files that arrive in a folder as normalised rows, `files` a batch; each file is read once (the checkpoint keeps count)."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.readStream.schema(schema).option("header", True)
    return normalise((reader.option("maxFilesPerTrigger", files) if files else reader).csv(folder), kind)


def batch_sink(out: str, checkpoint: str, more: dict[str, Column] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that puts a batch into its own partition of the table at out, in place of what an earlier run of
    the batch left there. Partitions are named by the stream (its checkpoint) and the batch, so several streams can share a table
    and two uploads of one file count twice; more: further partition columns."""
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    more = more or {}

    def put(batch: DataFrame, number: int) -> None:
        made = batch.withColumns(more | {"stream": F.lit(stream), "batch": F.lit(number)})
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream", "batch", *more).parquet(out)

    return put


def run_ingest(rows: DataFrame, out: str, checkpoint: str):
    """IO-20: good and rejected rows to Parquet, exactly once, until the files present are read; returns the query."""
    put = batch_sink(out, checkpoint, {"ok": F.col("error").isNull()})
    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def velocity_stream(transfers: DataFrame, hours: int = 24, slide: int = 1, late: str = "2 hours", least: int = 5) -> DataFrame:
    """Accounts with many transfers per sliding window, with a watermark; an approximation of the exact trailing window.

    transfers: src, dst, amount, ts (timestamp).
    """
    legs = transfers.withWatermark("ts", late).select("ts", "amount", F.explode(F.array("src", "dst")).alias("account"))
    out = legs.groupBy(F.window("ts", f"{hours} hours", f"{slide} hours"), "account").agg(F.count("*").alias("n"), F.sum(F.col("amount").cast("decimal(18,2)")).alias("volume"))
    return out.where(F.col("n") >= least)


TOLD = "case_id string, account string, n long, cents long, start_us long, us long"


class TrailingWindows(StatefulProcessor):
    """The first largest trailing window of an account's legs, told whenever it changes.

    State: the legs that a window still to come can hold (those later than the watermark less the window), and the largest window
    so far. A timer clears both once the watermark has left the account's last leg a window behind: nothing that is not too
    late can change what was told. What is told never shrinks, so the largest row told for an account is its result.
    """

    def __init__(self, span: int, least: int):
        self.span, self.least = span, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.legs = handle.getValueState("legs", "us binary, cents binary")
        self.best = handle.getValueState("best", "n long, us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows), ignore_index=True)
        us, cents = new["us"].to_numpy(np.int64), new["cents"].to_numpy(np.int64)
        held = self.legs.get()
        if held is not None:
            us, cents = np.concatenate([np.frombuffer(held[0], np.int64), us]), np.concatenate([np.frombuffer(held[1], np.int64), cents])
        order = np.argsort(us, kind="stable")
        us, cents = us[order], cents[order]
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        start, end = np.searchsorted(us, us - self.span, "left"), np.searchsorted(us, us, "right")
        n = np.where(us > mark, end - start, 0)  # earlier windows are final, and their first legs may be gone
        at = int(np.argmax(n))
        best = self.best.get()
        if n[at] and (best is None or (n[at], -us[at]) > (best[0], -best[1]) or (n[at], us[at]) == tuple(best)):
            self.best.update((int(n[at]), int(us[at])))
            if n[at] >= self.least and (best is None or (n[at], us[at]) != tuple(best)):
                total = int(cents[start[at] : end[at]].sum())
                yield pd.DataFrame({"case_id": [key[0]], "account": [key[1]], "n": [int(n[at])], "cents": [total], "start_us": [int(us[start[at]])], "us": [int(us[at])]})
        keep = us > mark - self.span
        self.legs.update((us[keep].tobytes(), cents[keep].tobytes()))
        last = int(us[-1]) + self.span
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(last // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.legs.clear()
        self.best.clear()
        return iter([])

    def close(self) -> None:
        pass


def run_velocity(transfers: DataFrame, out: str, checkpoint: str, hours: float = 24, least: int = 5, late: str = "2 hours"):
    """PT-6 on a stream: the windows told of each account go to the table at out, exactly once; returns the query.

    transfers: id, case_id, src, dst, amount, us. A leg later than `late` behind the newest is dropped, as the watermark is.
    """
    spark = transfers.sparkSession
    rows = legs(transfers).where("us IS NOT NULL").select("case_id", "account", "us", (F.col("amount") * 100).cast("long").alias("cents"), F.timestamp_micros("us").alias("ts")).withWatermark("ts", late)
    told = rows.groupBy("case_id", "account").transformWithStateInPandas(
        TrailingWindows(int(hours * HOUR_US), least), TOLD, "Update", "EventTime"
    )
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)  # the store that keyed state with timers needs; a stream keeps the setting it began with
    try:
        return told.writeStream.outputMode("update").foreachBatch(batch_sink(out, checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, before)


def velocity_so_far(spark: SparkSession, out: str) -> DataFrame:
    """The result of run_velocity's table at out, as patterns.velocity gives it for the transfers that have come in."""
    told = spark.read.schema(TOLD).parquet(out)
    window = F.struct("n", (F.col("cents") / 100).cast("decimal(18,2)").alias("volume"), "start_us", "us")
    return velocity_told(told.groupBy("case_id", "account").agg(F.max_by(window, F.struct(F.col("n"), -F.col("us"))).alias("w")))
