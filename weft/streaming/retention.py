"""Rolling retention of a stream (K5): state per user with timers, and a sink that frees its days.

The watermark trails the newest row by the retention time, so a row is late exactly when it is too old to
be kept, and rows in any other order are taken. Per user, the state holds the rows of a batch in pieces of
``PIECE_ROWS``, in order of time, each under the first instant at which a row of it expires; a timer per piece
hands on what has expired as removals and leaves the rest under its own first instant. So state holds the kept
rows' numbers only, and is read and written per piece, not per row. The sink is a table by day and batch: a batch writes its own folders anew when it is
run again, and days before the last removal are deleted as folders.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Rows of one entry of the state, at most, as they arrive.
PIECE_ROWS = 256


class Expiry(StatefulProcessor):
    """Passes rows on as additions, and their numbers as removals when the watermark has passed them."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getMapState("due", "first long", "ats array<long>, seqs array<long>")

    def hold(self, at: np.ndarray, seq: np.ndarray) -> None:
        """Keeps rows, ordered by the instant at which they expire, under the first one."""
        first = (int(at[0]),)
        if self.due.containsKey(first):
            ats, seqs = self.due.getValue(first)
            at, seq = np.concatenate([ats, at]), np.concatenate([seqs, seq])
            order = np.argsort(at, kind="stable")
            at, seq = at[order], seq[order]
        self.due.updateValue(first, (at.tolist(), seq.tolist()))
        self.handle.registerTimer(first[0])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            at = (pdf["ts"].astype("datetime64[us]").astype("int64") // 1000 + 1).to_numpy()
            order = np.argsort(at, kind="stable")
            at, seq = at[order], pdf["seq"].to_numpy()[order].astype(np.int64)
            for lo in range(0, len(at), PIECE_ROWS):
                self.hold(at[lo:lo + PIECE_ROWS], seq[lo:lo + PIECE_ROWS])
            yield pdf[self.columns].assign(op="add")[["op", *self.columns]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first = (int(expiredTimerInfo.getExpiryTimeInMs()),)
        if self.due.containsKey(first):
            at, seq = (np.asarray(x, np.int64) for x in self.due.getValue(first))
            self.due.removeKey(first)
            n = int(np.searchsorted(at, max(first[0], timerValues.getCurrentWatermarkInMs()), side="right"))
            if n < len(at):
                self.hold(at[n:], seq[n:])
            out = pd.DataFrame({c: [None] * n for c in self.columns}, dtype=object)
            yield out.assign(seq=seq[:n], user_id=key[0], ts=pd.to_datetime(at[:n] - 1, unit="ms"), op="remove")[["op", *self.columns]]

    def close(self) -> None:
        pass


def changes(history: DataFrame, days: int) -> DataFrame:
    """``op`` (add, remove) with the columns of the history rows; removals carry seq, user_id and ts only.
    Rows without a time or a user are not kept (nothing says when they expire)."""
    rows = history.where("ts is not null and user_id is not null").withWatermark("ts", f"{days} days")
    columns = history.columns
    schema = T.StructType([T.StructField("op", T.StringType()), *[T.StructField(f.name, f.dataType) for f in history.schema.fields]])
    return rows.groupBy("user_id").transformWithStateInPandas(Expiry(columns), schema, "Append", "EventTime")


def _drop_days(spark: SparkSession, sink: str, before: dt.date) -> None:
    """Deletes the sink's folders of days before the given one."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(sink)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        name = status.getPath().getName()
        if name.startswith("day=") and name[4:] < before.isoformat():
            fs.delete(status.getPath(), True)


def apply_changes(sink: str):
    """The batch function of the sink."""

    def apply(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        added = batch.where("op = 'add'").drop("op").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withColumn("batch", F.lit(epoch))
        added.write.partitionBy("day", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(sink)
        last = batch.where("op = 'remove'").agg(F.max(F.date_format("ts", "yyyy-MM-dd"))).first()[0]
        batch.unpersist()
        if last:
            # all rows of earlier days are older than a row that is removed
            _drop_days(batch.sparkSession, sink, dt.date.fromisoformat(last))

    return apply


def run(history: DataFrame, days: int, sink: str, checkpoint: str):
    """Drains ``history`` into the sink; run again, it goes on where it stopped."""
    spark = history.sparkSession
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        q = (changes(history, days).writeStream.foreachBatch(apply_changes(sink)).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    return q


def read_retained(spark: SparkSession, sink: str, days: int) -> DataFrame:
    """The rows of the sink within ``days`` of its newest row (the last day's cut-off lies inside a day)."""
    rows = spark.read.parquet(sink).drop("batch", "day")
    newest = rows.agg(F.max("ts")).first()[0]
    return rows.where(F.col("ts") >= F.lit(newest) - F.expr(f"interval {int(days)} days"))
