"""Caches whose entries expire: the state of a stream, by key, with a timer for each entry.

A row asks the cache of its key; what is not there is taken from the row itself and kept for a time, if it is not null. An
entry goes by a timer when the watermark has passed its end, so that state holds no more keys than were put within the time to
live. The state store has to be RocksDB's (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Names of the columns inside; a row's number tells rows of one time apart.
INSIDE = ("_key", "_id", "_at", "_value")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The session with RocksDB as its state store, and back to what it was."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Expiring(StatefulProcessor):
    """One entry for each key: its value as a string, and when it ends in milliseconds."""

    def __init__(self, seconds: float) -> None:
        self.milliseconds = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", T.StructType([T.StructField("value", T.StringType()), T.StructField("end", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a key has a few rows in a batch: lists, since frames take longer to join and to sort than the rows themselves; columns come by place
        asked = sorted((r for frame in rows for r in zip(*(frame.iloc[:, k].tolist() for k in (4, 1, 3, 5)), strict=True)), key=lambda r: r[:2])
        value, end = self.entry.get() or (None, None)
        first, out = end, []
        for at, number, given, us in asked:
            hit = end is not None and at < end
            if not hit:
                value, end = (given, at + self.milliseconds) if isinstance(given, str) else (None, None)
            out.append((number, us, hit, value if hit else given))
        if end is None:
            self._forget(first)
        elif end != first:
            if first is not None:
                self.handle.deleteTimer(first)
            self.entry.update((value, end))
            self.handle.registerTimer(end)
        numbers, times, hits, values = zip(*out, strict=True)
        yield pd.DataFrame({"_key": key[0], "_id": numbers, "_us": times, "hit": hits, "value": values})

    def _forget(self, end: int | None) -> None:
        if end is not None:
            self.handle.deleteTimer(end)
            self.entry.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def asked(rows: DataFrame, key: str, number: str, at: str, value: str, seconds: float, late: str = "1 hour") -> DataFrame:
    """``key``, ``number``, ``at``, ``hit``, ``value`` of each row of a stream: what the cache of its key answers, else the row's own value.

    A value that is not null is kept for ``seconds`` of event time after it was put; a hit does not prolong it. Rows that
    repeat a number within ``late`` are dropped, and rows that are later than that. Rows of a batch are taken in the order
    of their times, ties by number; one that comes in a later batch finds what is in the cache then. Rows with a null key
    share one cache, those without a number or time are dropped. Values are strings.
    """
    inside = rows.where(F.col(number).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_key"), F.col(number).alias("_id"), F.col(at).cast("timestamp").alias("_at"), F.col(value).cast("string").alias("_value"))
    once = inside.withWatermark("_at", late).dropDuplicatesWithinWatermark(["_id"]).withColumn("_ms", F.unix_millis("_at")).withColumn("_us", F.unix_micros("_at"))
    kinds = {f.name: f.dataType for f in once.schema.fields}
    out = T.StructType([T.StructField(c, kinds[c]) for c in (*INSIDE[:2], "_us")] + [T.StructField("hit", T.BooleanType()), T.StructField("value", T.StringType())])
    answers = once.groupBy("_key").transformWithStateInPandas(Expiring(seconds), out, "Append", "EventTime")
    return answers.select(F.col("_key").alias(key), F.col("_id").alias(number), F.timestamp_micros("_us").alias(at), "hit", F.col("value").alias(value))
