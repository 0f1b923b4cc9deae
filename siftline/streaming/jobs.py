"""Continuous rate limiting, scanning and recording."""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections import deque
from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegralType, LongType, StructField, StructType

from siftline.functions.text import normalise_newlines
from siftline.operators import learning
from siftline.operators.ratelimit import fold_run, micros
from siftline.session import checkpoint_dir
from siftline.sources.store import LearningStore

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Decisions that leave the limiter at once.
DECIDED_ROWS = 10_000
#: Time of the call that closes a stream, in microseconds: the year 2200 (pandas ends in 2262).
CLOSING_TIME = 7_258_118_400_000_000


class Limiter(StatefulProcessor):
    """Decides the calls of one key in event-time order, once the watermark has passed them.

    Arriving calls wait in a list. A timer at the earliest of them decides all that the watermark
    has passed, so neither the order of arrival nor the size of a batch changes a decision. The
    log holds at most ``max_calls`` times; a period after the last one the key leaves the state.
    """

    def __init__(self, max_calls: int, period: int, key: DataType, rid: DataType) -> None:
        self.max_calls, self.period = max_calls, period
        self.pending_type = StructType([StructField("t", LongType()), StructField("id", rid)])
        self.output = limited_type(key, rid).names
        # Whole numbers beside nulls come as floats.
        self.plain = int if isinstance(rid, IntegralType) else lambda i: i

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.pending_type)
        self.log = handle.getValueState("log", StructType([StructField("log", ArrayType(LongType()))]))
        self.wake = handle.getValueState("wake", StructType([StructField("ms", LongType())]))

    def _wake_at(self, ms: int) -> None:
        if self.wake.exists():
            self.handle.deleteTimer(self.wake.get()[0])
        self.handle.registerTimer(ms)
        self.wake.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            ids = [None if pd.isna(i) else self.plain(i) for i in pdf["id"].tolist()]
            waiting = list(zip(pdf["t"].tolist(), ids, strict=True))
            self.pending.appendList(waiting)
            least = min(t for t, _ in waiting) // 1000
            first = least if first is None else min(first, least)
        if first is not None and not (self.wake.exists() and self.wake.get()[0] <= first):
            self._wake_at(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        log = deque(self.log.get()[0]) if self.log.exists() else deque()
        by_time = lambda row: (row[0], row[1] is not None, row[1])
        waiting = sorted(self.pending.get(), key=by_time) if self.pending.exists() else []
        due = bisect_right(waiting, now, key=lambda row: row[0])
        for a in range(0, due, DECIDED_ROWS):
            part = waiting[a : min(a + DECIDED_ROWS, due)]
            times = [t for t, _ in part]
            admitted = fold_run(np.array(times, np.int64), log, self.max_calls, self.period)
            columns = [[key[0]] * len(part), times, [i for _, i in part], admitted]
            yield pd.DataFrame(dict(zip(self.output, columns, strict=True)))
        while log and now - log[0] >= self.period:
            log.popleft()
        self.wake.clear()
        rest = waiting[due:]
        if rest:
            self.pending.put(rest)
        else:
            self.pending.clear()
        if log:
            self.log.update((list(log),))
        else:
            self.log.clear()
        if rest or log:
            forgotten = (log[-1] + self.period) // 1000 + 1 if log else None
            self._wake_at(rest[0][0] // 1000 if rest else forgotten)

    def close(self) -> None:
        pass


def limited_type(key: DataType, rid: DataType) -> StructType:
    fields = {"key": key, "t": LongType(), "id": rid, "admitted": BooleanType()}
    return StructType([StructField(name, kind) for name, kind in fields.items()])


def _calls(events: DataFrame, key: str, ts: str, event_id: str) -> DataFrame:
    rows = events.select(F.col(key).alias("key"), micros(ts).alias("t"), F.col(event_id).alias("id"))
    return rows.filter(F.col("t").isNotNull())


def _decided(calls: DataFrame, max_calls: int, period_seconds: int, lateness: str) -> DataFrame:
    key, rid = calls.schema["key"].dataType, calls.schema["id"].dataType
    timed = calls.withColumn("event_time", F.timestamp_micros("t")).withWatermark("event_time", lateness)
    return timed.groupBy("key").transformWithStateInPandas(
        Limiter(max_calls, period_seconds * 1_000_000, key, rid), limited_type(key, rid), "Append", "EventTime"
    )


def limited(
    events: DataFrame, key: str, ts: str, event_id: str, max_calls: int, period_seconds: int,
    lateness: str = "1 hour",
) -> DataFrame:
    """Streaming counterpart of the batch limiter, with its decisions whatever the order of arrival.

    A call is decided when the watermark has passed it, ``lateness`` after its time; calls that arrive
    later than that are dropped by the watermark, calls without a time are left out.
    """
    return _decided(_calls(events, key, ts, event_id), max_calls, period_seconds, lateness)


def limited_to_end(
    events: DataFrame, key: str, ts: str, event_id: str, max_calls: int, period_seconds: int,
    lateness: str = "1 hour",
) -> DataFrame:
    """The decisions on all calls that a finished stream holds, as a table.

    The calls of the last ``lateness`` wait for the watermark. So the stream runs once over what is
    there, then a closing call far in the future, which is itself never decided, moves the watermark.
    """
    spark = events.sparkSession
    calls = _calls(events, key, ts, event_id)
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    closing = f"{base}/closing"
    nothing = spark.createDataFrame([], calls.schema)
    nothing.write.parquet(closing)
    ends = spark.readStream.schema(calls.schema).parquet(closing)
    decided = _decided(calls.unionByName(ends), max_calls, period_seconds, lateness)
    run_to_end(decided, base=base)
    spark.createDataFrame([(None, CLOSING_TIME, None)], calls.schema).write.mode("append").parquet(closing)
    return run_to_end(decided, base=base)


def new_contents(files: DataFrame, ts: str = "mtime", lateness: str = "1 day") -> DataFrame:
    """Arriving files whose content has not been seen within the watermark."""
    normal = files.withColumn("content", normalise_newlines(F.col("content")))
    return (
        normal.withColumn(ts, F.timestamp_micros(micros(ts)))
        .withColumn("content_hash", F.sha2("content", 256))
        .withWatermark(ts, lateness)
        .dropDuplicatesWithinWatermark(["content_hash"])
    )


def scanned(files: DataFrame, scan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Findings of arriving files, each content scanned once."""
    return scan(new_contents(files).select("path", "content"))


def pattern_counts(observations: DataFrame, window: str = "1 day") -> DataFrame:
    """Observations per pattern and day; a day stays open for the retention time."""
    return (
        observations.withColumn("ts", F.timestamp_micros(micros("ts")))
        .withWatermark("ts", f"{learning.RETENTION_DAYS} days")
        .groupBy(F.window("ts", window).alias("w"), "pattern_key")
        .agg(F.count("*").alias("count"))
        .select(F.col("w.start").alias("day"), "pattern_key", "count")
    )


def record_into(store: LearningStore, now: Callable[[DataFrame], str]):
    """A foreachBatch function: append the observations, then consolidate the store.

    A batch delivered again is not recorded twice: its files are overwritten, and the log
    names the last batch it contains once it has been pruned.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        if epoch <= store.last_epoch():
            return
        store.record(batch, batch=f"epoch-{epoch}")
        store.consolidate(now(batch), epoch)

    return handle


def observed(stream: DataFrame, store: LearningStore, now: str, checkpoint: str) -> None:
    """Take what has arrived into the store: log, counts of the days it touches, patterns, retention."""
    query = (
        stream.writeStream.foreachBatch(record_into(store, lambda batch: now))
        .trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
    )
    query.awaitTermination()


def run_to_end(
    stream: DataFrame, schema: StructType | None = None, mode: str = "append", base: str | None = None
) -> DataFrame:
    """Process what is there and return the written result as a table; with the same ``base``, go on."""
    spark = stream.sparkSession
    base = base or f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option(
        "checkpointLocation", f"{base}/checkpoint"
    )
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(
            lambda df, _: df.write.mode("overwrite").parquet(out)
        ).start()
    query.awaitTermination()
    return spark.read.schema(schema or stream.schema).parquet(out)


def with_rocksdb(spark: SparkSession):
    """Typed state needs the RocksDB store; the setting is restored afterwards."""
    return _Setting(spark, PROVIDER, ROCKSDB)


class _Setting:
    def __init__(self, spark: SparkSession, name: str, value: str) -> None:
        self.conf, self.name, self.value = spark.conf, name, value

    def __enter__(self) -> None:
        self.old = self.conf.get(self.name, None)
        self.conf.set(self.name, self.value)

    def __exit__(self, *exc) -> None:
        if self.old is None:
            self.conf.unset(self.name)
        else:
            self.conf.set(self.name, self.old)
