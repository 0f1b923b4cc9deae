"""Sliding-log rate limiting of an event table.

An event is admitted when fewer than ``max_calls`` events of its key were admitted in the
``period`` before it; rejected events do not count. The decision depends on earlier
decisions, so the events of a key are folded in time order.

Keys are spread over the cluster. A key with very many events is cut into time slices that
are folded side by side. Every slice first assumes that it inherits no admissions; where the
slice before it left other ones, it is folded again together with its neighbours, in segments
of 2, 4, 8, … slices, until all slices agree. A log forgets what is older than a period, so
most slices agree after a round or two; agreement is certain after log2(slices) rounds, when
one segment holds the whole key. Folding keeps one log in memory and jumps over the events
that arrive while the log is full.
"""

from __future__ import annotations

from collections import deque
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from siftline.session import checkpointed

# Default limit.
MAX_CALLS = 100
PERIOD_SECONDS = 60

SLICE_ROWS = 2_000_000
_ROW_BITS = (1 << 33) - 1
BEFORE_ALL = -(2**62)
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(column: str = "ts"):
    """Microseconds since 1970 of a wall-clock time, independent of the session time zone."""
    zone = SparkSession.active().conf.get("spark.sql.session.timeZone")
    if zone in ("UTC", "Etc/UTC", "GMT"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), F.col(column).cast("timestamp_ntz"))


def take(log: deque, now: int, max_calls: int, period: int) -> bool:
    """Drop what left the window, admit if there is room."""
    while log and now - log[0] >= period:
        log.popleft()
    if len(log) >= max_calls:
        return False
    log.append(now)
    return True


def fold_run(t: np.ndarray, log: deque, max_calls: int, period: int) -> np.ndarray:
    """Decisions for ascending times; ``log`` is left as the last event leaves it."""
    n = len(t)
    if n and max_calls:
        # Each call comes a period or more after the one max_calls places before it: all are admitted.
        calls = np.concatenate([np.fromiter(log, np.int64, len(log)), t])
        tail = calls[max(0, len(log) - max_calls) :]
        if (tail[max_calls:] - tail[:-max_calls] >= period).all():
            log.extend(tail[max(0, len(tail) - max_calls) :][-n:].tolist())
            while log and int(t[-1]) - log[0] >= period:
                log.popleft()
            return np.ones(n, dtype=bool)
    admitted = np.zeros(n, dtype=bool)
    i = 0
    while i < n:
        now = int(t[i])
        if take(log, now, max_calls, period):
            admitted[i] = True
            i += 1
        else:
            # Nothing is admitted before the oldest call leaves the log.
            i = max(i + 1, int(np.searchsorted(t, log[0] + period)))
    if n:
        while log and int(t[-1]) - log[0] >= period:
            log.popleft()
    return admitted


def _fold(max_calls: int, period: int, decisions: bool, schema: pa.Schema):
    """Fold rows sorted by (key, segment, slice, t, id) into decisions or into slice logs.

    Leading rows, those with a ``call``, are the admissions a segment inherits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, current, log = None, None, deque()
        first, inherited = None, []
        for batch in batches:
            keys, calls = batch.column("key"), batch.column("call")
            codes = pc.fill_null(keys.dictionary_encode().indices, -1).to_numpy()
            segs, slices, t = (batch.column(c).to_numpy() for c in ("segment", "slice", "t"))
            change = (np.diff(codes) != 0) | (np.diff(segs) != 0) | (np.diff(slices) != 0)
            starts = np.concatenate([[0], np.flatnonzero(change) + 1]) if len(t) else []
            ends = np.append(starts[1:], len(t)) if len(t) else []
            leading = calls.is_valid().to_numpy(zero_copy_only=False)
            admitted = np.zeros(len(t), dtype=bool)
            closed = []
            for a, b in zip(starts, ends):
                key = keys[int(a)].as_py()
                place = (key, int(segs[a]), int(slices[a]))
                if place != current:
                    if first is not None:
                        closed.append((current[0], current[2], first, inherited, list(log)))
                    if place[:2] != segment:
                        segment, log = place[:2], deque()
                    current, first = place, None
                n = int(leading[a:b].sum())
                log.extend(calls[int(a) : int(a) + n].to_pylist())
                a = a + n
                if a == b:
                    continue
                if first is None:
                    first = int(t[a])
                    inherited = [c for c in log if first - c < period]
                admitted[a:b] = fold_run(t[a:b], log, max_calls, period)
            if decisions:
                events = pa.array(~leading)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").filter(events), batch.column("t").filter(events),
                        batch.column("id").filter(events), pa.array(admitted[~leading]),
                    ],
                    schema=schema,
                )
            elif closed:
                yield _batch(closed, schema)
        if first is not None and not decisions:
            yield _batch([(current[0], current[2], first, inherited, list(log))], schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema
    )


def _folded(rows: DataFrame, max_calls: int, period: int, decisions: bool) -> DataFrame:
    key, rid = rows.schema["key"].dataType, rows.schema["id"].dataType
    log = ArrayType(LongType())
    fields = (
        {"key": key, "t": LongType(), "id": rid, "admitted": BooleanType()}
        if decisions
        else {"key": key, "slice": LongType(), "first_t": LongType(), "carry": log, "log": log}
    )
    schema = StructType([StructField(n, t) for n, t in fields.items()])
    placed = (
        rows.select("key", "segment", "slice", "t", "id", "call")
        .repartition("key", "segment")
        .sortWithinPartitions("key", "segment", "slice", "t", "call", "id")
    )
    return placed.mapInArrow(_fold(max_calls, period, decisions, to_arrow_schema(schema)), schema)


def _with_logs(events: DataFrame, logs: DataFrame) -> DataFrame:
    """Events plus leading rows for the calls in the log a segment inherits."""
    leading = logs.select(
        "key", "segment", "slice", F.lit(BEFORE_ALL).alias("t"),
        F.lit("0").cast(events.schema["id"].dataType).alias("id"), F.explode("carry").alias("call"),
    )
    return _plain(events).unionByName(leading)


def _plain(events: DataFrame) -> DataFrame:
    return events.select(
        "key", "segment", "slice", "t", "id", F.lit(None).cast("bigint").alias("call")
    )


def _sliced(events: DataFrame, hot: DataFrame, slice_rows: int) -> DataFrame:
    """Events of the hot keys with a slice number: runs of ``slice_rows`` events of a key in time order.

    Events are range-partitioned by (key, time, id), so that even a burst at one instant is cut. A place
    in a key is the place in its partition plus what earlier partitions hold of the key.
    """
    rows = events.join(hot.select("key"), "key", "left_semi")
    order = ["key", "t", "id"]
    fixed = checkpointed(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
    )
    # One row for each partition and each hot key that it holds.
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        fixed.groupBy("key", "part")
        .agg(F.count("*").alias("n"), F.min("at").alias("first"))
        .select("key", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset"))
    )
    place = F.floor((F.col("at") + F.col("offset")) / F.lit(slice_rows)) + 1
    return fixed.join(offsets, ["key", "part"]).select("key", "t", "id", place.cast("bigint").alias("slice"))


def _settled_logs(events: DataFrame, max_calls: int, period: int) -> DataFrame:
    """``key, slice, carry``: the log every slice inherits."""
    alone = _plain(events.withColumn("segment", F.col("slice")))
    state = checkpointed(_folded(alone, max_calls, period, False))
    width = 1
    while True:
        left = state.select("key", (F.col("slice") + 1).alias("slice"), F.col("log").alias("left"))
        active = F.filter(F.coalesce("left", F.array()), lambda c: F.col("first_t") - c < period)
        linked = state.join(left, ["key", "slice"], "left").withColumn("next", active)
        width *= 2
        segment = F.floor((F.col("slice") - 1) / F.lit(width)).cast("bigint")
        logs = linked.select(
            "key", "slice", segment.alias("segment"), F.col("next").alias("carry"),
            (F.col("carry") != F.col("next")).alias("differs"),
        )
        redo = checkpointed(
            logs.groupBy("key", "segment")
            .agg(F.bool_or("differs").alias("differs"), F.min(F.struct("slice", "carry")).alias("s"))
            .filter("differs")
            .select("key", "segment", "s.slice", "s.carry")
        )
        if redo.isEmpty():
            return state.select("key", "slice", "carry")
        again = events.withColumn("segment", segment).join(
            redo.select("key", "segment"), ["key", "segment"], "left_semi"
        )
        redone = _folded(_with_logs(again, redo), max_calls, period, False)
        kept = state.withColumn("segment", segment).join(redo, ["key", "segment"], "left_anti")
        state = checkpointed(kept.drop("segment").unionByName(redone))


def admissions(
    events: DataFrame,
    key: str,
    ts: str,
    event_id: str,
    max_calls: int = MAX_CALLS,
    period_seconds: int = PERIOD_SECONDS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``key, t, id, admitted`` for every event, with ``t`` in microseconds."""
    period = period_seconds * 1_000_000
    rows = events.select(F.col(key).alias("key"), micros(ts).alias("t"), F.col(event_id).alias("id"))
    per_key = rows.groupBy("key").agg(F.count("*").alias("n"))
    hot = per_key.filter(F.col("n") > slice_rows).select("key")
    as_segments = lambda df: df.withColumn("segment", F.col("slice"))
    whole = lambda df: _plain(as_segments(df.withColumn("slice", F.lit(1).cast("bigint"))))
    if hot.isEmpty():
        return _folded(whole(rows), max_calls, period, True)
    hot = checkpointed(hot)
    sliced = checkpointed(_sliced(rows, hot, slice_rows))
    logs = _settled_logs(sliced, max_calls, period)
    cold = whole(rows.join(hot, "key", "left_anti"))
    parts = cold.unionByName(_with_logs(as_segments(sliced), as_segments(logs)))
    return _folded(parts, max_calls, period, True)


def state_at(
    decided: DataFrame,
    now_micros: int,
    max_calls: int = MAX_CALLS,
    period_seconds: int = PERIOD_SECONDS,
) -> DataFrame:
    """Per key at an instant: admissions still counted, remaining calls, seconds to reset.

    The reset is measured from the oldest call in the log as the last attempt left it.
    """
    period = period_seconds * 1_000_000
    # A bucket as long as a period holds at most max_calls admissions, and both the log and the
    # calls still counted lie in the last two buckets with attempts.
    buckets = (
        decided.filter(F.col("t") <= now_micros)
        .groupBy("key", F.floor(F.col("t") / F.lit(period)).alias("bucket"))
        .agg(
            F.max("t").alias("last_t"),
            F.collect_list(F.when(F.col("admitted"), F.col("t"))).alias("calls"),
        )
    )
    latest = Window.partitionBy("key").orderBy(F.desc("bucket"))
    keys = (
        buckets.withColumn("rn", F.row_number().over(latest))
        .filter("rn <= 2")
        .groupBy("key")
        .agg(F.max("last_t").alias("last_t"), F.flatten(F.collect_list("calls")).alias("calls"))
    )
    within = lambda now: F.filter("calls", lambda t: now - t < period)
    active = F.size(within(F.lit(now_micros))).cast("bigint")
    waited = F.lit(now_micros) - F.array_min(within(F.col("last_t")))
    return keys.select(
        "key", active.alias("active"),
        F.greatest(F.lit(0), F.lit(max_calls) - active).alias("remaining"),
        (F.greatest(F.lit(0), F.lit(period) - waited) / F.lit(1e6)).alias("reset_seconds"),
    )
