import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from conftest import rows
from siftline.operators import linescan, ratelimit
from siftline.sources.store import LearningStore
from siftline.streaming import jobs
from test_learning import OBS, START, as_dict, grouped, log

EVENTS = "key bigint, ts timestamp_ntz, id bigint"


def write_parts(df, path, order, parts=3):
    """One file per micro-batch, oldest first."""
    n = df.count()
    numbered = sorted(df.collect(), key=lambda r: r[order])
    size = -(-n // parts)
    for i in range(parts):
        chunk = numbered[i * size : (i + 1) * size]
        df.sparkSession.createDataFrame(chunk, df.schema).coalesce(1).write.mode("append").parquet(path)


def parts_in_order(df, path, chunks):
    """One file per micro-batch, in the order given."""
    for chunk in chunks:
        df.sparkSession.createDataFrame(chunk, df.schema).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("arrow_rows", [7, 10_000])
def test_limiter_stream_equals_batch(spark, tmp_path, arrow_rows):
    base = datetime(2024, 1, 1)
    data = [(i % 4, base + timedelta(seconds=3 * i + i % 5), i) for i in range(240)]
    events = spark.createDataFrame(data, EVENTS)
    batch = ratelimit.admissions(events, "key", "ts", "id", 2, 60)
    # Out of order inside a file and across files.
    random.Random(3).shuffle(data)
    parts_in_order(events, str(tmp_path / "in"), [data[:100], data[100:170], data[170:]])
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow_rows)
    try:
        with jobs.with_rocksdb(spark):
            out = jobs.limited_to_end(source, "key", "ts", "id", 2, 60)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = rows(batch, "key", "t", "id", "admitted")
    assert rows(out, "key", "t", "id", "admitted") == want
    assert {w[3] for w in want} == {True, False}


class _Memory:
    """A state variable in memory."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return iter(self.value) if isinstance(self.value, list) else self.value

    def update(self, value):
        self.value = value

    put = update

    def appendList(self, more):
        self.value = [*(self.value or []), *more]

    def clear(self):
        self.value = None


class _Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def _state(self, name, schema):
        return self.states.setdefault(name, _Memory())

    getListState = getValueState = _state

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


class _At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_limiter_forgets_idle_keys_of_any_type():
    handle = _Handle()
    limiter = jobs.Limiter(1, 10_000_000, StringType(), StringType())
    limiter.init(handle)
    pdf = pd.DataFrame({"key": ["a"] * 3, "t": [5_000_000, 1_000_000, 30_000_000], "id": ["y", "x", "z"]})
    assert list(limiter.handleInputRows(("a",), iter([pdf]), _At(0))) == []
    assert handle.timers == {1_000}

    def fire(ms):
        handle.timers = {t for t in handle.timers if t >= ms}
        out = list(limiter.handleExpiredTimer(("a",), _At(ms), None))
        return [tuple(r) for part in out for r in part[["id", "admitted"]].itertuples(index=False)]

    assert fire(6_000) == [("x", True), ("y", False)]
    assert handle.timers == {30_000}
    assert fire(31_000) == [("z", True)]
    assert handle.timers == {40_001}
    assert fire(41_000) == []
    assert not handle.timers and not any(s.exists() for s in handle.states.values())


def test_contents_are_scanned_once(spark, tmp_path):
    base = datetime(2024, 1, 1)
    data = [("a.py", "token = 'x'", base), ("b.py", "token = 'x'", base + timedelta(hours=1)), ("c.py", "secret='y'", base)]
    files = spark.createDataFrame(data, "path string, content string, mtime timestamp_ntz")
    write_parts(files, str(tmp_path / "in"), "mtime", 2)
    source = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.run_to_end(jobs.scanned(source, lambda c: linescan.check_lines(c, "hardcoded_secrets")))
    assert rows(out, "message") == [("Security issue: Hardcoded secret",), ("Security issue: Hardcoded token",)]


def test_observations_reach_the_store(spark, tmp_path):
    data = log(90, days=20)
    obs = spark.createDataFrame(data, OBS)
    write_parts(obs, str(tmp_path / "in"), "seq")
    store = LearningStore(spark, str(tmp_path / "store"))
    handle = jobs.record_into(store, lambda batch: str(START + timedelta(days=21)))
    query = (
        spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        .writeStream.foreachBatch(handle).trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    query.awaitTermination()
    # An update leaves language and first sighting as they were when the key was new.
    renewed = lambda d: {k: (x[1], x[3], x[4], x[5]) for k, x in d.items()}
    assert renewed(as_dict(store.patterns())) == renewed(grouped(data))
    before = store.observations().count()
    handle(obs, store.last_epoch())
    assert store.observations().count() == before == 90


def test_daily_pattern_counts(spark, tmp_path):
    data = log(60, days=5)
    obs = spark.createDataFrame(data, OBS)
    write_parts(obs, str(tmp_path / "in"), "ts")
    source = spark.readStream.schema(obs.schema).parquet(str(tmp_path / "in"))
    out = jobs.run_to_end(jobs.pattern_counts(source), mode="complete")
    want = obs.groupBy(F.to_date("ts").alias("d"), "pattern_key").agg(F.count("*").alias("count"))
    assert rows(out.withColumn("d", F.to_date("day")), "d", "pattern_key", "count") == rows(want, "d", "pattern_key", "count")
