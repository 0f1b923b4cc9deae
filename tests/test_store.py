import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from siftline.operators import learning, reviews
from siftline.sources.store import LearningStore
from siftline.streaming import jobs
from test_learning import OBS, START, as_dict, grouped, log


def files_of(root):
    return {
        os.path.relpath(os.path.join(d, f), root): os.path.getmtime(os.path.join(d, f))
        for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")
    }


def test_days_and_buckets_that_are_not_touched_keep_their_files(spark, tmp_path):
    data = log(120, days=12)
    obs = spark.createDataFrame(data, OBS)
    store = LearningStore(spark, str(tmp_path / "store"), buckets=16)
    store.record(obs, batch="first")
    store.consolidate(str(START + timedelta(days=13)))
    before = files_of(tmp_path / "store")
    last = max(r[6] for r in data)
    one = [(1_000, "security:new", "python", "z.py", "low", "new", last + timedelta(minutes=1), "static")]
    store.record(spark.createDataFrame(one, OBS), batch="second")
    store.consolidate(str(START + timedelta(days=13)))
    after = files_of(tmp_path / "store")
    day = str(last.date())
    changed = {f for f in set(before) | set(after) if before.get(f) != after.get(f)}
    assert changed
    assert all(f.startswith(("epochs", "patterns/")) or f"day={day}" in f for f in changed)
    assert len({f.split("/")[1] for f in changed if f.startswith("patterns/")}) == 1
    assert as_dict(store.log_patterns()) == grouped(data + one)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    data = log(90, days=50)
    store = LearningStore(spark, str(tmp_path / "store"))
    now = START + timedelta(days=51)
    handle = jobs.record_into(store, lambda batch: str(now))
    parts = [spark.createDataFrame(data[i::3], OBS) for i in range(3)]
    for epoch, part in enumerate(parts):
        handle(part, epoch)
    live = [r for r in data if r[6] > now - timedelta(days=learning.RETENTION_DAYS)]
    assert as_dict(store.log_patterns()) == grouped(live)
    assert store.observations().count() == len(live)
    before = files_of(tmp_path / "store")
    for epoch, part in enumerate(parts):
        handle(part, epoch)
    assert files_of(tmp_path / "store") == before
    # a batch that failed between its recording and its consolidation
    store.record(parts[2], batch="epoch-2")
    store.consolidate(str(now), 2)
    assert as_dict(store.log_patterns()) == grouped(live)


def test_a_consolidation_merges_the_counts_once(spark, tmp_path, monkeypatch):
    data = log(60, days=5)
    store = LearningStore(spark, str(tmp_path / "store"), buckets=4)
    store.record(spark.createDataFrame(data, OBS))
    merged, seen = LearningStore.log_patterns, spark.sparkContext.accumulator(0)

    def noted(key):
        seen.add(1)
        return key

    counted = F.udf(noted, "string").asNondeterministic()
    monkeypatch.setattr(
        LearningStore, "log_patterns", lambda self: merged(self).withColumn("pattern_key", counted("pattern_key"))
    )
    summary = store.consolidate(str(START + timedelta(days=6)))
    assert summary["new_patterns"] == seen.value == len(grouped(data))
    assert as_dict(store.patterns()) == grouped(data)


def test_nothing_is_left_when_all_is_old(spark, tmp_path):
    data = log(20, days=3)
    store = LearningStore(spark, str(tmp_path / "store"))
    store.record(spark.createDataFrame(data, OBS))
    summary = store.consolidate(str(START + timedelta(days=90)))
    assert summary["observations_pruned"] == 20 and summary["observations_remaining"] == 0
    assert store.observations() is None and store.log_patterns() is None
    assert as_dict(store.patterns()) == grouped(data)
    assert store.consolidate(str(START + timedelta(days=90))) == {}


@pytest.mark.parametrize("parts", [3, 7])
def test_first_seen_follows_the_place_not_the_partitions(spark, parts):
    """Positions of a scan repeat across files; the order of files decides."""
    found = [
        (f"f{i % 5}.py", 1 + i % 2, "high" if i % 3 else "low", "security", f"secret {i % 7}", "static", i // 5)
        for i in range(60)
    ]
    random.Random(parts).shuffle(found)
    columns = "file string, line_number int, severity string, type string, message string, stage string, seq bigint"
    df = spark.createDataFrame(found, columns).repartition(parts)
    obs = learning.review_observations(df, F.lit("python"), F.lit(START))
    got = learning.grouped_patterns(obs, "place").first()
    rank = {"high": 3, "low": 1}
    ordered = sorted(found, key=lambda r: (r[0], -rank[r[2]], r[1], r[4]))
    messages = list(dict.fromkeys(r[4] for r in ordered))[:3]
    assert got["example_messages"] == messages
    assert got["count"] == 60
    by_day = learning.partials(obs.withColumn("day", F.col("file_path")), "place", ("day",))
    assert learning.finished(learning.merged(by_day)).first() == got


def by_hand(requests, entries, ttl):
    out = []
    for rid, key, ts in requests:
        past = [(t, d) for k, t, d in entries if k is not None and k == key and ts is not None and t <= ts]
        best = max(past) if past else None
        hit = best is not None and ts - best[0] <= timedelta(seconds=ttl)
        out.append((rid, key, best[1] if hit else None, hit))
    return sorted(out, key=lambda r: r[0])


def test_lookup_at_the_requests_own_time(spark):
    rng = random.Random(5)
    base = datetime(2024, 3, 1)
    keys = ["hot"] * 30 + ["a", "b", None]
    entries = [(rng.choice(keys), base + timedelta(seconds=rng.randrange(4000)), i) for i in range(150)]
    requests = [(i, rng.choice([*keys, "none"]), base + timedelta(seconds=rng.randrange(9000))) for i in range(200)]
    # exactly at the limit, a microsecond later, at the same instant, and without a time
    entries.append(("edge", base, 900))
    requests += [
        (900, "edge", base + timedelta(seconds=100)), (901, "edge", base + timedelta(seconds=100, microseconds=1)),
        (902, "edge", base), (903, "edge", None), (904, "edge", base - timedelta(microseconds=1)),
    ]
    for ttl, parts in ((100, 16), (1000, 1), (7, 3)):
        found = reviews.lookup_as_of(
            spark.createDataFrame(requests, "id int, key string, ts timestamp_ntz"),
            spark.createDataFrame(entries, "key string, ts timestamp_ntz, data int"), ttl, parts,
        )
        got = sorted((r["id"], r["key"], r["data"], r["hit"]) for r in found.collect())
        assert got == by_hand(requests, entries, ttl)


def test_lookup_without_rows(spark):
    requests = spark.createDataFrame([], "id int, key string, ts timestamp_ntz")
    entries = spark.createDataFrame([], "key string, ts timestamp_ntz, data int")
    assert rows(reviews.lookup_as_of(requests, entries), "id") == []
    one = spark.createDataFrame([(1, "k", datetime(2024, 1, 1))], requests.schema)
    assert rows(reviews.lookup_as_of(one, entries), "id", "data", "hit") == [(1, None, False)]
