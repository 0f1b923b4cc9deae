import random
from collections import deque
from datetime import datetime, timedelta

import numpy as np
import pytest
from siftline.operators import ratelimit

START = datetime(2024, 1, 1)


def limited(events, max_calls, period):
    logs, out = {}, {}
    for key, ts, rid in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        log = [t for t in logs.get(key, []) if (ts - t).total_seconds() < period]
        ok = len(log) < max_calls
        logs[key] = log + [ts] if ok else log
        out[(key, rid)] = ok
    return out


def frame(spark, events):
    return spark.createDataFrame(events, "key bigint, ts timestamp_ntz, id bigint").repartition(5)


def run(spark, events, **kw):
    got = ratelimit.admissions(frame(spark, events), "key", "ts", "id", **kw).collect()
    assert len(got) == len(events)
    return {(r.key, r.id): r.admitted for r in got}


def test_only_admitted_calls_count(spark):
    events = [(1, START + timedelta(seconds=s), s) for s in (0, 10, 20, 30, 65, 66)]
    got = run(spark, events, max_calls=3, period_seconds=60)
    assert [got[(1, s)] for s in (0, 10, 20, 30, 65, 66)] == [True, True, True, False, True, False]


def test_ten_of_twenty_at_once(spark):
    events = [(1, START, i) for i in range(20)]
    assert sum(run(spark, events, max_calls=10, period_seconds=1).values()) == 10


def stream(kind, n, seed):
    rnd = random.Random(seed)
    if kind == "random":
        return [(k, START + timedelta(milliseconds=rnd.randint(0, 400_000)), i * 7 + k) for i in range(n) for k in (1, 2, 3)]
    if kind == "saturated":
        return [(1, START + timedelta(milliseconds=37 * i), i) for i in range(n * 3)]
    if kind == "regular":
        return [(1, START + timedelta(seconds=i), i) for i in range(n)] + [(2, START, 10_000)]
    bursts = [(1, START + timedelta(seconds=20 * (i // 50), microseconds=i % 3), i) for i in range(n)]
    return bursts + [(2, START + timedelta(seconds=i), 50_000 + i) for i in range(20)]


@pytest.mark.parametrize("kind", ["random", "saturated", "regular", "bursts"])
@pytest.mark.parametrize("slice_rows", [10**9, 40])
def test_slices_give_the_sequential_answer(spark, kind, slice_rows):
    events = stream(kind, 150, 5)
    want = limited(events, 4, 30)
    assert run(spark, events, max_calls=4, period_seconds=30, slice_rows=slice_rows) == want
    assert True in want.values() and False in want.values()


def test_a_burst_at_one_instant_is_cut(spark):
    events = [(1, START + timedelta(microseconds=i // 100), i) for i in range(2_000)] + [(1, START + timedelta(days=365), 9_999)]
    rows = frame(spark, events).selectExpr("key", "unix_micros(CAST(ts AS timestamp)) AS t", "id")
    hot = spark.createDataFrame([(1,)], "key bigint")
    sizes = [r["count"] for r in ratelimit._sliced(rows, hot, 100).groupBy("slice").count().collect()]
    assert len(sizes) == 21 and max(sizes) == 100
    want = limited(events, 5, 60)
    assert run(spark, events, max_calls=5, period_seconds=60, slice_rows=100) == want


def test_a_sparse_stretch_is_admitted_whole():
    for log in ([], [-3], [-30, -20, -1]):
        for t in ([0, 10, 20, 30, 40], [0, 1, 2, 3], [0, 5, 12, 30, 31, 32, 90]):
            slow, fast = deque(log), deque(log)
            want = [ratelimit.take(slow, x, 3, 20) for x in t]
            got = ratelimit.fold_run(np.array(t, np.int64), fast, 3, 20)
            while slow and t[-1] - slow[0] >= 20:
                slow.popleft()
            assert got.tolist() == want and list(fast) == list(slow)


def test_state_at_an_instant(spark):
    events = [(1, START + timedelta(seconds=s), s) for s in (0, 1, 2, 3)] + [(2, START, 0)]
    decided = ratelimit.admissions(frame(spark, events), "key", "ts", "id", 2, 10)
    base = int((START - datetime(1970, 1, 1)).total_seconds() * 1e6)
    at = lambda s: {
        r.key: (r.active, r.remaining, r.reset_seconds)
        for r in ratelimit.state_at(decided, base + s * 1_000_000, 2, 10).collect()
    }
    assert at(4) == {1: (2, 0, 6.0), 2: (1, 1, 6.0)}
    assert at(10) == {1: (1, 1, 0.0), 2: (0, 2, 0.0)}
    assert at(50) == {1: (0, 2, 0.0), 2: (0, 2, 0.0)}
