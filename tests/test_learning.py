"""Consolidation against a direct Python computation, and the stored tables."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import rows
from siftline.functions import keys
from siftline.operators import learning
from siftline.schemas import PATTERNS
from siftline.sources.store import LearningStore

START = datetime(2024, 1, 1)
OBS = (
    "seq bigint, pattern_key string, language string, file_path string, severity string, "
    "message string, ts timestamp_ntz, stage string"
)


def log(n=300, seed=1, days=60, key_count=12):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = "security:hardcoded_secret" if i % 3 == 0 else f"bug:k{rnd.randint(0, key_count)}"
        out.append(
            (i, key, rnd.choice(["python", "go", "rust"]), "f", rnd.choice(["high", "low"]),
             f"message {rnd.randint(0, 30)}", START + timedelta(hours=rnd.randint(0, days * 24)), None)
        )
    return out


def grouped(data):
    by_key = defaultdict(list)
    for r in sorted(data):
        by_key[r[1]].append(r)
    out = {}
    for key, rs in by_key.items():
        messages = list(dict.fromkeys(r[5] for r in rs))[:3]
        out[key] = (
            Counter(r[2] for r in rs).most_common(1)[0][0], len(rs), min(r[6] for r in rs),
            max(r[6] for r in rs), Counter(r[4] for r in rs).most_common(1)[0][0], messages,
        )
    return out


COLUMNS = ["language", "count", "first_seen", "last_seen", "typical_severity", "example_messages"]


def as_dict(df):
    return {r.pattern_key: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_grouping_matches_python(spark):
    data = log()
    df = spark.createDataFrame(data, OBS).repartition(7)
    assert as_dict(learning.grouped_patterns(df)) == grouped(data)


def test_ties_go_to_the_first_seen(spark):
    t = START
    data = [(0, "k", "go", "f", "low", "b", t, None), (1, "k", "python", "f", "high", "a", t, None)]
    got = as_dict(learning.grouped_patterns(spark.createDataFrame(data, OBS)))
    assert got == {"k": ("go", 2, t, t, "low", ["b", "a"])}


def test_upsert(spark):
    old, new = log(200, 1, key_count=20), log(200, 2, key_count=30)
    stored = learning.as_patterns(
        learning.upsert(spark.createDataFrame([], PATTERNS), spark.createDataFrame(old, OBS))
    )
    merged = learning.upsert(stored, spark.createDataFrame(new, OBS))
    before, fresh = grouped(old), grouped(new)
    want = dict(before)
    for key, (lang, n, first, last, sev, ex) in fresh.items():
        if key in before:
            want[key] = (before[key][0], n, before[key][2], last, sev, ex)
        else:
            want[key] = fresh[key]
    assert as_dict(merged) == want
    outcome = {r.pattern_key: r.outcome for r in merged.collect()}
    assert outcome == {
        k: "updated" if k in before and k in fresh else "kept" if k in before else "new" for k in want
    }


def test_retention_is_strict(spark):
    now = START + timedelta(days=30)
    data = [(i, "k", "go", "f", "low", "m", START + timedelta(seconds=s), None) for i, s in enumerate((-1, 0, 1))]
    kept = learning.retained(spark.createDataFrame(data, OBS), str(now))
    assert [r.seq for r in kept.collect()] == [2]


def test_pattern_keys(spark):
    cases = [
        ("security", "Potential hardcoded secret detected", "security:hardcoded_secret"),
        ("style", "Unused import: json", "style:unused_import"),
        ("security", "SQL injection in execute", "security:dangerous_exec"),
        ("bug", "Empty EXCEPT block", "bug:empty_except"),
        ("bug", "SQL Injection", "bug:sql_injection"),
        ("performance", "String concatenation in LOOP", "performance:string_concat_in_loop"),
        ("", "FIXME later", "unknown:todo_comment"),
        (None, "plain", "unknown:" + __import__("hashlib").md5(b"plain").hexdigest()[:8]),
    ]
    df = spark.createDataFrame(cases, "type string, message string, want string")
    got = df.select("want", keys.pattern_key(F.col("type"), F.col("message")).alias("got")).collect()
    assert all(r.want == r.got for r in got), got


def patterns(spark, *specs):
    cols = [(k, l, n, START, START, s, ["m"], None, g) for k, l, n, s, g in specs]
    return spark.createDataFrame(cols, PATTERNS)


def test_rules_and_flags(spark):
    df = patterns(
        spark, ("security:hardcoded_secret", "python", 5, "high", False),
        ("bug:hardcoded_secret", "go", 2, "high", False), ("style:unused_import", "go", 3, "low", False),
        ("bug:empty_except", "python", 9, "low", True), ("bug:abcd", "python", 50, "low", False),
    )
    emitted = learning.rules(df)
    assert rows(emitted, "id", "type", "message") == [
        ("learned_security:hardcoded_secret", "regex", "Learned pattern: hardcoded secret (seen 5x in python)"),
        ("learned_style:unused_import", "ast", "Learned pattern: unused import (seen 3x in go)"),
    ]
    flagged = rows(learning.flag_generated(df, emitted).filter("custom_rule_generated"), "pattern_key")
    assert flagged == [("bug:empty_except",), ("security:hardcoded_secret",), ("style:unused_import",)]


def test_priorities_use_the_type_prefix(spark):
    df = patterns(spark, ("security:a", "go", 3, "h", False), ("bug:b", "go", 7, "h", False), ("bug:b2", "go", 1, "h", False))
    ask = lambda t, l: learning.should_prioritise(df, t, l).first()[0]
    assert ask("bug", "go") and not ask("security", "go") and not ask("bugs", "go") and not ask("bug", "rust")
    got = rows(learning.priorities(df, ["security", "bug"]), "type", "total", "type_total", "prioritise")
    assert got == [("bug", 11, 8, True), ("security", 11, 3, False)]


def test_hot_patterns(spark):
    df = patterns(spark, ("a", "go", 3, "h", False), ("b", "go", 7, "h", False), ("c", "rust", 9, "h", False))
    assert [r.pattern_key for r in learning.hot_patterns(df, "go").collect()] == ["b", "a"]
    assert [r.pattern_key for r in learning.hot_patterns(df, limit=1).collect()] == ["c"]


def test_store_keeps_both_tables(spark, tmp_path):
    data = log(120, days=90)
    df = spark.createDataFrame(data, OBS)
    store = LearningStore(spark, str(tmp_path / "store"))
    assert store.consolidate("2024-01-01 00:00:00") == {}
    store.record(df.filter("seq < 60"))
    store.record(df.filter("seq >= 60"))
    now = START + timedelta(days=70)
    summary = store.consolidate(str(now))
    recent = [r for r in data if r[6] > now - timedelta(days=30)]
    assert summary["new_patterns"] == summary["total_consolidated"] == len(grouped(data))
    assert (summary["observations_pruned"], summary["observations_remaining"]) == (120 - len(recent), len(recent))
    assert as_dict(store.patterns()) == grouped(data)
    assert store.observations().count() == len(recent)
    again = store.consolidate(str(now))
    assert again["new_patterns"] == 0 and again["observations_pruned"] == 0
    first = {r.pattern_key for r in store.generate_rules().collect()}
    assert first == {"security:hardcoded_secret"}
    assert store.generate_rules().isEmpty()


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    df = spark.createDataFrame(log(20, days=1), OBS)
    store = LearningStore(spark, str(tmp_path / "store"))
    store.record(df, batch="epoch-0")
    store.record(df, batch="epoch-0")
    assert store.observations().count() == 20
    store.consolidate("2024-01-05 00:00:00", epoch=0)
    assert store.last_epoch() == 0


def test_project_summary(spark):
    data = log(100)
    obs = spark.createDataFrame(data, OBS)
    got = rows(learning.project_summary(obs, patterns(spark, ("a", "go", 3, "h", False))), "section", "key", "n")
    want = [("total_observations", "", 100), ("unique_patterns", "", 1)]
    for section, column, limit in (("severity", 4, None), ("language", 2, 10), ("pattern", 1, 10)):
        want += [(section, k, n) for k, n in Counter(r[column] for r in data).most_common(limit)]
    assert got == sorted(want)
    empty = learning.project_summary(obs.limit(0), patterns(spark))
    assert rows(empty, "section", "n") == [("total_observations", 0), ("unique_patterns", 0)]
