"""Filters, deduplication, ordering, counts and scores."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from siftline.operators import filters, metrics, ranking, reports
from siftline.schemas import SEVERITY_RANK

LEVELS = ["critical", "high", "medium", "low", "info", "HIGH", "odd", None]


def many(n=400, seed=3, hot=False):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        file = "hot.py" if hot and i % 3 == 0 else f"d{rnd.randint(0, 3)}/f{rnd.randint(0, 5)}.py"
        line, message = (1, "m") if hot and i % 3 == 0 else (rnd.randint(0, 4), f"m{rnd.randint(0, 3)}")
        out.append(
            (file, line, rnd.choice(LEVELS), rnd.choice(["security", "bug", "style"]), message,
             rnd.choice(["static", "codex-bug", "security", None]), i)
        )
    rnd.shuffle(out)
    return out


def kept(data, better):
    best = {}
    for r in sorted(data, key=lambda r: r[6]):
        key = (r[0], r[1], r[4])
        if key not in best or better(r, best[key]):
            best[key] = r
    return sorted(r[6] for r in best.values())


def seqs(df):
    return sorted(r.seq for r in df.collect())


@pytest.mark.parametrize("hot", [False, True])
def test_dedup_variants(findings, hot):
    data = many(hot=hot)
    df = findings(*data).repartition(5)
    rank = lambda r: SEVERITY_RANK.get(r[2], 0)
    assert seqs(ranking.keep_most_severe(df)) == kept(data, lambda a, b: rank(a) > rank(b))
    assert seqs(ranking.keep_first(df)) == kept(data, lambda a, b: False)
    assert seqs(ranking.keep_last(df)) == kept(data, lambda a, b: True)


def test_dedup_limits_each_task_before_the_shuffle(findings):
    plan = ranking.keep_most_severe(findings(*many()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert "Partial" in plan


def test_rank_is_a_total_order_without_a_single_task(findings):
    data = many(hot=True)
    want = sorted(data, key=lambda r: (-SEVERITY_RANK.get(r[2], 0), r[1], r[6]))
    got = ranking.ranked(findings(*data).repartition(6)).orderBy("rank").collect()
    assert [r.seq for r in got] == [r[6] for r in want]
    assert [r["rank"] for r in got] == list(range(1, len(data) + 1))


def test_numbering_inside_severity(findings):
    data = many()
    got = {r.seq: r.label for r in ranking.numbered_in_severity(findings(*data)).collect()}
    want = {}
    for name in SEVERITY_RANK:
        of = sorted(r[6] for r in data if r[2] == name)
        want.update({s: f"{name[0].upper()}{i}" for i, s in enumerate(of, 1)})
    assert got == want


def test_top_per_severity(findings):
    data = many()
    got = ranking.top_per_severity(findings(*data), 10)
    for bucket in SEVERITY_RANK:
        of = sorted(r[6] for r in data if (r[2] if r[2] in SEVERITY_RANK else "low") == bucket)
        part = got.filter(F.col("bucket") == bucket).orderBy("position").collect()
        assert [r.seq for r in part] == of[:10]
        assert {r.more for r in part} == {max(0, len(of) - 10)}


def test_top_n_and_remainder(findings):
    got = ranking.top_n(findings(*many(30)), 25).collect()
    assert len(got) == 25 and {r.more for r in got} == {5}
    assert {r.more for r in ranking.top_n(findings(*many(3)), 25).collect()} == {0}


def test_two_equal_findings_are_one(findings):
    row = ("a.py", 1, "high", "security", "Issue", None)
    assert ranking.keep_first(findings((*row, 0), (*row, 1))).count() == 1


def test_severity_filters(findings):
    df = findings(*many())
    values = lambda d: {r.severity for r in d.select("severity").distinct().collect()}
    assert values(df.transform(filters.min_severity("high"))) == {"critical", "high"}
    assert values(df.transform(filters.min_severity("info"))) == set(LEVELS)
    assert values(df.transform(filters.min_severity("bogus"))) == set(LEVELS)
    assert values(df.transform(filters.min_severity_strict("low"))) == set(SEVERITY_RANK)
    assert values(df.transform(filters.min_severity_strict(None))) == set(LEVELS)


def test_type_path_and_custom_filters(findings):
    df = findings(*many())
    types = lambda d: {r.type for r in d.select("type").distinct().collect()}
    assert types(df.transform(filters.by_type(["bug", "style"], ["style"]))) == {"bug"}
    assert types(df.transform(filters.by_type([], ["style"]))) == {"bug", "security"}
    files = {r.file for r in df.transform(filters.by_path(["d1/"], ["f2"])).collect()}
    assert files and all("d1/" in f and "f2" not in f for f in files)
    chained = df.transform(
        filters.chain(filters.min_severity("high"), filters.custom(lambda d: d.line_number > 1))
    )
    assert chained.count() == sum(1 for r in many() if r[2] in ("critical", "high") and r[1] > 1)
    plan = chained._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") == 1


def test_counts(findings):
    df = findings(
        ("a", 1, "critical", "security", "a", None, 0), ("a", 2, "HIGH", "bug", "b", None, 1),
        ("b", 3, "high", "bug", "c", None, 2), ("b", 4, "medium", "bug", "d", None, 3),
        ("b", 5, "odd", "bug", "e", None, 4),
    )
    assert rows(metrics.count_by_severity(df), "ord", "severity", "count") == [
        (0, "critical", 1), (1, "high", 2), (2, "medium", 1), (3, "low", 0),
    ]
    assert rows(metrics.count_by_severity(df.limit(0)), "count") == [(0,)] * 4
    assert [tuple(r) for r in metrics.count_by_type(df).collect()] == [("bug", 4), ("security", 1)]
    assert [tuple(r) for r in metrics.top_files(df, 1).collect()] == [("b", 3, 1)]
    assert [r.ord for r in metrics.count_by_any_severity(df).collect()] == [0, 1, 2, 99, 99]


def test_scores(findings):
    df = findings(
        *[("a", i, "critical", "security", "x", None, i) for i in range(8)],
        ("b", 1, "warning", "style", "x", None, 90), ("b", 1, "low", "security", "x", None, 91),
    )
    assert rows(metrics.scores(df, "file"), "file", "maintainability", "security", "quality") == [
        ("a", 20.0, 0.0, 10.0), ("b", 94.0, 85.0, 89.5),
    ]
    assert rows(metrics.scores(df.limit(0)), "maintainability", "security", "quality") == [(100.0, 100.0, 100.0)]


def test_category_and_cve_joins(spark):
    df = spark.createDataFrame([(1, "CWE-89"), (2, "CWE-338"), (3, None)], "seq int, cwe_id string")
    assert rows(metrics.with_owasp(df), "seq", "owasp") == [(1, "A03:2021 - Injection")]
    assert rows(metrics.with_cves(df), "seq", "cwe_name", "cves") == [
        (1, "SQL Injection", "CVE-2021-34473, CVE-2019-18348"), (2, "Unknown", ""), (3, "Unknown", ""),
    ]


def test_file_stats_can_go_negative(findings):
    df = findings(
        ("a", 1, "high", "bug", "m", "static", 0), ("a", 1, "high", "bug", "m", "codex-bug", 1),
        ("a", 2, "high", "bug", "n", "security", 2),
    )
    assert rows(metrics.file_stats(df), "issues_count", "static_issues", "pack_issues", "model_issues") == [(2, 1, 1, 0)]


PROGRESS = "name string, status string, start_time timestamp_ntz, end_time timestamp_ntz"


def test_progress(spark):
    items = spark.sql(
        "SELECT * FROM VALUES ('item1','completed',TIMESTAMP_NTZ'2024-01-01 00:00:00',TIMESTAMP_NTZ'2024-01-01 00:00:05'),"
        "('item2','running',TIMESTAMP_NTZ'2024-01-01 00:00:07',NULL) AS t(name,status,start_time,end_time)"
    )
    p = metrics.progress(items).first()
    assert (p.total, p.completed, p.running, p.failed, p.skipped) == (2, 1, 1, 0, 0)
    assert (p.elapsed_seconds, p.current) == (7.0, "item2")
    assert tuple(metrics.completion(items).first()) == (False, False)
    done = items.filter("status = 'completed'")
    assert tuple(metrics.completion(done).first()) == (True, False)
    assert tuple(metrics.completion(items.limit(0)).first()) == (False, False)
    failed = done.withColumn("status", F.lit("failed"))
    assert tuple(metrics.completion(failed).first()) == (True, True)
    assert [r.d for r in items.select(metrics.duration_seconds().alias("d")).orderBy("d").collect()] == [None, 5.0]


def test_gate_and_digest(findings):
    df = findings(("a", 1, "critical", "bug", "m", None, 0), ("a", 2, "warning", "bug", "n", None, 1))
    assert tuple(metrics.gate(df).first()) == (1, True)
    assert tuple(metrics.gate(df.filter("line_number = 2")).first()) == (0, False)
    assert metrics.digest(df).first()[0].startswith("Found 1 critical issues and 1 warnings.")


def test_summary_rows(corpus, findings):
    df = findings(("a", 1, "high", "bug", "m", None, 0), ("a", 2, "low", "bug", "n", None, 1))
    got = rows(metrics.review_summary(corpus("a\n\nb", "c"), df), "metric", "key", "value")
    assert got == [
        ("files_reviewed", "", 2), ("lines_of_code", "", 3), ("severity", "high", 1),
        ("severity", "low", 1), ("total_issues", "", 2), ("type", "bug", 2),
    ]
    empty = rows(metrics.review_summary(corpus("x"), df.limit(0)), "metric", "value")
    assert ("total_issues", 0) in empty


def test_reports(findings, corpus, tmp_path):
    df = findings(
        ("d/a.py", 5, "high", "security", "Hardcoded secret", "static", 0),
        ("d/a.py", 10, "medium", "style", "Name", None, 1),
        *[("b.py", i, "low", "style", f"m{i}", None, 10 + i) for i in range(12)],
    ).withColumn("suggestion", F.when(F.col("seq") == 0, "Use a vault"))
    texts = [r.text for r in reports.markdown(df).filter("file = 'd/a.py'").orderBy("section", F.desc("severity_rank")).collect()]
    assert texts[0] == "# Review\n**Path:** `d/a.py`\n**Total:** 2 issues\n**Codex bugs:** 0\n"
    assert texts[1] == (
        "### 🟠 HIGH: security\n- **File:** `d/a.py` (line 5)\n- **Message:** Hardcoded secret\n"
        "- **Fix:** Use a vault\n- **Stage:** static\n"
    )
    for blocks, chunks in ((100, 1), (5, 3)):
        parts = reports.markdown_texts(df, blocks)
        of_a = parts.filter("file = 'd/a.py'").orderBy("chunk").collect()
        assert "".join(r.text for r in of_a) == "".join(texts)
        assert parts.count() >= chunks and all(r.text.count("### ") <= blocks for r in parts.collect())
    comment = [r.text for r in reports.comment_lines(df).orderBy("ord", "position").collect()]
    assert comment[:4] == ["### 🟠 HIGH (1)", "- **a.py:5** - Hardcoded secret", "### 🟡 MEDIUM (1)", "- **a.py:10** - Name"]
    assert comment[-1] == "- ... and 2 more" and len(comment) == 16
    summary = [r.text for r in reports.text_summary(corpus("x", "y\n"), df).orderBy("part", "ord").collect()]
    assert summary[:3] == ["Files Analyzed: 2", "Lines of Code: 2", "  🔴 CRITICAL: 0"]
    whole = [r.text for r in reports.comment(corpus("x", "y\n"), df).orderBy("ord", "position").collect()]
    assert whole[:3] == ["| Files Analyzed | 2 |", "| Lines of Code | 2 |", "| Issues Found | 14 |"]
    assert whole[3:] == comment
    clean = reports.comment(corpus("x"), df.limit(0)).orderBy("position").collect()
    assert [r.text for r in clean][2:] == ["| Issues Found | 0 |", "✅ **No issues found!**"]
    listing = reports.text_listing(df.filter("file = 'd/a.py'")).orderBy("category", "section", "seq").collect()
    assert [r.text for r in listing] == [
        "SECURITY: 1", "SECURITY ISSUES:", "  Line 5: Hardcoded secret", "STYLE: 1", "STYLE ISSUES:", "  Line 10: Name",
    ]
    reports.write_markdown(df, str(tmp_path / "md"))
    written = df.sparkSession.read.text(str(tmp_path / "md"))
    assert written.filter("value LIKE '# Review%'").count() == 2


def test_order_of_scan_findings_does_not_depend_on_partitions(spark):
    data = [
        (f"f{i % 5}", i % 7, ("critical", "high", "low")[i % 3], "bug", f"m{i % 4}", "bugs", i % 6) for i in range(200)
    ]
    columns = "file string, line_number int, severity string, type string, message string, stage string, seq bigint"
    results = []
    for parts in (3, 7):
        df = spark.createDataFrame(data[:: -1 if parts == 7 else 1], columns).repartition(parts)
        top = ranking.top_per_severity(df, by_file=True)
        numbered = ranking.numbered_in_severity(df.distinct(), by_file=True)
        results.append(
            (
                rows(top, "bucket", "file", "seq", "line_number", "message", "position"),
                rows(numbered, "label", "file", "seq", "line_number", "message"),
            )
        )
    assert results[0] == results[1]


def test_the_earlier_stage_keeps_an_equal_finding(spark):
    columns = "file string, line_number int, severity string, type string, message string, stage string, seq bigint, branch int"
    both = [("a", 1, "high", "x", "m", "style", 1, 1), ("a", 1, "high", "y", "m", "bugs", 2, 1)]
    for order in (both, both[::-1]):
        kept = ranking.keep_most_severe(spark.createDataFrame(order, columns))
        assert rows(kept, "stage", "type") == [("bugs", "y")]


def test_a_long_report_comes_in_ordered_chunks(spark):
    df = spark.range(25_000).selectExpr(
        "if(id % 50 = 0, 'b.py', 'a.py') AS file", "CAST(id % 9 AS INT) AS line_number", "'low' AS severity", "'t' AS type",
        "CAST(id AS STRING) AS message", "CAST(NULL AS STRING) AS suggestion", "CAST(NULL AS STRING) AS stage", "id AS seq",
    )
    got = reports.markdown_texts(df, 1000).filter("file = 'a.py'").orderBy("chunk").collect()
    assert [r.chunk for r in got] == list(range(len(got))) and len(got) == 25
    messages = [int(l.split("** ")[1]) for r in got for l in r.text.split("\n") if l.startswith("- **Message")]
    assert messages == sorted((i for i in range(25_000) if i % 50), key=lambda i: (i % 9, i))
