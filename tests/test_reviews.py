import hashlib
import json

from pyspark.sql import functions as F

from conftest import rows
from siftline.operators import reviews

ITEM = '{"severity":"low","type":"bug","message":"m","line_number":3,"suggestion":"s","confidence":"high"}'
FENCE = "```"


def reference(content):
    """What the response parser is meant to return, with the standard JSON parser."""
    def load(text):
        try:
            value = json.loads(text)
        except ValueError:
            return None
        return value if isinstance(value, list) else None

    if not content:
        return []
    content = content.strip()
    whole = load(content)
    if whole is not None:
        return whole
    if "```json" in content:
        content = content.split("```json")[1].split("```")[0]
    elif "```" in content:
        content = content.split("```")[1]
        content = content[4:] if content.startswith("json") else content
    return load(content.strip()) or []


RESPONSES = [
    f"[{ITEM}]", f"  [{ITEM},{ITEM}]\n", f"[{ITEM}] tail", ITEM, f"[{ITEM}", "", "[]", "text", None,
    f"Here\n{FENCE}json\n[{ITEM}]\n{FENCE}\nbye", f"{FENCE}\n[{ITEM}]\n{FENCE}", f"{FENCE}json[{ITEM}]{FENCE}",
    f"{FENCE}python\n[{ITEM}]\n{FENCE}", f"x {FENCE} y", f"{FENCE}json\n{ITEM}\n{FENCE}",
    f"[{ITEM}] [{ITEM}]", '[{"message":"only"}]', "[{'message':'single'}]", '[{"line_number":"12","message":"t"}]',
    f"{FENCE}json\n[{ITEM}]\n{FENCE} and {FENCE}json\n[]\n{FENCE}",
]


def test_responses_parse_as_intended(spark):
    df = spark.createDataFrame([(str(i), r) for i, r in enumerate(RESPONSES)], "path string, response string")
    got = rows(reviews.parse_responses(df), "file", "severity", "type", "message", "line_number", "confidence")
    want = sorted(
        (str(i), x.get("severity", "medium"), x.get("type", "best_practice"), x.get("message", "Issue found"),
         int(x.get("line_number", 0)), x.get("confidence", "high"))
        for i, r in enumerate(RESPONSES) for x in reference(r)
    )
    assert got == want


def test_stage_requests(spark):
    assert reviews.valid_stages(["bugs", "nope"]) == ["bugs"]
    assert reviews.valid_stages(["nope"]) == reviews.valid_stages(None) == list(reviews.STAGES)
    texts = ["Find SECURITY holes and speed it up", "check all", "hello", "review imports", "clean code"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.s for r in df.select("i", reviews.stages_of(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == [["security", "performance"], list(reviews.STAGES), list(reviews.STAGES), ["style"], ["style"]]


def test_prompts(spark, corpus):
    df = reviews.prompts(reviews.fan_out(corpus("a\nb\n"), ["security", "codex-bug"]))
    got = {r.stage: r for r in df.collect()}
    assert got["codex-bug"].system == reviews.BASE_PROMPT
    assert got["security"].system.endswith(reviews.STAGE_PROMPT["security"])
    assert "Language: python\nLines: 2\n" in got["security"].user
    assert "```python\na\nb\n\n```" in got["security"].user


def test_reuse_comes_before_the_size_guard(spark):
    files = spark.createDataFrame([("a", "x" * 20), ("b", "y" * 20), ("c", "z")], "path string, content string")
    asked = reviews.requests(files, ["bugs", "", None], "p")
    digest = hashlib.sha256(("x" * 20).encode()).hexdigest()[:16]
    assert rows(asked.filter("path = 'a'"), "key") == [
        (f"a:{digest}:bugs:p",), (f"a:{digest}:general:p",), (f"a:{digest}:general:p",),
    ]
    asked = reviews.requests(files, ["bugs", "style"], "p")
    stored = asked.filter("path = 'a' AND stage = 'bugs'").select("key", F.lit("old").alias("result"))
    planned = reviews.plan_requests(asked, stored, max_chars=10)
    assert rows(planned, "path", "stage", "action") == [
        ("a", "bugs", "reuse"), ("a", "style", "too_large"), ("b", "bugs", "too_large"),
        ("b", "style", "too_large"), ("c", "bugs", "compute"), ("c", "style", "compute"),
    ]
    assert rows(reviews.pending(files, planned), "path", "content", "stages") == [("c", "z", ["bugs", "style"])]


def test_ttl_expires_strictly_after_the_limit(spark):
    entries = spark.sql(
        "SELECT * FROM VALUES ('a', TIMESTAMP_NTZ'2024-01-01 00:00:00', 'old'),"
        "('a', TIMESTAMP_NTZ'2024-01-01 01:00:00', 'new'), ('b', TIMESTAMP_NTZ'2024-01-01 00:00:00', 'b'),"
        "('c', TIMESTAMP_NTZ'2023-12-31 23:59:59', 'c') AS t(key, ts, data)"
    )
    fresh = reviews.fresh_entries(entries, "2024-01-01 01:00:00", 3600)
    assert rows(fresh, "key", "data") == [("a", "new"), ("b", "b")]
    requests = spark.createDataFrame([("a",), ("c",), ("z",)], "key string")
    found = reviews.lookup_fresh(requests, entries, "2024-01-01 01:00:00", 3600)
    assert rows(found, "key", "hit") == [("a", True), ("c", False), ("z", False)]
    assert tuple(reviews.store_stats(entries, "2024-01-01 01:00:00", 3600).first()) == (4, 8, 1)
    assert tuple(reviews.store_stats(entries.limit(0), "2024-01-01 01:00:00").first()) == (0, 0, 0)


def test_imported_reports(spark):
    report = json.dumps(
        {"results": [
            {"issue_severity": "HIGH", "issue_text": "t", "line_number": 4, "test_id": "B1",
             "issue_cwe": {"id": 78, "url": "https://example.org/definitions/78.html", "description": "d"}},
            {"issue_severity": "UNDEFINED"},
        ]}
    )
    df = spark.createDataFrame([("a.py", report), ("b.py", "not json"), ("c.py", "{}")], "path string, report string")
    got = rows(reviews.imported_report(df), "seq", "severity", "message", "line_number", "cwe_id", "rule_id", "suggestion")
    assert got == [(0, "high", "t", 4, "CWE-78", "B1", "d"), (1, "medium", "Security issue", 0, None, "", "")]
