"""Model-review batches: stages, prompts, responses, reuse of stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import keys
from siftline.functions import paths as pt
from siftline.functions import severity as sev
from siftline.functions import text as tx
from siftline.functions.paths import lookup
from siftline.operators.filters import with_defaults
from siftline.schemas import STAGES, as_findings

MAX_CHARS = 50000

# Command keywords by the stage they select; "all" selects every stage.
STAGE_KEYWORDS = {
    "security": (
        "security", "secure", "vulnerabilit", "vuln", "hack", "inject", "secret", "owasp",
        "exploit", "auth", "xss", "csrf",
    ),
    "bugs": (
        "bug", "error", "broken", "crash", "fix", "debug", "exception", "fault", "null", "none",
        "logic",
    ),
    "performance": (
        "performance", "slow", "fast", "optimi", "speed", "memory", "complexit", "efficient",
        "bottleneck",
    ),
    "style": (
        "style", "clean", "refactor", "quality", "messy", "readable", "naming", "duplication",
        "unused", "import", "document", "lint",
    ),
    "all": ("everything", "all", "full", "complete", "review", "check", "analyze", "scan"),
}

BASE_PROMPT = (
    "Review the source file below and report defects.\n"
    "Answer with a JSON array; every element has severity (critical, high, medium, low), type, "
    "message, line_number, suggestion and confidence. Answer [] when there is nothing to report."
)
STAGE_PROMPT = {
    "security": "Report security findings only: injection, secrets, unsafe deserialization, "
    "weak cryptography, missing validation.",
    "bugs": "Report probable bugs only: logic errors, unhandled failures, races, edge cases.",
    "performance": "Report performance findings only: needless complexity, allocation, "
    "blocking calls, repeated queries.",
    "style": "Report code-quality findings only: naming, length, duplication, dead code, "
    "documentation.",
}


def valid_stages(requested: list[str] | None) -> list[str]:
    chosen = [s for s in (requested or STAGES) if s in STAGES]
    return chosen or list(STAGES)


def fan_out(corpus: DataFrame, requested: list[str] | None = None) -> DataFrame:
    """Every file once per stage; unknown stages drop out, none valid means all."""
    stages = F.array(*[F.lit(s) for s in valid_stages(requested)])
    return corpus.withColumn("stage", F.explode(stages))


def stages_of(text: Column) -> Column:
    """Stages named by a plain-language request, in the order of the keyword table."""
    low = F.lower(tx.strip(text))
    named = F.array_compact(
        F.array(
            *[
                F.when(tx.contains_any(low, words), F.lit(stage))
                for stage, words in STAGE_KEYWORDS.items()
                if stage != "all"
            ]
        )
    )
    everything = F.array(*[F.lit(s) for s in STAGES])
    return F.when(F.size(named) > 0, named).otherwise(everything)


def prompts(requests: DataFrame) -> DataFrame:
    """``system`` and ``user`` texts for rows of ``path, content, stage``."""
    special = lookup(STAGE_PROMPT, F.col("stage"))
    hint = pt.language_hint(F.col("path"))
    code = F.col("content")
    user = F.concat(
        F.lit("## File\nName: "), pt.basename(F.col("path")),
        F.lit("\nLanguage: "), hint,
        F.lit("\nLines: "), tx.count_splitlines(code).cast("string"),
        F.lit("\n\n```"), hint, F.lit("\n"), code, F.lit("\n```\n"),
    )
    system = F.when(special.isNull(), F.lit(BASE_PROMPT)).otherwise(
        F.concat(F.lit(BASE_PROMPT + "\n\n## Focus\n"), special)
    )
    return requests.withColumns({"system": system, "user": user})


_ITEM = "struct<severity:string,type:string,message:string,line_number:string,suggestion:string,confidence:string>"
_STRICT = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false"}


def _list_of_items(text: Column) -> Column:
    """The JSON array in a text, NULL when the text is anything else.

    The text is read as the value of one object field, so that text after the array makes it
    invalid; a bare object is not taken for a list of one.
    """
    body = tx.strip(text)
    wrapped = F.concat(F.lit('{"v":'), body, F.lit("}"))
    parsed = F.from_json(wrapped, f"struct<v:array<{_ITEM}>>", _STRICT)["v"]
    return F.when(F.startswith(body, F.lit("[")) & F.endswith(body, F.lit("]")), parsed)


def fenced(text: Column) -> Column:
    """Body of the first fenced block; the text itself without a fence."""
    tagged = F.get(F.split(text, "```json", -1), F.lit(1))
    plain = F.get(F.split(text, "```", -1), F.lit(1))
    return (
        F.when(F.contains(text, F.lit("```json")), F.substring_index(tagged, "```", 1))
        .when(
            F.contains(text, F.lit("```")),
            F.when(F.startswith(plain, F.lit("json")), F.substring(plain, F.lit(5), F.length(plain)))
            .otherwise(plain),
        )
        .otherwise(text)
    )


def parse_responses(responses: DataFrame) -> DataFrame:
    """Findings in the ``response`` texts: a JSON array, or the array in a fenced block."""
    whole = tx.strip(F.col("response"))
    items = F.coalesce(_list_of_items(whole), _list_of_items(fenced(whole)))
    keep = [c for c in responses.columns if c != "response"]
    rows = responses.select(*keep, F.posexplode(items).alias("item_no", "i"))
    stage = [F.col("stage")] if "stage" in keep else []
    return with_defaults(
        rows.select(
            F.col("path").alias("file"), *stage,
            "i.severity", "i.type", "i.message", "i.suggestion", "i.confidence",
            F.expr("try_cast(i.line_number AS INT)").alias("line_number"),
            F.col("item_no").cast("bigint").alias("seq"),
        )
    )


def requests(corpus: DataFrame, stages: list[str | None], provider: str) -> DataFrame:
    """``path, chars, stage, key`` per file and stage.

    A content is hashed once, before its row is repeated, and does not travel further: planning
    moves keys and lengths only.
    """
    digested = corpus.select(
        "path",
        F.length("content").alias("chars"),
        keys.content_digest(F.col("content")).alias("digest"),
    )
    repeated = digested.withColumn(
        "stage", F.explode(F.array(*[F.lit(s).cast("string") for s in stages]))
    )
    key = keys.content_key(F.col("path"), F.col("digest"), F.col("stage"), provider)
    return repeated.select("path", "chars", "stage", key.alias("key"))


def plan_requests(requests: DataFrame, stored: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Requests with their stored result, if any, and what to do with them.

    A stored result is reused before the size guard is looked at. ``stored`` has one row per
    key; the join strategy follows its size.
    """
    found = requests.join(stored.select("key", "result"), "key", "left")
    action = (
        F.when(F.col("result").isNotNull(), "reuse")
        .when(F.col("chars") > max_chars, "too_large")
        .otherwise("compute")
    )
    return found.withColumn("action", action)


def pending(corpus: DataFrame, planned: DataFrame) -> DataFrame:
    """Contents and stages that have to be computed: one row per file, stages as an array."""
    todo = planned.filter("action = 'compute'").groupBy("path").agg(
        # At most one entry per stage.
        F.sort_array(F.collect_set("stage")).alias("stages")
    )
    return corpus.join(todo, "path")


def fresh_entries(entries: DataFrame, now: str, ttl_seconds: int = 3600) -> DataFrame:
    """Latest entry per key, if it has not expired (strictly older than the limit) at ``now``."""
    latest = entries.groupBy("key").agg(F.max(F.struct("ts", "data")).alias("e"))
    age = F.timestamp_diff("MICROSECOND", F.col("e.ts"), F.expr(f"TIMESTAMP_NTZ'{now}'"))
    return latest.filter(age <= ttl_seconds * 1000000).select("key", "e.ts", "e.data")


def lookup_fresh(requests: DataFrame, entries: DataFrame, now: str, ttl_seconds: int = 3600) -> DataFrame:
    hits = fresh_entries(entries, now, ttl_seconds)
    return requests.join(hits, "key", "left").withColumn("hit", F.col("ts").isNotNull())


#: Parts into which a time to live is cut; what a key holds in one part is ordered by one task.
TTL_PARTS = 16


def lookup_as_of(requests: DataFrame, entries: DataFrame, ttl_seconds: int = 3600, parts: int = TTL_PARTS) -> DataFrame:
    """Requests with the latest entry of their key up to their own ``ts``, if it has not expired by then.

    ``entries`` has ``key, ts, data``; of several at one instant the largest ``data`` counts, and an entry of
    the request's own instant is found. An entry is strictly expired when older than ``ttl_seconds``. A null
    key or time finds nothing. Adds ``data``, ``stored_ts`` and ``hit``.

    Time is cut into parts of a fraction of the time to live. Inside a part a window carries the last
    entry on; what is carried in is the last entry of the parts before it within reach, taken from one
    row per key and part. So a key with a large share of the rows is spread over the parts it is busy in.
    """
    width = max(1, ttl_seconds * 1_000_000 // parts)
    time = F.unix_micros(F.col("ts").cast("timestamp"))
    own = [F.col(c).alias(f"r_{c}") for c in requests.columns]
    kind = entries.schema["data"].dataType
    none = F.lit(None).cast(kind)
    asked = requests.select(
        "key", time.alias("t"), F.lit(1).alias("turn"), none.alias("data"), F.struct(*own).alias("request")
    )
    stored = entries.where("key is not null and ts is not null").select(
        "key", time.alias("t"), F.lit(0).alias("turn"), "data", F.lit(None).cast(asked.schema["request"].dataType)
    )
    rows = asked.union(stored).withColumn("part", F.floor(F.col("t") / F.lit(width)))
    entry = F.when(F.col("turn") == 0, F.struct("t", "data"))
    # One row per key and part: what it leaves to those after it.
    left = rows.where("key is not null and t is not null").groupBy("key", "part").agg(F.max(entry).alias("last"))
    before = Window.partitionBy("key").orderBy("part").rangeBetween(-(parts + 1), -1)
    carried = left.select("key", "part", F.max("last").over(before).alias("carried"))
    so_far = Window.partitionBy("key", "part").orderBy("t", "turn", "data").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("seen", F.last(entry, ignorenulls=True).over(so_far)).where("turn = 1")
    found = found.join(carried, ["key", "part"], "left").withColumn("e", F.coalesce("seen", "carried"))
    hit = F.coalesce(F.col("t") - F.col("e.t") <= ttl_seconds * 1_000_000, F.lit(False)) & F.col("key").isNotNull()
    out = found.withColumn("hit", hit)
    return out.select(
        *(F.col(f"request.r_{c}").alias(c) for c in requests.columns),
        F.when(F.col("hit"), F.col("e.data")).alias("data"),
        F.when(F.col("hit"), F.timestamp_micros("e.t")).alias("stored_ts"),
        "hit",
    )


def store_stats(entries: DataFrame, now: str, ttl_seconds: int = 3600) -> DataFrame:
    """Bytes stored and expired entries of a store with one row per entry."""
    age = F.timestamp_diff("MICROSECOND", F.col("ts"), F.expr(f"TIMESTAMP_NTZ'{now}'"))
    expired = age > ttl_seconds * 1000000
    return entries.agg(
        F.count("*").alias("entries"),
        F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).cast("bigint").alias("size_bytes"),
        F.count_if(expired).alias("expired"),
    )


def imported_report(reports: DataFrame) -> DataFrame:
    """Findings of an external scanner's JSON report, one report text per ``path``."""
    item = (
        "struct<issue_severity:string,issue_text:string,line_number:int,test_id:string,"
        "issue_cwe:struct<url:string,description:string>>"
    )
    parsed = F.from_json("report", f"struct<results:array<{item}>>")
    rows = reports.select(F.col("path").alias("file"), F.posexplode(parsed["results"]).alias("n", "f"))
    cwe = F.regexp_extract(F.coalesce("f.issue_cwe.url", F.lit("")), r"([0-9]+)(?:\.html)?/?$", 1)
    return as_findings(
        rows.select(
            "file",
            F.coalesce("f.line_number", F.lit(0)).alias("line_number"),
            sev.imported(F.coalesce("f.issue_severity", F.lit(""))).alias("severity"),
            F.lit("security").alias("type"),
            F.coalesce("f.issue_text", F.lit("Security issue")).alias("message"),
            F.coalesce("f.issue_cwe.description", F.lit("")).alias("suggestion"),
            F.lit("high").alias("confidence"),
            F.when(cwe != "", F.concat(F.lit("CWE-"), cwe)).alias("cwe_id"),
            F.coalesce("f.test_id", F.lit("")).alias("rule_id"),
            F.col("n").cast("bigint").alias("seq"),
        )
    )
