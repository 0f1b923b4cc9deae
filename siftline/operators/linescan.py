"""Rules over numbered lines and over whole contents."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.operators import catalog as cat
from siftline.operators.catalog import Rule
from siftline.schemas import as_findings

# A carriage return cannot occur in normalised content, so it can mark where a match starts.
MARK_SQL = "\\r"


@dataclass(frozen=True)
class Check:
    """One check of a line.

    ``hits`` is SQL for an array of ``struct<rule_no, k, name>`` or NULL, over the columns
    ``line``, ``_folded``, ``line_no`` and, where asked for, ``next_line`` and ``depth`` (from
    the array by line that ``depths`` makes of a content); ``{n}`` stands for the number of the
    check. ``{}`` in texts of ``rule`` is replaced by the name of a hit.
    """

    rule: Rule
    hits: str
    languages: tuple[str, ...] = ()
    uses_next_line: bool = False
    depths: Callable[[Column], Column] | None = None

    def only_for(self, *languages: str) -> "Check":
        return replace(self, languages=languages)


def hit(k="0", name: str = "CAST(NULL AS STRING)") -> str:
    return f"struct({{n}} AS rule_no, CAST({k} AS INT) AS k, {name} AS name)"


def line_condition(rule: Rule) -> str:
    """SQL condition of a rule over ``line`` and its case-folded form ``_folded``."""
    if rule.pattern is not None:
        return f"_folded RLIKE {tx.sql_literal(tx.regex(rule.pattern))}"
    cond = tx.sql_contains_any("lower(line)" if rule.fold_line else "line", rule.literals)
    return f"{cond} AND {tx.sql_contains_any('line', rule.with_any)}" if rule.with_any else cond


def line_checks(rules: tuple[Rule, ...]) -> tuple[Check, ...]:
    """Checks that hit a line at most once, in the order of the rules."""
    return tuple(
        Check(r, f"CASE WHEN {_escaped(line_condition(r))} THEN array({hit(i)}) END")
        for i, r in enumerate(rules)
    )


def _escaped(sql: str) -> str:
    return sql.replace("{", "{{").replace("}", "}}")


def numbered_lines(corpus: DataFrame, *, next_line: bool = False, depth: Column | None = None) -> DataFrame:
    """``file, line_no, line``: one row per line, counted from 1."""
    carried = [c for c in corpus.columns if c not in ("path", "content")]
    named = corpus.withColumnRenamed("path", "file")
    lines = tx.split_lines(tx.normalise_newlines(F.col("content")))
    if not next_line and depth is None:
        exploded = named.select("file", *carried, F.posexplode(lines).alias("line_no", "line"))
    else:
        # What a line needs of its file is put beside it before the lines become rows.
        beside, source = "struct(l AS line, get(_lines, i + 1) AS next_line)", "_lines"
        arrays, extra = [lines.alias("_lines")], ["_p.next_line"]
        if depth is not None:
            arrays.append(F.coalesce(depth, F.array().cast("array<int>")).alias("_depths"))
            beside = "struct(l._lines AS line, get(_lines, i + 1) AS next_line, l._depths AS depth)"
            source, extra = "arrays_zip(_lines, _depths)", [*extra, "_p.depth"]
        pairs = F.expr(f"transform({source}, (l, i) -> {beside})")
        exploded = (
            named.select("file", *carried, *arrays)
            .select("file", *carried, F.posexplode(pairs).alias("line_no", "_p"))
            .select("file", *carried, "line_no", "_p.line", *extra)
        )
    return exploded.withColumn("line_no", F.col("line_no") + 1)


def guarded(entries: list[tuple[str, str]]) -> str:
    """SQL array of the non-NULL entries; entries with the same guard share one test of it."""
    groups: dict[str, list[str]] = {}
    for guard, expression in entries:
        groups.setdefault(guard, []).append(expression)
    arrays = [f"CASE WHEN {g} THEN array({', '.join(e)}) END" for g, e in groups.items()]
    return f"array_compact(flatten(array_compact(array({', '.join(arrays)}))))"


_NO_HITS = "CAST(array() AS array<struct<rule_no: int, k: int, name: string>>)"


def concatenated(entries: list[tuple[str, str]]) -> str:
    """SQL array of the hits of all entries; entries with the same guard share one test of it.

    ``concat`` takes part in code generation, and so do the conditions below it.
    """
    groups: dict[str, list[str]] = {}
    for guard, expression in entries:
        groups.setdefault(guard, []).append(f"coalesce({expression}, {_NO_HITS})")
    parts = [f"CASE WHEN {g} THEN concat({', '.join(e)}) ELSE {_NO_HITS} END" for g, e in groups.items()]
    return f"concat({', '.join(parts)})"


def needle_guard(needles: tuple[str, ...]) -> str:
    return tx.sql_contains_any("_folded", needles) if needles else "true"


_RULE_FIELDS = {
    "severity": "string", "type": "string", "message": "string", "suggestion": "string",
    "confidence": "string", "confidence_score": "double", "stage": "string",
    "rule_id": "string", "cwe_id": "string", "details": "string", "snippet_chars": "int",
    "major": "bigint",
}


def rule_table(rows: list[dict]) -> Column:
    """A constant array of structs, indexed by rule number."""
    structs = [
        "named_struct("
        + ", ".join(
            f"'{name}', CAST({tx.sql_literal(row.get(name))} AS {kind})"
            for name, kind in _RULE_FIELDS.items()
        )
        + ")"
        for row in rows
    ]
    return F.expr(f"array({', '.join(structs)})")


def _seq(major: Column, line_no: str, minor: str) -> Column:
    return (
        major * F.lit(1 << 53) + F.col(line_no).cast("bigint") * F.lit(1 << 22) + F.col(minor)
    )


def scan_lines(lines: DataFrame, checks: tuple[Check, ...]) -> DataFrame:
    """One finding per hit. Any number of checks is one pass: no shuffle, no Python."""
    entries = []
    for n, c in enumerate(checks):
        guard = needle_guard(c.rule.needles)
        if c.languages:
            names = ", ".join(tx.sql_literal(name) for name in c.languages)
            guard = f"language IN ({names}) AND {guard}"
        entries.append((guard, c.hits.format(n=n)))
    folded = lines.withColumn("_folded", tx.fold(F.col("line")))
    hits = folded.select(
        "file", "line_no", "line", F.expr(f"inline({concatenated(entries)})")
    ).withColumn("r", F.get(rule_table([c.rule.__dict__ for c in checks]), F.col("rule_no")))
    stripped, cut, name = tx.strip(F.col("line")), F.col("r.snippet_chars"), F.col("name")
    named = lambda field: F.when(name.isNull(), F.col(f"r.{field}")).otherwise(
        F.replace(F.col(f"r.{field}"), F.lit("{}"), name)
    )
    return as_findings(
        hits.select(
            "file",
            F.col("line_no").alias("line_number"),
            "r.severity",
            named("type").alias("type"),
            named("message").alias("message"),
            named("suggestion").alias("suggestion"),
            "r.confidence", "r.confidence_score", "r.stage", "r.rule_id", "r.cwe_id", "r.details",
            F.when(cut.isNull(), stripped).otherwise(F.substring(stripped, F.lit(1), cut)).alias(
                "code_snippet"
            ),
            _seq(F.col("r.major"), "line_no", "k").alias("seq"),
        )
    )


def scan(corpus: DataFrame, checks: tuple[Check, ...]) -> DataFrame:
    """All checks over the lines of a corpus, in one pass."""
    columns = ["path", "content"] + (["language"] if any(c.languages for c in checks) else [])
    lines = numbered_lines(
        corpus.select(*columns),
        next_line=any(c.uses_next_line for c in checks),
        depth=next((c.depths(F.col("content")) for c in checks if c.depths), None),
    )
    return scan_lines(lines, checks)


LINE_CHECKS = {
    name: line_checks(rules) for name, rules in cat.LINE_CHECKS.items()
}
LINE_PACK = line_checks(cat.LINE_PACK)
SENSITIVE = line_checks(cat.SENSITIVE_PACK)
BUG_PATTERNS = tuple(c for i, c in enumerate(line_checks(cat.BUG_PACK)) if i != cat.EMPTY_EXCEPT_INDEX)


def check_lines(corpus: DataFrame, *names: str) -> DataFrame:
    """The named line checks; all of them, concatenated and not deduplicated, by default."""
    chosen = tuple(c for n in names for c in LINE_CHECKS[n]) if names else LINE_PACK
    return scan(corpus, chosen)


def sensitive_assignments(corpus: DataFrame) -> DataFrame:
    return scan(corpus, SENSITIVE)


def bug_patterns(corpus: DataFrame) -> DataFrame:
    """The line patterns of the bug pack; the two-line one is ``empty_except_bug``."""
    return scan(corpus, BUG_PATTERNS)


def _search(number: int, pattern: str) -> str:
    """SQL: ``array<struct<rule_no, line_no, n, line>>``, the lines on which matches start.

    Every match start is marked once, the text is cut at line feeds and the marks of each
    line are counted, so the cost is linear in the text whatever the number of matches.
    """
    p = tx.sql_literal(pattern)
    marked = f"split(regexp_replace(_folded, {p}, '{MARK_SQL}$0'), '\\n', -1)"
    # Lines without a mark become NULL and are dropped before anything else is built.
    return f"""CASE WHEN _folded RLIKE {p} THEN array_compact(transform({marked}, (l, i) ->
        CASE WHEN contains(l, '{MARK_SQL}') THEN
          struct({number} AS rule_no, i + 1 AS line_no,
                 length(l) - length(replace(l, '{MARK_SQL}', '')) AS n, get(_lines, i) AS line)
        END)) END"""


def scan_contents(corpus: DataFrame, searches: list[tuple[str, tuple[str, ...]]]) -> DataFrame:
    """``file, rule_no, line_no, match_no, line`` for every match of every search.

    A search is a (pattern, needles) pair run over the whole content, so that a match may
    cross lines. One pass over the corpus, one row per match, no shuffle.
    """
    carried = [c for c in corpus.columns if c not in ("path", "content")]
    content = F.col("content")
    base = corpus.select(
        F.col("path").alias("file"), *carried, tx.normalise_newlines(content).alias("content")
    ).select("file", *carried, tx.fold(content).alias("_folded"), tx.split_lines(content).alias("_lines"))
    found = guarded([(needle_guard(n), _search(i, p)) for i, (p, n) in enumerate(searches)])
    per_line = base.select("file", *carried, F.expr(f"explode(flatten({found}))").alias("m"))
    return per_line.select(
        "file", *carried, "m.rule_no", "m.line_no", "m.line",
        F.explode(F.sequence(F.lit(1), F.col("m.n"))).alias("match_no"),
    )


def owasp(corpus: DataFrame) -> DataFrame:
    """All category patterns over whole contents, every non-overlapping match a finding."""
    flat = [(c, p, n) for c in cat.CATEGORIES for p, n in c.patterns]
    hits = scan_contents(corpus, [(tx.regex(p), n) for _, p, n in flat])
    table = rule_table(
        [
            {
                "severity": c.severity, "message": c.message, "suggestion": c.suggestion,
                "cwe_id": c.cwe_id, "rule_id": f"OWASP-{c.name}", "major": i,
            }
            for i, (c, _, _) in enumerate(flat)
        ]
    )
    return as_findings(
        hits.withColumn("r", F.get(table, F.col("rule_no"))).select(
            "file",
            F.col("line_no").alias("line_number"),
            "r.severity",
            F.lit("security").alias("type"),
            "r.message", "r.suggestion",
            F.lit("high").alias("confidence"),
            "r.rule_id", "r.cwe_id",
            tx.strip(F.col("line")).alias("code_snippet"),
            _seq(F.col("r.major"), "line_no", "match_no").alias("seq"),
        )
    )


def supported_checks(spark) -> DataFrame:
    rows = [(i, c.name) for i, c in enumerate(cat.CATEGORIES)]
    return spark.createDataFrame(rows, "ord int, vuln_type string")


def detect_secrets(texts: DataFrame, text: str = "text") -> DataFrame:
    """Secret kinds over whole texts; long matches are cut for display."""
    def matches(kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all(F.col(text), F.lit(tx.regex_any_case(pattern)), 0)
        rows = F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("m")))
        return F.when(F.col("_folded").rlike(tx.regex(pattern)), rows)

    kinds = F.array_compact(F.array(*[matches(k, p) for k, p in cat.SECRET_KINDS]))
    keep = [c for c in texts.columns if c != text]
    shown = F.col("s.m")
    folded = texts.withColumn("_folded", tx.fold(F.col(text)))
    return folded.select(*keep, F.explode(F.flatten(kinds)).alias("s")).select(
        *keep,
        F.col("s.kind").alias("type"),
        F.when(F.length(shown) > 50, F.concat(F.substring(shown, 1, 50), F.lit("...")))
        .otherwise(shown)
        .alias("match"),
    )


def learned(corpus: DataFrame, rules: DataFrame, patterns=(cat.LEARNED_SECRET, cat.LEARNED_EXCEPT)) -> DataFrame:
    """Apply learned expression rules to the files of their languages.

    Rules are generated from a fixed set of templates, so each template is searched once as a
    literal. The rules of each template and language are one entry of a map, which is looked up per hit.
    """
    needles = {
        cat.LEARNED_SECRET: ("password", "secret", "api_key", "token"),
        cat.LEARNED_EXCEPT: ("except",),
    }
    hits = scan_contents(
        corpus.select("path", "content", "language"),
        [(tx.regex(p), needles.get(p, ())) for p in patterns],
    ).withColumn("pattern", F.get(F.array(*[F.lit(p) for p in patterns]), F.col("rule_no")))
    rule = F.struct(F.col("id").alias("rule_id"), "severity", "message", "suggestion")
    per_language = (
        rules.filter(F.col("pattern").isNotNull())
        .select("pattern", F.explode("languages").alias("language"), rule.alias("rule"))
        .groupBy("pattern", "language").agg(F.sort_array(F.collect_list("rule")).alias("rules"))
    )
    # One entry for each template and language: a constant of the plan, so that hits are not shuffled.
    entry = F.struct(F.struct("pattern", "language").alias("key"), F.col("rules").alias("value"))
    table = per_language.agg(F.map_from_entries(F.collect_list(entry))).scalar()
    found = F.try_element_at(table, F.struct("pattern", "language"))
    return as_findings(
        hits.withColumn("rule", F.explode(found)).select("*", "rule.*").select(
            "file", F.col("line_no").alias("line_number"), "severity",
            F.regexp_extract("rule_id", "^learned_([^:]*):", 1).alias("type"),
            "message", "suggestion", "rule_id",
            F.lit("learned").alias("stage"), tx.strip(F.col("line")).alias("code_snippet"),
            _seq(F.col("rule_no").cast("bigint"), "line_no", "match_no").alias("seq"),
        )
    )
