"""Registered queries: sources, sinks, filters and rule scans, each beside its SQL oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions import paths as pt
from siftline.functions import severity as sev
from siftline.functions import text as tx
from siftline.operators import catalog as cat
from siftline.operators import filters, learning, linescan, ranking, structure
from siftline.operators.ratelimit import micros
from siftline.plans import views as v
from siftline.plans.registry import (
    corpus_sql, files_sql, findings_sql, query, rank_sql, re_sql, strip_sql,
    text_sql, with_,
)
from siftline.session import checkpoint_dir
from siftline.sources import corpus as src
from siftline.sources import exports, tree
from siftline.sources.store import LearningStore

# Sources and sinks ---------------------------------------------------------------------


_SCANNABLE = (
    "regexp_matches(path, '\\.(py|js|jsx|ts|tsx|go|rs)$') AND NOT list_has_any(string_split(path, '/'), "
    "['.git','__pycache__','node_modules','.venv','venv','build','dist'])"
)


def _folder(spark, name: str) -> str:
    """A new folder for what a query writes and reads back."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s_files", files_sql(f"""
SELECT path, size, md5(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest,
  CAST(NULL AS VARCHAR) AS error FROM files WHERE {_SCANNABLE}"""))
def s_files(spark, sf):
    """Files of a tree that the query writes: excluded folders and other extensions stay out."""
    root = _folder(spark, "tree")
    tree.write_files(v.files(spark, sf), root)
    path = src.relative(F.col("path"), tree.qualified(spark, root))
    return src.read_files(spark, root).select(path.alias("path"), "size", F.md5("content").alias("digest"), "error")


@query("s_limit", files_sql(f"SELECT path, size FROM files WHERE {_SCANNABLE} ORDER BY path LIMIT 50"))
def s_limit(spark, sf):
    return src.first_files(src.scannable(v.files(spark, sf)), src.FILE_LIMIT).select("path", "size")


@query("s_size", corpus_sql("SELECT path, CAST(length(content) AS BIGINT) AS chars FROM corpus WHERE length(content) <= 3000"))
def s_size(spark, sf):
    texts = v.corpus(spark, sf).select("path", tx.normalise_newlines(F.col("content")).alias("content"))
    kept = src.size_labelled(texts, 3000).where(~F.col("too_large"))
    return kept.select("path", F.length("content").cast("bigint").alias("chars"))


@query("s_lines", corpus_sql("SELECT file, CAST(line_no AS INT) AS line_no, line FROM lines"))
def s_lines(spark, sf):
    return linescan.numbered_lines(v.corpus(spark, sf)).select("file", "line_no", "line")


@query(
    "s_ignore",
    corpus_sql(f"""
SELECT p AS pattern, count(*) AS n FROM (SELECT {strip_sql('line')} AS p FROM lines)
WHERE p <> '' AND p NOT LIKE '#%' GROUP BY p"""),
)
def s_ignore(spark, sf):
    """Patterns of an ignore file that holds the lines of the corpus."""
    path = _folder(spark, "ignore")
    linescan.numbered_lines(v.corpus(spark, sf)).select("line").write.text(path)
    return src.read_ignore_file(spark, path).groupBy("pattern").agg(F.count("*").alias("n"))


@query(
    "s_jsonout",
    findings_sql("""
SELECT CAST(to_json({'type': type, 'severity': severity, 'message': message, 'file': file,
  'line_number': line_number, 'suggestion': suggestion, 'stage': stage}) AS VARCHAR) AS "value" FROM findings"""),
)
def s_jsonout(spark, sf):
    """Records of a run that is written twice, read back."""
    path = _folder(spark, "json")
    for _ in range(2):
        exports.write_json(v.findings(spark, sf), path, "r1")
    return exports.json_records(exports.read_json(spark, path))


@query(
    "s_csvout",
    findings_sql("""
SELECT severity AS "Severity", type AS "Type", file AS "File", line_number AS "Line",
       message AS "Message", suggestion AS "Suggestion" FROM findings"""),
)
def s_csvout(spark, sf):
    """Rows of a run that is written twice, read back."""
    path = _folder(spark, "csv")
    for _ in range(2):
        exports.write_csv(v.findings(spark, sf), path, "r1")
    return exports.read_csv(spark, path).drop("run")


def _scans(spark, sf):
    """Scans of a user and day; the start is known when a sign-up was logged."""
    events = v.table(spark, sf, "events")
    return events.groupBy(
        F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("scan_id")
    ).agg(
        F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.count("*").alias("issues"),
    )


_SCANS = """
scans AS (SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS scan_id,
   min(CASE WHEN event_type = 'signup' THEN ts END) AS start_ts, max(ts) AS end_ts, count(*) AS issues
   FROM events GROUP BY 1),
scan_log AS (SELECT scan_id, (epoch_us(end_ts) - epoch_us(start_ts)) / 1e6 AS duration, issues,
   epoch_us(end_ts) AS ts_us FROM scans WHERE start_ts IS NOT NULL)"""


@query("s_scanlog", with_(_SCANS, "SELECT scan_id, round(duration, 6) AS duration, issues, ts_us FROM scan_log"))
def s_scanlog(spark, sf):
    """The log of two runs, odd and even users; the second run is written twice."""
    path, scans = _folder(spark, "log"), _scans(spark, sf)
    for odd in (0, 1, 1):
        mine = scans.filter(F.substring_index("scan_id", ":", 1).cast("bigint") % 2 == odd)
        exports.append_scan_log(mine, path, f"r{odd}")
    return spark.read.parquet(path).select(
        "scan_id", F.round("duration", 6).alias("duration"), "issues", micros("ts").alias("ts_us")
    )


_UPSERT_SQL = """
upserted AS (
  SELECT coalesce(p.pattern_key, n.pattern_key) AS pattern_key,
    CASE WHEN p.pattern_key IS NULL THEN n.language ELSE p.language END AS language,
    CASE WHEN n.pattern_key IS NULL THEN p."count" ELSE n."count" END AS "count",
    CASE WHEN p.pattern_key IS NULL THEN n.first_seen ELSE p.first_seen END AS first_seen,
    CASE WHEN n.pattern_key IS NULL THEN p.last_seen ELSE n.last_seen END AS last_seen,
    CASE WHEN n.pattern_key IS NULL THEN p.typical_severity ELSE n.typical_severity END AS typical_severity,
    CASE WHEN n.pattern_key IS NULL THEN p.example_messages ELSE n.example_messages END AS example_messages,
    p.suggestion AS suggestion, coalesce(p.custom_rule_generated, false) AS custom_rule_generated,
    CASE WHEN p.pattern_key IS NULL THEN 'new' WHEN n.pattern_key IS NULL THEN 'kept' ELSE 'updated' END AS outcome
  FROM patterns p FULL OUTER JOIN fresh n ON p.pattern_key = n.pattern_key)"""
_SHOW_PATTERN = (
    "pattern_key, language, \"count\", epoch_us(first_seen) AS first_us, epoch_us(last_seen) AS last_us, "
    "typical_severity, array_to_string(example_messages, '|') AS examples"
)


def _show(patterns: DataFrame, *extra: str) -> DataFrame:
    return patterns.select(
        "pattern_key", "language", "count", micros("first_seen").alias("first_us"),
        micros("last_seen").alias("last_us"), "typical_severity",
        F.array_join("example_messages", "|").alias("examples"), *extra,
    )


@query("s_store", with_(v.DUCK_LEARNING + "," + _UPSERT_SQL, f"SELECT {_SHOW_PATTERN} FROM upserted"))
def s_store(spark, sf):
    """Two rounds of record and consolidate through the stored tables."""
    store = LearningStore(spark, _folder(spark, "store"))
    obs = v.observations(spark, sf)
    middle = "TIMESTAMP_NTZ'2024-01-16 00:00:00'"
    store.record(obs.filter(f"ts < {middle}"))
    store.consolidate("2024-02-10 00:00:00")
    store.record(obs.filter(f"ts >= {middle}"))
    store.consolidate(v.NOW)
    return _show(store.patterns())


# Filters -------------------------------------------------------------------------------


def _raw(spark, sf):
    return v.findings(spark, sf).withColumn("severity", F.col("raw_severity"))


_LEVEL = (
    "CASE raw_severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END"
)


@query("f_sev", findings_sql(f"SELECT seq, raw_severity AS severity FROM findings WHERE {_LEVEL} >= 3"))
def f_sev(spark, sf):
    return _raw(spark, sf).transform(filters.min_severity("medium")).select("seq", "severity")


@query("f_sevcli", findings_sql(f"SELECT seq, raw_severity AS severity FROM findings WHERE {rank_sql('raw_severity')} >= 1"))
def f_sevcli(spark, sf):
    return _raw(spark, sf).transform(filters.min_severity_strict("low")).select("seq", "severity")


@query("f_type", findings_sql("SELECT seq, type FROM findings WHERE type IN ('security', 'bug', 'style') AND type <> 'bug'"))
def f_type(spark, sf):
    chosen = filters.by_type(["security", "bug", "style"], ["bug"])
    return v.findings(spark, sf).transform(chosen).select("seq", "type")


@query("f_path", findings_sql("SELECT seq, file FROM findings WHERE (contains(file, 'mod_1') OR contains(file, '.go')) AND NOT contains(file, '.md')"))
def f_path(spark, sf):
    return v.findings(spark, sf).transform(filters.by_path(["mod_1", ".go"], [".md"])).select("seq", "file")


@query("f_custom", findings_sql("SELECT seq, line_number FROM findings WHERE line_number > 2 AND suggestion LIKE 'Fix: c%'"))
def f_custom(spark, sf):
    rule = filters.custom(lambda d: (d.line_number > 2) & d.suggestion.startswith("Fix: c"))
    return v.findings(spark, sf).transform(rule).select("seq", "line_number")


@query(
    "f_chain",
    findings_sql("""
SELECT seq, severity, type, file FROM findings WHERE severity IN ('critical', 'high')
AND type <> 'style' AND contains(file, '.py') AND line_number >= 1"""),
)
def f_chain(spark, sf):
    rules = filters.chain(
        filters.min_severity("high"), filters.by_type(exclude=["style"]),
        filters.by_path(include=[".py"]), filters.custom(lambda d: d.line_number >= 1),
    )
    return v.findings(spark, sf).transform(rules).select("seq", "severity", "type", "file")


EXCLUDE = ["tests", "*.js", "node_modules/*.py", "src[0-4]/*/*.go", "app/?.rs"]


@query(
    "f_excl",
    files_sql(r"""
SELECT path, contains(path, 'tests') OR regexp_matches(path, '(^|/)[^/]*\.js$')
  OR regexp_matches(path, '(^|/)node_modules/[^/]*\.py$')
  OR regexp_matches(path, '(^|/)src[0-4]/[^/]*/[^/]*\.go$')
  OR regexp_matches(path, '(^|/)app/[^/]\.rs$') AS excluded FROM files"""),
)
def f_excl(spark, sf):
    return v.files(spark, sf).select("path", pt.should_exclude(F.col("path"), EXCLUDE).alias("excluded"))


@query(
    "f_qcode",
    corpus_sql(f"""
SELECT CASE WHEN {strip_sql('line')} = '' THEN 'Code is empty'
            WHEN length(line) > 200 THEN 'Code exceeds maximum size (1MB)' ELSE '' END AS errors,
       count(*) AS n FROM lines GROUP BY 1"""),
)
def f_qcode(spark, sf):
    lines = linescan.numbered_lines(v.corpus(spark, sf))
    errors = F.array_join(pt.content_errors(F.col("line"), 200), ";")
    return lines.groupBy(errors.alias("errors")).agg(F.count("*").alias("n"))


@query("f_qsev", findings_sql("SELECT raw_severity, lower(raw_severity) IN ('critical','high','medium','low','info') AS valid, count(*) AS n FROM findings GROUP BY ALL"))
def f_qsev(spark, sf):
    return v.findings(spark, sf).groupBy("raw_severity", sev.is_valid(F.col("raw_severity")).alias("valid")).agg(F.count("*").alias("n"))


@query("f_qsize", files_sql("SELECT path, size > 0 AND size < 2000 AS valid FROM files"))
def f_qsize(spark, sf):
    return v.files(spark, sf).select("path", pt.valid_size(F.col("size"), 2000).alias("valid"))


@query(
    "f_qext",
    files_sql(r"""
SELECT path, CASE WHEN e IN ('.py', '.js', '.ts', '.java', '.go') THEN '' ELSE 'Extension ' || e || ' not allowed' END AS errors
FROM (SELECT path, '.' || split_part(path, '.', -1) AS e FROM files)"""),
)
def f_qext(spark, sf):
    return v.files(spark, sf).select("path", F.array_join(pt.extension_errors(F.col("path")), ";").alias("errors"))


@query(
    "p_default",
    findings_sql("""
SELECT seq, CASE WHEN seq % 4 = 0 THEN 'medium' ELSE severity END AS severity,
  CASE WHEN seq % 5 = 0 THEN 'best_practice' ELSE type END AS type,
  CASE WHEN seq % 6 = 0 THEN 'Issue found' ELSE message END AS message,
  CASE WHEN seq % 7 = 0 THEN 0 ELSE line_number END AS line_number, 'high' AS confidence, suggestion
FROM findings"""),
)
def p_default(spark, sf):
    gap = lambda c, n: F.when(F.col("seq") % n != 0, F.col(c))
    items = v.findings(spark, sf).withColumns(
        {
            "severity": gap("severity", 4), "type": gap("type", 5), "message": gap("message", 6),
            "line_number": gap("line_number", 7), "confidence": F.lit(None).cast("string"),
        }
    )
    return filters.with_defaults(items).select(
        "seq", "severity", "type", "message", "line_number", "confidence", "suggestion"
    )


# Rule scans ----------------------------------------------------------------------------

FINDING = ["file", "line_number", "severity", "type", "message", "code_snippet"]


def _condition_sql(r: cat.Rule) -> str:
    if r.pattern:
        return f"regexp_matches(line, {re_sql(r.pattern)})"
    subject = "lower(line)" if r.fold_line else "line"
    any_of = " OR ".join(f"contains({subject}, {text_sql(l)})" for l in r.literals)
    joined = " OR ".join(f"contains(line, {text_sql(l)})" for l in r.with_any)
    return f"({any_of})" + (f" AND ({joined})" if joined else "")


def _rules_sql(rules, extra=()) -> str:
    parts = []
    for i, r in enumerate(rules):
        shown = strip_sql("line")
        shown = f"substring({shown}, 1, {r.snippet_chars})" if r.snippet_chars else shown
        lit = lambda x: "NULL" if x is None else (text_sql(x) if isinstance(x, str) else repr(x))
        more = {
            "suggestion": f"CAST({lit(r.suggestion)} AS VARCHAR)", "cwe_id": f"CAST({lit(r.cwe_id)} AS VARCHAR)",
            "details": f"CAST({lit(r.details)} AS VARCHAR)", "rule_id": lit(r.rule_id),
            "confidence_score": f"CAST({lit(r.confidence_score)} AS DOUBLE)",
            "seq": f"CAST({r.major} AS BIGINT) * 9007199254740992 + CAST(line_no AS BIGINT) * 4194304 + {i}",
        }
        cols = "".join(f", {more[e]} AS {e}" for e in extra)
        parts.append(
            f"SELECT file, CAST(line_no AS INT) AS line_number, {lit(r.severity)} AS severity, {lit(r.type)} AS type, "
            f"{lit(r.message)} AS message, {shown} AS code_snippet{cols} FROM lines WHERE {_condition_sql(r)}"
        )
    return "\nUNION ALL ".join(parts)


def _line_check(name: str, check: str) -> None:
    @query(name, corpus_sql(_rules_sql(cat.LINE_CHECKS[check])))
    def run(spark, sf):
        return linescan.check_lines(v.corpus(spark, sf), check).select(*FINDING)


for _name, _check in (
    ("r_sqli", "sql_injection"), ("r_secret", "hardcoded_secrets"), ("r_cmd", "command_injection"),
    ("r_import", "unsafe_imports"), ("r_crypto", "weak_crypto"),
    ("r_deser", "insecure_deserialization"), ("r_path", "path_traversal"),
):
    _line_check(_name, _check)


@query("r_pack", corpus_sql(_rules_sql(cat.LINE_PACK, ("rule_id", "seq"))))
def r_pack(spark, sf):
    return linescan.check_lines(v.corpus(spark, sf)).select(*FINDING, "rule_id", "seq")


# Findings of a scan, whose positions repeat from file to file, in the order of files.
_SCANNED = _rules_sql(cat.LINE_PACK, ("seq",))
_BY_FILE = "ORDER BY file, seq, line_number, type, message"


@query("w_topsev_scan", corpus_sql(f"""
SELECT severity AS bucket, file, seq, CAST(row_number() OVER (PARTITION BY severity {_BY_FILE}) AS INT) AS position,
  count(*) OVER (PARTITION BY severity) AS bucket_size FROM ({_SCANNED}) QUALIFY position <= 10"""))
def w_topsev_scan(spark, sf):
    found = linescan.check_lines(v.corpus(spark, sf))
    return ranking.top_per_severity(found, by_file=True).select("bucket", "file", "seq", "position", "bucket_size")


@query("w_sevno_scan", corpus_sql(f"""
SELECT file, seq, upper(left(severity, 1)) || row_number() OVER (PARTITION BY severity {_BY_FILE}) AS label
FROM ({_SCANNED}) WHERE severity IN ('critical', 'high', 'medium', 'low')"""))
def w_sevno_scan(spark, sf):
    found = linescan.check_lines(v.corpus(spark, sf))
    return ranking.numbered_in_severity(found, by_file=True).select("file", "seq", "label")


_BUG_EXTRA = ("suggestion", "cwe_id", "details", "confidence_score")
_LINE_BUGS = tuple(r for i, r in enumerate(cat.BUG_PACK) if i != cat.EMPTY_EXCEPT_INDEX)


@query("r_bug", corpus_sql(_rules_sql(_LINE_BUGS, _BUG_EXTRA)))
def r_bug(spark, sf):
    return linescan.bug_patterns(v.corpus(spark, sf)).select(*FINDING, *_BUG_EXTRA)


@query("r_sens", corpus_sql(_rules_sql(cat.SENSITIVE_PACK)))
def r_sens(spark, sf):
    return linescan.sensitive_assignments(v.corpus(spark, sf)).select(*FINDING)


def _content_sql(searches) -> str:
    """CTE ``hits``: start line of every match, from the text pieces between matches."""
    found = "\nUNION ALL ".join(
        f"SELECT {i} AS rule_no, path, language, content, regexp_extract_all(content, {p}) AS ms, "
        f"regexp_split_to_array(content, {p}) AS pieces FROM corpus WHERE regexp_matches(content, {p})"
        for i, p in enumerate(searches)
    )
    return f"""
found AS ({found}),
cuts AS (SELECT rule_no, path, language, content, unnest(pieces) AS piece, unnest(list_append(ms, '')) AS m,
           unnest(range(1, len(ms) + 2)) AS k FROM found),
hits AS (SELECT *, 1 + sum(len(piece) - len(replace(piece, chr(10), ''))) OVER w
           + sum(len(m) - len(replace(m, chr(10), ''))) OVER w - (len(m) - len(replace(m, chr(10), ''))) AS line_no,
           max(k) OVER (PARTITION BY rule_no, path) AS last_k
         FROM cuts WINDOW w AS (PARTITION BY rule_no, path ORDER BY k)),
matches AS (SELECT rule_no, path AS file, language, CAST(line_no AS INT) AS line_number,
              {strip_sql('string_split(content, chr(10))[CAST(line_no AS INT)]')} AS code_snippet
            FROM hits WHERE k < last_k)"""


_FLAT = [(c, p) for c in cat.CATEGORIES for p, _ in c.patterns]
_OWASP_RULES = ", ".join(
    f"({i}, {text_sql(c.severity)}, {text_sql(c.message)}, {text_sql(c.suggestion)}, {text_sql(c.cwe_id)}, {text_sql('OWASP-' + c.name)}, {text_sql(c.name)})"
    for i, (c, _) in enumerate(_FLAT)
)
_OWASP = (
    v.DUCK_CORPUS + "," + _content_sql([re_sql(p) for _, p in _FLAT])
    + f""",
rules(rule_no, severity, message, suggestion, cwe_id, rule_id, vuln_type) AS (VALUES {_OWASP_RULES})"""
)


@query(
    "r_owasp",
    with_(_OWASP, """
SELECT file, line_number, severity, 'security' AS type, message, suggestion, rule_id, cwe_id, code_snippet
FROM matches JOIN rules USING (rule_no)"""),
)
def r_owasp(spark, sf):
    return linescan.owasp(v.corpus(spark, sf)).select(
        "file", "line_number", "severity", "type", "message", "suggestion", "rule_id", "cwe_id", "code_snippet"
    )


@query(
    "r_supported",
    with_(_OWASP, """
SELECT r.vuln_type, CAST(r.ord AS INT) AS ord, count(m.file) AS findings
FROM (SELECT vuln_type, rule_id, dense_rank() OVER (ORDER BY min(rule_no)) - 1 AS ord, list(rule_no) AS nos
      FROM rules GROUP BY 1, 2) r LEFT JOIN matches m ON list_contains(r.nos, m.rule_no) GROUP BY ALL"""),
)
def r_supported(spark, sf):
    """The supported categories with the findings each has in the corpus."""
    counts = linescan.owasp(v.corpus(spark, sf)).groupBy("rule_id").agg(F.count("*").alias("n"))
    checks = linescan.supported_checks(spark).withColumn("rule_id", F.concat(F.lit("OWASP-"), "vuln_type"))
    return checks.join(counts, "rule_id", "left").select(
        "vuln_type", "ord", F.coalesce("n", F.lit(0)).alias("findings")
    )


@query(
    "r_todo",
    corpus_sql(f"""
SELECT file, CAST(line_no AS INT) AS line_number, 'low' AS severity, 'best_practice' AS type,
  'Found comment: ' || {strip_sql('c')} AS message, {strip_sql('line')} AS code_snippet
FROM (SELECT *, array_to_string(string_split(line, '#')[2:], '#') AS c FROM lines WHERE contains(line, '#'))
WHERE regexp_matches(c, '(?i)todo|fixme|hack')"""),
)
def r_todo(spark, sf):
    return structure.todo_comments(v.corpus(spark, sf)).select(*FINDING)


def _static_sql(source: str, severity: str, kind: str, message: str) -> str:
    return corpus_sql(f"""
SELECT file, CAST(line_no AS INT) AS line_number, {severity} AS severity, {kind} AS type, {message} AS message,
  {strip_sql('line')} AS code_snippet FROM ({source})""")


@query(
    "r_assign",
    _static_sql(
        "SELECT *, regexp_extract(line, " + re_sql(r"""^\s*([\p{L}_]\w*)\s*=\s*[rRuU]?(?:"[^"]+"|'[^']+')\s*(?:[;#].*)?$""", False)
        + ", 1) AS name FROM lines WHERE regexp_matches(lower(name), 'password|secret|token|key')",
        "'high'", "'security'", "'Potential hardcoded secret detected'",
    ),
)
def r_assign(spark, sf):
    return structure.secret_assignments(v.corpus(spark, sf)).select(*FINDING)


_CODE = "split_part(regexp_replace(line, '\"[^\"]*\"|''[^'']*''', '\"\"', 'g'), '#', 1)"


@query(
    "r_call",
    _static_sql(
        "SELECT * FROM (SELECT *, unnest(regexp_extract_all(" + _CODE + ", " + re_sql(r"def\s+\w+\s*\(|\b(eval|exec|compile|__import__)\s*\(", False)
        + ", 1)) AS name FROM lines) WHERE name <> ''",
        "'high'", "'security'", "'Use of ' || name || '() can be dangerous'",
    ),
)
def r_call(spark, sf):
    return structure.dangerous_calls(v.corpus(spark, sf)).select(*FINDING)


@query(
    "r_eval",
    _static_sql(
        # Attribute calls are blanked first; what is left is bare.
        "SELECT * FROM (SELECT *, unnest(regexp_extract_all(regexp_replace(" + _CODE + ", '\\.(eval|exec)', '.attr', 'g'), "
        + re_sql(r"def\s+\w+\s*\(|\b(eval|exec)\s*\(", False) + ", 1)) AS name FROM lines) WHERE name <> ''",
        "'critical'", "'Code Injection (' || name || ')'", "name || '() executes arbitrary code'",
    ),
)
def r_eval(spark, sf):
    return structure.code_execution(v.corpus(spark, sf)).select(*FINDING)


def _statement_sql(pattern: str, severity: str, kind: str, message: str) -> str:
    return _static_sql(
        f"SELECT *, unnest(regexp_extract_all({_CODE}, {re_sql(pattern, False)})) AS hit FROM lines",
        f"'{severity}'", f"'{kind}'", f"'{message}'",
    )


@query("r_assert", _statement_sql(r"(?:^|[:;])\s*assert\b", "low", "Assert Statement", "Assert can be disabled with -O flag"))
def r_assert(spark, sf):
    return structure.assert_statements(v.corpus(spark, sf)).select(*FINDING)


@query("r_global", _statement_sql(r"(?:^|[:;])\s*global\s+[\p{L}_]", "medium", "Global Variable", "Global variables reduce testability"))
def r_global(spark, sf):
    return structure.global_statements(v.corpus(spark, sf)).select(*FINDING)


@query(
    "r_emptyex",
    corpus_sql(f"""
SELECT file, CAST(line_no AS INT) AS line_number, 'medium' AS severity, k.type, k.message, {strip_sql('line')} AS code_snippet
FROM (SELECT *, lead(line) OVER (PARTITION BY file ORDER BY line_no) AS nxt FROM lines) h,
  (VALUES ('code_smell', 'Empty except block'), ('Empty Except Block', 'Exception is silently ignored')) k(type, message)
WHERE regexp_matches(line, {re_sql(r'^\s*except[^:]*:\s*$')}) AND regexp_matches(nxt, {re_sql(r'^\s*(pass|#)')})"""),
)
def r_emptyex(spark, sf):
    corpus = v.corpus(spark, sf)
    return structure.empty_except(corpus).unionByName(structure.empty_except_bug(corpus)).select(*FINDING)


_LOOP_SQL = v.DUCK_CORPUS + f""",
code AS (SELECT file, line_no, line, len(line) - len(ltrim(line, ' ' || chr(9))) AS indent, {_CODE} AS c FROM lines
         WHERE {strip_sql('line')} <> '' AND {strip_sql('line')} NOT LIKE '#%'),
heads AS (SELECT * FROM code WHERE regexp_matches(c, {re_sql(r"^\s*(?:async\s+)?(?:for|while)(?:\W.*)?:", False)})),
grows AS (SELECT * FROM code WHERE regexp_matches(c, {re_sql(r"(?:\]|\.\s*[\p{L}_]\w*)\s*\+=", False)}))"""


@query(
    "r_loopcat",
    with_(_LOOP_SQL, f"""
SELECT g.file, CAST(g.line_no AS INT) AS line_number, 'medium' AS severity, 'performance' AS type,
  'String concatenation in loop may be inefficient' AS message, {strip_sql('g.line')} AS code_snippet
FROM grows g JOIN heads h ON h.file = g.file AND (h.line_no = g.line_no OR (h.line_no < g.line_no AND h.indent < g.indent
  AND NOT EXISTS (SELECT 1 FROM code m WHERE m.file = g.file AND m.line_no > h.line_no AND m.line_no < g.line_no
                  AND m.indent <= h.indent)))"""),
)
def r_loopcat(spark, sf):
    return structure.loop_concatenations(v.corpus(spark, sf)).select(*FINDING)


def _detect_sql(table: str, key: str, text: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT {key}, '{k}' AS type, unnest(regexp_extract_all({text}, {re_sql(p)})) AS m FROM {table}"
        for k, p in cat.SECRET_KINDS
    )
    return f"SELECT {key}, type, CASE WHEN length(m) > 50 THEN left(m, 50) || '...' ELSE m END AS match FROM ({parts})"


@query("r_detect", _detect_sql("documents", "doc_id", "text"))
def r_detect(spark, sf):
    return linescan.detect_secrets(v.documents(spark, sf).select("doc_id", "text"))


@query("r_detect_pages", _detect_sql("pages", "page_id", "html"))
def r_detect_pages(spark, sf):
    return linescan.detect_secrets(v.table(spark, sf, "pages").select("page_id", "html"), "html")


@query("r_detect_code", corpus_sql(_detect_sql("corpus", "path", "content")))
def r_detect_code(spark, sf):
    corpus = v.corpus(spark, sf).select("path", tx.normalise_newlines(F.col("content")).alias("text"))
    return linescan.detect_secrets(corpus)


_RULES_SQL = """
rules AS (
  SELECT pattern_key, 'learned_' || pattern_key AS id, typical_severity AS severity, language,
    CASE WHEN contains(pattern_key, 'hardcoded_secret') OR contains(pattern_key, 'empty_except') THEN 'regex' ELSE 'ast' END AS type,
    CASE WHEN contains(pattern_key, 'hardcoded_secret') THEN 'Learned pattern: hardcoded secret (seen ' || "count" || 'x in ' || language || ')'
         WHEN contains(pattern_key, 'unused_import') THEN 'Learned pattern: unused import (seen ' || "count" || 'x in ' || language || ')'
         ELSE 'Learned pattern: empty except block (seen ' || "count" || 'x)' END AS message,
    CASE WHEN contains(pattern_key, 'hardcoded_secret') THEN 'Use environment variables or a secrets manager'
         WHEN contains(pattern_key, 'unused_import') THEN 'Remove unused imports to keep code clean'
         ELSE 'Handle the exception or at minimum log it' END AS suggestion,
    CASE WHEN contains(pattern_key, 'hardcoded_secret') THEN 0 WHEN contains(pattern_key, 'empty_except') THEN 1 END AS pattern_no
  FROM patterns WHERE "count" >= 3 AND NOT custom_rule_generated
    AND regexp_matches(pattern_key, 'hardcoded_secret|unused_import|empty_except'))"""


@query(
    "r_learned",
    with_(
        v.DUCK_CORPUS + "," + v.DUCK_KNOWN + "," + _RULES_SQL + ","
        + _content_sql([re_sql(cat.LEARNED_SECRET), re_sql(cat.LEARNED_EXCEPT)]),
        """
SELECT m.file, m.line_number, r.severity, split_part(r.pattern_key, ':', 1) AS type, r.message, r.id AS rule_id, m.code_snippet
FROM matches m JOIN rules r ON r.pattern_no = m.rule_no AND r.language = m.language""",
    ),
)
def r_learned(spark, sf):
    rules = learning.rules(v.known_patterns(spark, sf))
    return linescan.learned(v.corpus(spark, sf), rules).select(
        "file", "line_number", "severity", "type", "message", "rule_id", "code_snippet"
    )
