"""Lexical checks of Python sources.

They look at statements line by line, with string literals and comments blanked out, and run
in the same pass as the line patterns. What needs more than its line, the next line or the
depth of open loops, is taken from the row of the file, so no check moves data between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import text as tx
from siftline.operators import catalog as cat
from siftline.operators.catalog import Rule
from siftline.operators.linescan import Check, _escaped, hit, scan

# Words that make an assigned name sensitive, names of dangerous calls.
SENSITIVE_WORDS = ("password", "secret", "token", "key")
DANGEROUS_CALLS = ("eval", "exec", "compile", "__import__")
COMMENT_TAGS = ("TODO", "FIXME", "HACK")


def _sql(pattern: str) -> str:
    return _escaped(tx.sql_literal(tx.unicode_classes(pattern)))


# The line without the contents of its string literals and without its comment.
_LITERAL = _sql(r"""("[^"]*"|'[^']*')""")
_CODE = f"""substring_index(regexp_replace(line, {_LITERAL}, '""'), '#', 1)"""
_ASSIGNED = _sql(r"""(?d)^\s*([\p{L}_]\w*)\s*=\s*[rRuU]?(?:"[^"]+"|'[^']+')\s*(?:[;#].*)?$""")
_EXCEPT_HEAD = _sql(r"(?iud)^\s*except[^:]*:\s*$")
_EXCEPT_BODY = _sql(r"(?iud)^\s*(pass|#)")
_LOOP_HEAD = tx.unicode_classes(r"(?d)^\s*(?:async\s+)?(?:for|while)(?!\w).*:")
_GROW = tx.unicode_classes(r"(?:\]|\.\s*[\p{L}_]\w*)\s*\+=")


def _calls(names: tuple[str, ...], before: str) -> str:
    """Hits per call; definitions are consumed by the pattern and leave no name."""
    pattern = _sql(rf"def\s+\w+\s*\(|(?<!{before})({'|'.join(names)})\s*\(")
    found = f"filter(regexp_extract_all({_CODE}, {pattern}, 1), c -> c != '')"
    return f"transform({found}, (c, i) -> {hit('i', 'c')})"


def _statements(pattern: str) -> str:
    times = f"array_repeat(0, regexp_count({_CODE}, {_sql(pattern)}))"
    return f"transform({times}, (z, i) -> {hit('i')})"


ASSIGN = Check(
    Rule("static-assign", "security", "high", "Potential hardcoded secret detected",
         suggestion="Use environment variables or a secrets manager instead", major=0,
         needles=SENSITIVE_WORDS),
    f"CASE WHEN lower(regexp_extract(line, {_ASSIGNED}, 1)) RLIKE '{'|'.join(SENSITIVE_WORDS)}' "
    f"THEN array({hit()}) END",
)
_HANDLER = (
    f"CASE WHEN line RLIKE {_EXCEPT_HEAD} AND next_line RLIKE {_EXCEPT_BODY} THEN array({hit()}) END"
)
EMPTY_EXCEPT = Check(
    Rule("static-empty-except", "code_smell", "medium", "Empty except block",
         suggestion="Handle the exception or log it", major=1, needles=("except",)),
    _HANDLER, uses_next_line=True,
)
EMPTY_EXCEPT_BUG = Check(cat.BUG_PACK[cat.EMPTY_EXCEPT_INDEX], _HANDLER, uses_next_line=True)
CALLS = Check(
    Rule("static-call", "security", "high", "Use of {}() can be dangerous",
         suggestion="Avoid {}() if possible — use safer alternatives", major=2,
         needles=DANGEROUS_CALLS),
    _calls(DANGEROUS_CALLS, r"\w"),
)
_COMMENT = "substring(line, instr(line, '#') + 1)"
TODO = Check(
    Rule("static-todo", "best_practice", "low", "Found comment: {}",
         suggestion="Address the TODO/FIXME comment", major=4, needles=("#",)),
    f"CASE WHEN upper({_COMMENT}) RLIKE '{'|'.join(COMMENT_TAGS)}' THEN "
    f"array({hit('0', f'btrim({_COMMENT}, {tx.sql_literal(tx.WHITESPACE)})')}) END",
)


#: Lines of a run; a file's depths are gathered as one array for each run.
_FOLD_LINES = 256


def loop_depths(content: Column) -> Column:
    """``array<int>``: for every line that adds onto a subscript or attribute, how many loops it is in.

    The lines of a file are folded once with the indents of the loops that are still open. A run of
    lines is folded by itself and begins with what the run before left open. Only the list of runs
    is gathered over the file, so that no array of the file's length is copied along the way.
    """
    candidate = F.contains(content, F.lit("+=")) & (
        F.contains(content, F.lit("for")) | F.contains(content, F.lit("while"))
    )
    plain = tx.split_lines(tx.normalise_newlines(content))
    lines = F.transform(
        plain,
        lambda l: F.struct(
            l.alias("line"),
            (F.length(l) - F.length(F.ltrim(l, F.lit(" \t")))).alias("indent"),
            (~(tx.is_blank(l) | F.startswith(tx.strip(l), F.lit("#")))).alias("is_code"),
        ),
    )
    none = F.array().cast("array<int>")

    def step(acc, s):
        code = tx.code_only(s["line"])
        still_open = F.filter(acc["open"], lambda d: d < s["indent"])
        opened = F.when(
            code.rlike(_LOOP_HEAD), F.concat(still_open, F.array(s["indent"]))
        ).otherwise(still_open)
        grows = F.contains(s["line"], F.lit("+=")) & code.rlike(_GROW)
        depth = F.when(s["is_code"] & grows, F.size(opened)).otherwise(0)
        return F.struct(
            F.when(s["is_code"], opened).otherwise(acc["open"]).alias("open"),
            F.concat(acc["depths"], F.array(depth)).alias("depths"),
        )

    def run(acc, part):
        begin = F.struct(F.element_at(acc, -1)["open"].alias("open"), none.alias("depths"))
        return F.concat(acc, F.array(F.aggregate(part, begin, step)))

    # A lambda's variable stands for the lines, which are made once and not for every run.
    firsts = lambda ls: F.sequence(F.lit(1), F.greatest(F.size(ls), F.lit(1)), F.lit(_FOLD_LINES))
    parts = F.transform(
        F.array(lines), lambda ls: F.transform(firsts(ls), lambda i: F.slice(ls, i, F.lit(_FOLD_LINES)))
    )[0]
    start = F.array(F.struct(none.alias("open"), none.alias("depths")))
    return F.when(candidate, F.flatten(F.transform(F.aggregate(parts, start, run), lambda r: r["depths"])))


LOOPS = Check(
    Rule("static-loop-concat", "performance", "medium",
         "String concatenation in loop may be inefficient",
         suggestion="Use list append and join() instead", major=3, needles=("+=",)),
    f"CASE WHEN depth > 0 THEN transform(sequence(1, depth), d -> {hit('d')}) END",
    depths=loop_depths,
)


def _execution(name: str, suggestion: str, details: str) -> Check:
    return Check(
        Rule("bug-eval", f"Code Injection ({name})", "critical",
             f"{name}() executes arbitrary code", suggestion=suggestion, details=details,
             confidence=None, confidence_score=0.95, stage=cat.BUG_STAGE, major=11,
             needles=(name,)),
        _calls((name,), r"[.\w]"),
    )


EXECUTION = (
    _execution("eval", "Use ast.literal_eval() or safer alternatives",
               "eval() allows arbitrary code execution - major security risk"),
    _execution("exec", "Avoid exec(), use safer alternatives",
               "exec() allows arbitrary code execution"),
)
ASSERT = Check(
    Rule("bug-assert", "Assert Statement", "low", "Assert can be disabled with -O flag",
         suggestion="Use proper error handling (if/raise)", confidence=None,
         details="Not for production validation", confidence_score=0.7, stage=cat.BUG_STAGE,
         major=12, needles=("assert",)),
    _statements(r"(?:^|[:;])\s*assert(?!\w)"),
)
GLOBAL = Check(
    Rule("bug-global", "Global Variable", "medium", "Global variables reduce testability",
         suggestion="Use function parameters and return values", confidence=None,
         confidence_score=0.6, stage=cat.BUG_STAGE, major=13, needles=("global",)),
    _statements(r"(?:^|[:;])\s*global\s+[\p{L}_]"),
)

STATIC = (ASSIGN, EMPTY_EXCEPT, CALLS, LOOPS, TODO)
BUG_STATEMENTS = (*EXECUTION, ASSERT, GLOBAL)


def dangerous_calls(corpus: DataFrame) -> DataFrame:
    return scan(corpus, (CALLS,))


def secret_assignments(corpus: DataFrame) -> DataFrame:
    return scan(corpus, (ASSIGN,))


def todo_comments(corpus: DataFrame) -> DataFrame:
    return scan(corpus, (TODO,))


def code_execution(corpus: DataFrame) -> DataFrame:
    return scan(corpus, EXECUTION)


def assert_statements(corpus: DataFrame) -> DataFrame:
    return scan(corpus, (ASSERT,))


def global_statements(corpus: DataFrame) -> DataFrame:
    return scan(corpus, (GLOBAL,))


def empty_except(corpus: DataFrame) -> DataFrame:
    """Except headers whose next line is ``pass`` or a comment."""
    return scan(corpus, (EMPTY_EXCEPT,))


def empty_except_bug(corpus: DataFrame) -> DataFrame:
    return scan(corpus, (EMPTY_EXCEPT_BUG,))


def loop_concatenations(corpus: DataFrame) -> DataFrame:
    """``+=`` onto a subscript or attribute inside loops, one finding per enclosing loop."""
    return scan(corpus, (LOOPS,))
