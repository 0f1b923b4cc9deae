"""Text rules: newline normalisation, stripping, line splitting, regular expressions.

Character classes are written out so that whitespace, digits and word characters mean the
Unicode sets, independent of the engine's default.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters removed by a whitespace strip.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
DIGIT_CLASS = r"\p{Nd}"
WORD_CLASS = r"[\p{L}\p{N}_]"
_CLASSES = {
    r"\s": SPACE_CLASS, r"\d": DIGIT_CLASS, r"\w": WORD_CLASS,
    r"\S": "[^" + SPACE_CLASS[1:], r"\D": r"\P{Nd}", r"\W": "[^" + WORD_CLASS[1:],
}
#: An escape as a whole, or a run of anything else.
_PART = re.compile(r"\\[pPxN]\{[^}]*\}|\\.|[^\\]+", re.S)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def unicode_classes(pattern: str) -> str:
    """Spell out ``\\s``, ``\\d``, ``\\w`` and their opposites as Unicode classes."""
    return _PART.sub(lambda m: _CLASSES.get(m.group(), m.group()), pattern)


def regex(pattern: str) -> str:
    """Java pattern that finds on folded text what ``pattern`` finds case-insensitively.

    ``.`` stops only at a line feed. Without a case flag, a leading literal is searched for
    with skips instead of character by character.
    """
    lowered = _PART.sub(lambda m: m.group() if m.group()[0] == "\\" else m.group().lower(), pattern)
    return "(?d)" + unicode_classes(lowered)


def regex_any_case(pattern: str) -> str:
    """Java pattern for the text itself, with Unicode case folding."""
    return "(?iud)" + unicode_classes(pattern)


def normalise_newlines(content: Column) -> Column:
    """Text-mode reading: CRLF and CR become LF."""
    return F.when(
        F.contains(content, F.lit("\r")), F.regexp_replace(content, "\r\n?", "\n")
    ).otherwise(content)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.length(strip(text)) == 0


# Letters beyond ASCII that equal an ASCII letter when case is ignored.
CASE_VARIANTS = ("\u0130", "\u0131", "\u017f", "\u212a")
CASE_VARIANTS_FOLDED = "iisk"


def fold(text: Column) -> Column:
    """Case-folded text of the same length, line by line and character by character."""
    plain = F.when(
        contains_any(text, CASE_VARIANTS),
        F.translate(text, "".join(CASE_VARIANTS), CASE_VARIANTS_FOLDED),
    ).otherwise(text)
    return F.lower(plain)


def split_lines(content: Column) -> Column:
    return F.split(content, "\n", -1)


def contains_any(text: Column, needles) -> Column:
    cond = F.lit(False)
    for needle in needles:
        cond = cond | F.contains(text, F.lit(needle))
    return cond


def sql_literal(value) -> str:
    """A Spark SQL literal; large rule sets are built as one SQL expression."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")
        return f"'{escaped}'"
    return f"CAST({value} AS DOUBLE)" if isinstance(value, float) else str(value)


def sql_contains_any(text: str, needles) -> str:
    return "(" + " OR ".join(f"contains({text}, {sql_literal(n)})" for n in needles) + ")"


def code_only(line: Column) -> Column:
    """A line without the contents of its string literals and without its comment."""
    bare = F.regexp_replace(line, "\"[^\"]*\"|'[^']*'", "\"\"")
    return F.substring_index(bare, "#", 1)


def loc(content: Column) -> Column:
    """Number of non-blank lines."""
    return F.size(F.filter(split_lines(content), lambda l: ~is_blank(l))).cast("bigint")


def count_splitlines(content: Column) -> Column:
    """Number of lines under universal line breaks; a trailing break opens no line."""
    breaks = F.regexp_count(content, F.lit(LINE_BREAK))
    open_tail = (F.length(content) > 0) & ~content.rlike(f"(?:{LINE_BREAK})\\z")
    return (breaks + F.when(open_tail, 1).otherwise(0)).cast("bigint")


def snippet(content: Column, line_number: Column, context: int = 2) -> Column:
    """Lines ``n-context .. n+context`` of the text, clipped to its ends."""
    lines = split_lines(content)
    start = F.greatest(F.lit(0), line_number - (context + 1))
    end = F.least(F.size(lines), line_number + context)
    return F.when(end > start, F.array_join(F.slice(lines, start + 1, end - start), "\n")).otherwise(
        F.lit("")
    )


def complexity(code: Column) -> dict[str, Column]:
    """Counts of functions, classes, conditional keywords and lines."""
    keyword = f"(?<!{WORD_CLASS})(?:if|elif|while|for)(?!{WORD_CLASS})"
    count = lambda p: F.regexp_count(code, F.lit(unicode_classes(p))).cast("bigint")
    return {
        "functions": count(r"def\s+\w+\s*\("),
        "classes": count(r"class\s+\w+"),
        "conditionals": count(keyword),
        "lines": F.size(split_lines(code)).cast("bigint"),
    }
