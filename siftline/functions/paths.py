"""Paths, languages and sizes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scanned extensions by language, excluded directory names.
LANGUAGE_BY_EXTENSION = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".go": "go",
    ".rs": "rust",
}
EXCLUDED_DIRS = (".git", "__pycache__", "node_modules", ".venv", "venv", "build", "dist")

# Display names by extension.
DISPLAY_LANGUAGE = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".jsx": "React",
    ".tsx": "React", ".java": "Java", ".go": "Go", ".rs": "Rust", ".rb": "Ruby",
    ".php": "PHP", ".cpp": "C++", ".c": "C", ".cs": "C#", ".swift": "Swift",
    ".kt": "Kotlin", ".scala": "Scala", ".html": "HTML", ".css": "CSS",
    ".scss": "SCSS", ".json": "JSON", ".yaml": "YAML", ".yml": "YAML",
    ".md": "Markdown", ".sql": "SQL", ".sh": "Shell", ".bash": "Bash",
}

# Prompt language hints by extension.
LANGUAGE_HINT = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript",
    ".tsx": "typescript", ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby",
    ".c": "c", ".cpp": "cpp", ".cs": "csharp", ".php": "php", ".sh": "bash",
}

# Extensions accepted by the path check.
ALLOWED_EXTENSIONS = (".py", ".js", ".ts", ".java", ".go")
MAX_FILE_SIZE = 10485760


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def suffix(path: Column) -> Column:
    """Last extension with its dot; empty for dot files, a trailing dot or none."""
    return F.regexp_extract(basename(path), r"(?s)^.+(\.[^.]+)$", 1)


def lookup(table: dict[str, str], key: Column) -> Column:
    literal = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(literal, key)


def language(path: Column, override: str = "auto") -> Column:
    if override != "auto":
        return F.lit(override)
    return F.coalesce(lookup(LANGUAGE_BY_EXTENSION, F.lower(suffix(path))), F.lit("unknown"))


def display_language(path: Column) -> Column:
    return lookup(DISPLAY_LANGUAGE, F.lower(suffix(path)))


def language_hint(path: Column) -> Column:
    return F.coalesce(lookup(LANGUAGE_HINT, F.lower(suffix(path))), F.lit(""))


def is_scannable(path: Column) -> Column:
    """A supported extension and no excluded directory component."""
    supported = "(?:" + "|".join(re.escape(e) for e in LANGUAGE_BY_EXTENSION) + ")$"
    parts = F.split(path, "/")
    return path.rlike(supported) & ~F.arrays_overlap(
        parts, F.array(*[F.lit(d) for d in EXCLUDED_DIRS])
    )


def normalise_path(path: Column, root: str) -> Column:
    return F.replace(F.replace(path, F.lit(root), F.lit(".")), F.lit("\\"), F.lit("/"))


def human_size(size: Column) -> Column:
    value = size.cast("double")
    out = None
    for unit, power in (("B", 0), ("KB", 1), ("MB", 2), ("GB", 3)):
        scaled = value / float(1024**power)
        # Ties go to the even digit, so round before formatting.
        text = F.format_string("%.1f " + unit, F.bround(scaled, 1))
        out = F.when(scaled < 1024.0, text) if out is None else out.when(scaled < 1024.0, text)
    return out.otherwise(F.format_string("%.1f TB", F.bround(value / float(1024**4), 1)))


def glob_regex(pattern: str) -> str:
    """A path glob, matched component-wise from the right, as an anchored expression."""
    parts = [p for p in pattern.split("/") if p not in ("", ".")]
    translated = []
    for part in parts:
        out, i = "", 0
        while i < len(part):
            c = part[i]
            inner = i + 3 if part[i : i + 2] == "[!" else i + 2
            close = part.find("]", inner) if c == "[" else -1
            if c == "*":
                out += "[^/]*"
            elif c == "?":
                out += "[^/]"
            elif close > 0:
                body, negated = part[i + 1 : close], part[i + 1] == "!"
                # Only ranges keep their meaning inside the brackets.
                members = re.sub(r"([\\\[\]&^])", r"\\\1", body[1:] if negated else body)
                out += "[" + ("^" if negated else "") + members + "]"
                i = close
            else:
                out += re.escape(c)
            i += 1
        translated.append(out)
    head = "^/" if pattern.startswith("/") else "(?:^|/)"
    return head + "/".join(translated) + "$"


def should_exclude(path: Column, patterns: list[str]) -> Column:
    """Excluded when a pattern is a substring of the path or globs its tail."""
    cond = F.lit(False)
    for p in patterns:
        cond = cond | F.contains(path, F.lit(p))
        if any(part not in ("", ".") for part in p.split("/")):
            cond = cond | path.rlike(glob_regex(p))
    return cond


def extension_errors(path: Column, allowed=ALLOWED_EXTENSIONS) -> Column:
    ext = suffix(path)
    bad = F.concat(F.lit("Extension "), ext, F.lit(" not allowed"))
    return F.when(ext.isin(*allowed), F.array().cast("array<string>")).otherwise(F.array(bad))


def content_errors(code: Column, max_chars: int = 1000000) -> Column:
    from siftline.functions.text import is_blank

    return (
        F.when(code.isNull() | is_blank(code), F.array(F.lit("Code is empty")))
        .when(F.length(code) > max_chars, F.array(F.lit("Code exceeds maximum size (1MB)")))
        .otherwise(F.array().cast("array<string>"))
    )


def valid_size(size: Column, max_size: int = MAX_FILE_SIZE) -> Column:
    return (size > 0) & (size < max_size)
