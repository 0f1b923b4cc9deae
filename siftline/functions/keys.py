"""Content and pattern keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_digest(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def content_key(path: Column, digest: Column, stage: Column, provider: str) -> Column:
    """``path:digest:stage:provider``; a missing or empty stage is ``general``."""
    stage_key = F.coalesce(F.nullif(stage, F.lit("")), F.lit("general"))
    return F.concat_ws(":", path, digest, stage_key, F.lit(provider))


def pattern_key(issue_type: Column, message: Column) -> Column:
    """``type:name`` for the recognised kinds of message, ``type:hash`` for the rest."""
    low = F.lower(message)
    has = lambda word: F.contains(low, F.lit(word))
    # Recognised words and names; the first rule that applies wins.
    name = (
        F.when(has("hardcoded") | has("secret") | has("password"), "hardcoded_secret")
        .when(has("unused import"), "unused_import")
        .when(has("eval") | has("exec"), "dangerous_exec")
        .when(has("empty except"), "empty_except")
        .when(has("sql") & has("inject"), "sql_injection")
        .when(has("string concatenation") & has("loop"), "string_concat_in_loop")
        .when(has("todo") | has("fixme"), "todo_comment")
        .otherwise(F.substring(F.md5(message), 1, 8))
    )
    return F.concat(F.coalesce(F.nullif(issue_type, F.lit("")), F.lit("unknown")), F.lit(":"), name)
