"""Registration of queries and the SQL pieces their oracles share."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from siftline.functions import text as tx
from siftline.plans import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return register


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"


corpus_sql = lambda body: with_(v.DUCK_CORPUS, body)
files_sql = lambda body: with_(v.DUCK_FILES, body)
findings_sql = lambda body: with_(v.DUCK_FINDINGS, body)
observations_sql = lambda body: with_(v.DUCK_OBSERVATIONS, body)
learning_sql = lambda body: with_(v.DUCK_KNOWN, body)
responses_sql = lambda body: with_(v.DUCK_RESPONSES, body)

WS = "(" + " || ".join(f"chr({ord(c)})" for c in tx.WHITESPACE) + ")"
strip_sql = lambda x: f"trim({x}, {WS})"
text_sql = v.sql_text


def re_sql(pattern: str, ignore_case: bool = True) -> str:
    flags = "(?i-s)" if ignore_case else "(?-s)"
    return text_sql(flags + tx.unicode_classes(pattern))


_RANK = "CASE {0} WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
rank_sql = _RANK.format
