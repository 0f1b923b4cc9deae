"""Shared schemas and small vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FINDINGS = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("line_number", T.IntegerType()),
        T.StructField("severity", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("suggestion", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("confidence_score", T.DoubleType()),
        T.StructField("stage", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("cwe_id", T.StringType()),
        T.StructField("code_snippet", T.StringType()),
        T.StructField("details", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)

PATTERNS = T.StructType(
    [
        T.StructField("pattern_key", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("first_seen", T.TimestampNTZType()),
        T.StructField("last_seen", T.TimestampNTZType()),
        T.StructField("typical_severity", T.StringType()),
        T.StructField("example_messages", T.ArrayType(T.StringType())),
        T.StructField("suggestion", T.StringType()),
        T.StructField("custom_rule_generated", T.BooleanType()),
    ]
)

# Review stages in output order, severities and their ranks.
STAGES = ("security", "bugs", "performance", "style", "codex-bug")
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
SEVERITY_LEVEL = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}


def as_findings(df: DataFrame) -> DataFrame:
    """Project to the findings schema; absent columns become NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in FINDINGS.fields
        ]
    )
