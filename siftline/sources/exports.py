"""Writing findings and scan logs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# CSV header.
CSV_COLUMNS = {
    "Severity": "severity", "Type": "type", "File": "file", "Line": "line_number",
    "Message": "message", "Suggestion": "suggestion",
}
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
JSON_COLUMNS = ("type", "severity", "message", "file", "line_number", "suggestion", "stage")


def json_records(findings: DataFrame) -> DataFrame:
    record = F.to_json(F.struct(*JSON_COLUMNS), {"ignoreNullFields": "false"})
    return findings.select(record.alias("value"))


def _target(path: str, run: str | None) -> str:
    """The folder of a run: writing a run again replaces what it wrote, and no other run's rows."""
    if run is None:
        return path
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", run):
        raise ValueError(f"a run is named with letters, digits and _.- : {run}")
    return f"{path.rstrip('/')}/run={run}"


def write_json(findings: DataFrame, path: str, run: str | None = None) -> None:
    """One record a line, over the folder or over the part of a ``run``."""
    findings.select(*JSON_COLUMNS).write.mode("overwrite").json(_target(path, run), ignoreNullFields=False)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """The written findings, with their ``run`` where they have one."""
    kinds = ", ".join(f"{c} {'int' if c == 'line_number' else 'string'}" for c in JSON_COLUMNS)
    return spark.read.schema(f"{kinds}, run string").json(path)


def csv_rows(findings: DataFrame) -> DataFrame:
    return findings.select(*[F.col(c).alias(name) for name, c in CSV_COLUMNS.items()])


def write_csv(findings: DataFrame, path: str, run: str | None = None) -> None:
    """Rows under a header; a null is an empty field, an empty text a quoted one, blanks stay."""
    csv_rows(findings).write.mode("overwrite").csv(_target(path, run), **_CSV)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The written rows, with their ``run`` where they have one; fields may span lines."""
    kinds = ", ".join(f"{name} {'int' if name == 'Line' else 'string'}" for name in CSV_COLUMNS)
    # Any mark that no text holds: with the usual one, empty texts would be null as well.
    return spark.read.schema(f"{kinds}, run string").csv(path, multiLine=True, nullValue="\ufdd0\ufdd1", **_CSV)


def scan_log(scans: DataFrame) -> DataFrame:
    """Rows of the scan log: scans whose start was recorded, with their duration."""
    seconds = F.timestamp_diff("MICROSECOND", F.col("start_ts"), F.col("end_ts")) / F.lit(1e6)
    return scans.filter(F.col("start_ts").isNotNull()).select(
        "scan_id", seconds.alias("duration"), "issues", F.col("end_ts").alias("ts")
    )


def append_scan_log(scans: DataFrame, path: str, run: str | None = None) -> None:
    """Add scans to the log; a ``run`` that is written again leaves one copy. A log has runs or has none."""
    scan_log(scans).write.mode("append" if run is None else "overwrite").parquet(_target(path, run))


def write_texts(texts: DataFrame, path: str, run: str | None = None) -> None:
    """Report texts, over the folder or over the part of a ``run``."""
    texts.write.mode("overwrite").parquet(_target(path, run))
