"""Counts, scores and summaries over findings, files, scans and progress logs.

Every aggregate combines on the map side; groups leave a task as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import paths as pt
from siftline.functions import severity as sev
from siftline.functions import text as tx
from siftline.operators import catalog as cat
from siftline.schemas import SEVERITY_RANK, STAGES

# Score weights.
MAINTAINABILITY_WEIGHTS = {"critical": 10, "warning": 5}
OTHER_WEIGHT = 1
SECURITY_WEIGHT = 15
TERMINAL = ("completed", "failed", "skipped")


def count_by_severity(findings: DataFrame) -> DataFrame:
    """One row per known severity, zero when absent; one pass, four counters."""
    s = F.lower(F.col("severity"))
    totals = findings.agg(*[F.count_if(s == name).alias(name) for name in SEVERITY_RANK])
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"), F.lit(name).alias("severity"), F.col(name).alias("count")
            )
            for i, name in enumerate(SEVERITY_RANK)
        ]
    )
    return totals.select(F.inline(rows))


def count_by_any_severity(findings: DataFrame) -> DataFrame:
    """Every value present, known ones first in display order."""
    r = sev.rank(F.col("severity"))
    return (
        findings.groupBy("severity")
        .agg(F.count("*").alias("count"))
        .withColumn("ord", F.when(r > 0, 4 - r).otherwise(99))
        .orderBy("ord", "severity")
    )


def count_by_type(findings: DataFrame) -> DataFrame:
    return (
        findings.groupBy("type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "type")
    )


def owasp_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(cat.CWE_TO_OWASP.items()), "cwe_id string, owasp string")


def cve_table(spark: SparkSession) -> DataFrame:
    rows = [(k, name, list(cves)) for k, (name, cves) in cat.CWE_CVES.items()]
    return spark.createDataFrame(rows, "cwe_id string, cwe_name string, cves array<string>")


def with_owasp(findings: DataFrame) -> DataFrame:
    """Category of each finding; findings without a mapped CWE drop out."""
    return findings.join(F.broadcast(owasp_table(findings.sparkSession)), "cwe_id")


def with_cves(findings: DataFrame) -> DataFrame:
    """CWE name and its first two CVEs; unknown CWEs stay, named ``Unknown``."""
    joined = findings.join(F.broadcast(cve_table(findings.sparkSession)), "cwe_id", "left")
    return joined.withColumn("cwe_name", F.coalesce("cwe_name", F.lit("Unknown"))).withColumn(
        "cves", F.array_join(F.slice(F.coalesce("cves", F.array().cast("array<string>")), 1, 2), ", ")
    )


def count_by_owasp(findings: DataFrame) -> DataFrame:
    return with_owasp(findings).groupBy("owasp").agg(F.count("*").alias("count"))


def scan_totals(scans: DataFrame) -> DataFrame:
    """Number of scans, mean duration and issues found; zeros when there are none."""
    return scans.agg(
        F.count("*").alias("total_scans"),
        F.coalesce(F.avg("duration"), F.lit(0.0)).alias("average_duration"),
        F.coalesce(F.sum("issues"), F.lit(0)).alias("total_issues"),
    )


def issues_by_category(scan_issues: DataFrame) -> DataFrame:
    return scan_issues.groupBy("category").agg(F.sum("issues").cast("bigint").alias("issues"))


def top_files(findings: DataFrame, limit: int = 5) -> DataFrame:
    counts = findings.groupBy(F.coalesce("file", F.lit("unknown")).alias("file")).agg(
        F.count("*").alias("issues")
    )
    order = [F.desc("issues"), F.asc("file")]
    first = counts.orderBy(*order).limit(limit)
    return first.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def _penalty(weights: dict[str, int], other: int) -> Column:
    cost = F.lit(other)
    for name, weight in weights.items():
        cost = F.when(F.col("severity") == name, weight).otherwise(cost)
    return cost


def maintainability(weights=None, other: int = OTHER_WEIGHT) -> Column:
    total = F.sum(_penalty(weights or MAINTAINABILITY_WEIGHTS, other))
    return F.greatest(F.lit(0.0), F.lit(100.0) - F.coalesce(total, F.lit(0)))


def security_score() -> Column:
    hits = F.count_if(F.col("type") == "security")
    return F.greatest(F.lit(0.0), F.lit(100.0) - F.lit(SECURITY_WEIGHT) * hits)


def scores(findings: DataFrame, *keys: str) -> DataFrame:
    return (
        findings.groupBy(*keys)
        .agg(maintainability().alias("maintainability"), security_score().alias("security"))
        .withColumn("quality", (F.col("maintainability") + F.col("security")) / 2)
    )


def _facts(df: DataFrame, **cols: Column) -> DataFrame:
    """Totals of a one-row aggregate as (metric, key, value) rows."""
    rows = [
        F.struct(F.lit(n).alias("metric"), F.lit("").alias("key"), c.cast("bigint").alias("value"))
        for n, c in cols.items()
    ]
    return df.select(F.inline(F.array(*rows)))


def _distributions(findings: DataFrame) -> DataFrame:
    """Counts by severity, by type and in total from one pass."""
    g = findings.groupingSets([["severity"], ["type"], []], "severity", "type").agg(
        F.grouping_id().alias("g"), F.count("*").alias("value")
    )
    metric = F.when(F.col("g") == 1, "severity").when(F.col("g") == 2, "type").otherwise("total_issues")
    key = F.when(F.col("g") == 1, F.col("severity")).when(F.col("g") == 2, F.col("type")).otherwise("")
    counted = g.select(metric.alias("metric"), F.coalesce(key, F.lit("unknown")).alias("key"), "value")
    # The total is reported for no findings too.
    zero = findings.sparkSession.range(1).select(
        F.lit("total_issues").alias("metric"), F.lit("").alias("key"), F.lit(0).cast("bigint").alias("value")
    )
    return counted.unionByName(zero).groupBy("metric", "key").agg(F.sum("value").alias("value"))


def review_summary(corpus: DataFrame, findings: DataFrame) -> DataFrame:
    """Files, lines of code, issues in total, by severity and by type, as rows."""
    totals = corpus.agg(
        F.count("*").alias("f"), F.coalesce(F.sum(tx.loc(F.col("content"))), F.lit(0)).alias("l")
    )
    return _facts(totals, files_reviewed=F.col("f"), lines_of_code=F.col("l")).unionByName(
        _distributions(findings)
    )


def scan_summary(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Files known, files scanned (readable), files with issues, and the distributions."""
    known = files.agg(F.count("*").alias("t"), F.count_if("scanned").alias("s"))
    hit = findings.agg(F.countDistinct("file").alias("w"))
    return (
        _facts(known, files_total=F.col("t"), files_scanned=F.col("s"))
        .unionByName(_facts(hit, files_with_issues=F.col("w")))
        .unionByName(_distributions(findings))
    )


def file_stats(merged: DataFrame) -> DataFrame:
    """Per file: issues after dedup, static and pack issues before it, and the difference."""
    per_key = merged.groupBy("file", "line_number", "message").agg(
        F.count_if(F.col("stage") == "static").alias("s"),
        F.count_if(F.col("stage") == cat.BUG_STAGE).alias("p"),
    )
    return (
        per_key.groupBy("file")
        .agg(
            F.count("*").alias("issues_count"),
            F.sum("s").alias("static_issues"),
            F.sum("p").alias("pack_issues"),
        )
        .withColumn(
            "model_issues",
            F.col("issues_count") - F.col("static_issues") - F.col("pack_issues"),
        )
    )


def stage_ord(stage: Column) -> Column:
    order = F.array(*[F.lit(s) for s in STAGES])
    at = F.array_position(order, stage)
    return F.when(at > 0, at - 1).otherwise(99).cast("int")


def stage_summary(runs: DataFrame) -> DataFrame:
    return (
        runs.groupBy("stage")
        .agg(
            F.count("*").alias("runs"),
            F.sum("issues").cast("bigint").alias("issues"),
            F.round(F.sum("duration_ms"), 4).alias("duration_ms"),
            F.count("error").alias("errors"),
        )
        .withColumn("ord", stage_ord(F.col("stage")))
        .orderBy("ord")
    )


def project_stats(files: DataFrame) -> DataFrame:
    """Totals, files per language (a fixed vocabulary), the largest and the newest file."""
    shown_as = F.coalesce(pt.display_language(F.col("path")), F.lit("Other"))
    language = F.col("language")
    vocabulary = sorted(set(pt.DISPLAY_LANGUAGE.values())) + ["Other"]
    counters = {name: F.count_if(language == name) for name in vocabulary}
    agg = files.select(
        "path", "size", "mtime", tx.loc(F.col("content")).alias("loc"), shown_as.alias("language")
    ).agg(
        F.count("*").alias("total_files"),
        F.sum("loc").alias("total_lines"),
        F.max(F.struct("size", "path"))["path"].alias("largest_file"),
        F.max(F.struct("mtime", "path"))["path"].alias("newest_file"),
        F.filter(
            F.array(*[F.struct(F.lit(n).alias("n"), c.alias("c")) for n, c in counters.items()]),
            lambda s: s["c"] > 0,
        ).alias("by"),
    )
    shown = F.transform("by", lambda s: F.concat(s["n"], F.lit("="), s["c"].cast("string")))
    return agg.withColumn("languages", F.array_join(shown, ",")).drop("by")


def duration_seconds(start: str = "start_time", end: str = "end_time") -> Column:
    """End minus start; NULL unless both are set."""
    return F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)) / F.lit(1e6)


def progress(items: DataFrame, *keys: str) -> DataFrame:
    status = F.col("status")
    return items.groupBy(*keys).agg(
        F.count("*").alias("total"),
        *[F.count_if(status == s).alias(s) for s in ("completed", "failed", "skipped", "running")],
        (
            F.timestamp_diff(
                "MICROSECOND",
                F.min("start_time"),
                F.max(F.coalesce("end_time", "start_time")),
            )
            / F.lit(1e6)
        ).alias("elapsed_seconds"),
        F.max(F.when(status == "running", F.struct("start_time", "name")))["name"].alias("current"),
    )


def completion(items: DataFrame, *keys: str) -> DataFrame:
    """All items terminal (false when there are none), any failed."""
    return items.groupBy(*keys).agg(
        F.coalesce(F.bool_and(F.col("status").isin(*TERMINAL)), F.lit(False)).alias("is_complete"),
        F.coalesce(F.bool_or(F.col("status") == "failed"), F.lit(False)).alias("has_failures"),
    )


def gate(findings: DataFrame) -> DataFrame:
    critical = F.count_if(F.col("severity") == "critical")
    return findings.agg(critical.alias("critical"), (critical > 0).alias("fail"))


def digest(findings: DataFrame, *keys: str) -> DataFrame:
    text = F.format_string(
        "Found %d critical issues and %d warnings. Overall code quality needs attention.",
        F.count_if(F.col("severity") == "critical"),
        F.count_if(F.col("severity") == "warning"),
    )
    return findings.groupBy(*keys).agg(text.alias("summary"))
