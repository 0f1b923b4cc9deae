"""Composed reviews: corpus in, findings and their metrics out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators import catalog as cat
from siftline.operators import filters, linescan, ranking, structure
from siftline.schemas import as_findings


# Static checks and bug statements are for Python files, bug patterns for every file.
STATIC = tuple(c.only_for("python") for c in structure.STATIC)
BUGS = (
    *linescan.BUG_PATTERNS,
    structure.EMPTY_EXCEPT_BUG,
    *(c.only_for("python") for c in structure.BUG_STATEMENTS),
)


def review(corpus: DataFrame, stage_findings: DataFrame | None = None, bug_pack: bool = True) -> DataFrame:
    """Static checks, model stages and the bug pack, merged and deduplicated.

    Both packs are one pass over the corpus. Equal findings inside the bug pack come from one
    rule and differ only in position, so the final deduplication covers them. Severities of the
    model stages count in any case; of equal findings the one of the earlier stage stays.
    """
    found = linescan.scan(corpus, STATIC + (BUGS if bug_pack else ()))
    is_bug = F.col("stage").eqNullSafe(cat.BUG_STAGE)
    merged = found.withColumn("branch", F.when(is_bug, 2).otherwise(0)).withColumn(
        "stage", F.coalesce("stage", F.lit("static"))
    )
    if stage_findings is not None:
        merged = merged.unionByName(filters.normalised(stage_findings).withColumn("branch", F.lit(1)))
    return ranking.keep_most_severe(merged)


def security_scan(corpus: DataFrame, imported: DataFrame | None = None) -> DataFrame:
    """Imported scanner findings, then the category patterns; first duplicate wins."""
    own = linescan.owasp(corpus).withColumn("branch", F.lit(1))
    if imported is not None:
        own = imported.withColumn("branch", F.lit(0)).unionByName(own)
    return as_findings(ranking.keep_first(own))


def secret_severities_by_source(texts: DataFrame) -> DataFrame:
    """Hard-coded secrets in the texts of each source, deduplicated, by severity.

    ``texts`` has ``path, content, source``.
    """
    lines = linescan.numbered_lines(texts.select("path", "content", "source"))
    keyed = lines.withColumn("file", F.concat_ws("/", "source", "file"))
    found = ranking.keep_most_severe(
        linescan.scan_lines(keyed, linescan.LINE_CHECKS["hardcoded_secrets"])
    )
    source = F.substring_index("file", "/", 1).alias("source")
    return found.groupBy(source, "severity").agg(F.count("*").alias("findings"))
