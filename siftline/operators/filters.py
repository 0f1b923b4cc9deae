"""Filters on findings. Each is a function DataFrame to DataFrame, so chains compose."""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import severity as sev
from siftline.functions.text import contains_any
from siftline.schemas import SEVERITY_LEVEL, SEVERITY_RANK, as_findings

Filter = Callable[[DataFrame], DataFrame]


def min_severity(minimum: str = "info") -> Filter:
    floor = SEVERITY_LEVEL.get(minimum, 1)
    return lambda df: df.filter(sev.level(F.col("severity")) >= floor)


def min_severity_strict(minimum: str | None) -> Filter:
    """Unknown severities rank 0 and go away as soon as a minimum is given."""
    if not minimum:
        return lambda df: df
    floor = SEVERITY_RANK.get(minimum, 0)
    return lambda df: df.filter(sev.rank(F.col("severity")) >= floor)


def by_type(include: list[str] | None = None, exclude: list[str] | None = None) -> Filter:
    kind = F.coalesce(F.col("type"), F.lit(""))

    def apply(df: DataFrame) -> DataFrame:
        kept = df.filter(kind.isin(*include)) if include else df
        return kept.filter(~kind.isin(*exclude)) if exclude else kept

    return apply


def by_path(
    include: list[str] | None = None, exclude: list[str] | None = None, column: str = "file"
) -> Filter:
    path = F.coalesce(F.col(column), F.lit(""))

    def apply(df: DataFrame) -> DataFrame:
        kept = df.filter(contains_any(path, include)) if include else df
        return kept.filter(~contains_any(path, exclude)) if exclude else kept

    return apply


def custom(predicate: Callable[[DataFrame], Column]) -> Filter:
    return lambda df: df.filter(F.coalesce(predicate(df), F.lit(False)))


def chain(*filters: Filter) -> Filter:
    return lambda df: reduce(lambda d, f: d.transform(f), filters, df)


def with_defaults(items: DataFrame) -> DataFrame:
    """Fill the fields a model response left out."""
    c = lambda name, value: F.coalesce(F.col(name), F.lit(value))
    return as_findings(
        items.withColumns(
            {
                "severity": c("severity", "medium"),
                "type": c("type", "best_practice"),
                "message": c("message", "Issue found"),
                "line_number": c("line_number", 0),
                "confidence": c("confidence", "high"),
            }
        )
    )


def normalised(findings: DataFrame) -> DataFrame:
    """Lower-case severities, so that every rank table applies."""
    return findings.withColumn("severity", F.lower("severity"))
