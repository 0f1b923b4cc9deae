"""Deduplication, ordering and top-k of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions import severity as sev
from siftline.schemas import SEVERITY_RANK, STAGES
from siftline.session import checkpointed

KEY = ("file", "line_number", "message")
_ROW_BITS = (1 << 33) - 1


def merge(static: DataFrame, stages: DataFrame, pack: DataFrame) -> DataFrame:
    """Union in the order static, stages, pack; ``seq`` is kept and ``branch`` goes first."""
    parts = [
        static.withColumn("stage", F.lit("static")).withColumn("branch", F.lit(0)),
        stages.withColumn("branch", F.lit(1)),
        pack.withColumn("branch", F.lit(2)),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _emission(findings: DataFrame, by_file: bool = False) -> list[Column]:
    """A total order: branch, place of a model stage, ``seq``, and then what tells findings apart.

    The ``seq`` of a scan counts inside a file, so findings of several files are taken ``by_file``.
    """
    has = set(findings.columns)
    order = [F.col("branch")] if "branch" in has else []
    if {"branch", "stage"} <= has:
        place = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
        order.append(F.when(F.col("branch") == 1, place))
    order += [F.col("file")] if by_file else []
    order += [F.col(c) for c in ("seq", "file", "line_number", "type", "message", "severity") if c in has]
    return order


def _one_per_key(findings: DataFrame, order: list[Column]) -> DataFrame:
    """First row of every key. Spark limits each task to one row per key before the shuffle,
    so a key that holds a large share of the rows arrives as one row per task."""
    w = Window.partitionBy(*KEY).orderBy(*order)
    return findings.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def keep_most_severe(findings: DataFrame) -> DataFrame:
    order = [sev.rank(F.col("severity")).desc(), *_emission(findings)]
    return _one_per_key(findings, order)


def keep_first(findings: DataFrame) -> DataFrame:
    return _one_per_key(findings, _emission(findings))


def keep_last(findings: DataFrame) -> DataFrame:
    return _one_per_key(findings, [c.desc() for c in _emission(findings)])


def severity_order(findings: DataFrame) -> list[Column]:
    """Severity descending, then line, then emission order."""
    return [
        sev.rank(F.col("severity")).desc(),
        F.coalesce(F.col("line_number"), F.lit(0)),
        *_emission(findings),
    ]


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """1-based position of every row in a total order, without a single-task window.

    Rows are range-partitioned and sorted, the result is checkpointed so that its partitions
    are fixed, and each partition's offset is the number of rows in the partitions before it.
    """
    fixed = checkpointed(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_idx", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
    )
    # One row per partition: the window and the broadcast are bounded by their number.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        fixed.groupBy("_pid")
        .agg(F.count("*").alias("_n"))
        .select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    return (
        fixed.join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_off") + F.col("_idx") + 1)
        .drop("_pid", "_idx", "_off")
    )


def ranked(findings: DataFrame) -> DataFrame:
    return with_position(findings, severity_order(findings), "rank")


def numbered_in_severity(findings: DataFrame, by_file: bool = False) -> DataFrame:
    """Labels ``C1, C2, … H1, …`` in severity order; other severities are left out."""
    known = findings.withColumn("_rank", sev.rank(F.col("severity"))).filter("_rank > 0")
    placed = with_position(known, [F.col("_rank").desc(), *_emission(findings, by_file)], "_pos")
    # Four rows: the size of each severity.
    sizes = placed.groupBy("_rank").agg((F.min("_pos") - 1).alias("_before"))
    number = F.col("_pos") - F.col("_before")
    return (
        placed.join(F.broadcast(sizes), "_rank")
        .withColumn("number", number)
        .withColumn("label", F.concat(F.upper(F.substring("severity", 1, 1)), number.cast("string")))
        .drop("_rank", "_pos", "_before")
    )


def top_per_severity(findings: DataFrame, limit: int = 10, by_file: bool = False) -> DataFrame:
    """First findings of every severity with the size of the severity and the remainder.

    Unknown severities count as low.
    """
    known = F.col("severity").isin(*SEVERITY_RANK)
    bucketed = findings.withColumn("bucket", F.when(known, F.col("severity")).otherwise("low"))
    w = Window.partitionBy("bucket").orderBy(*_emission(findings, by_file))
    first = bucketed.withColumn("position", F.row_number().over(w)).filter(
        F.col("position") <= limit
    )
    # Four rows at most.
    sizes = bucketed.groupBy("bucket").agg(F.count("*").alias("bucket_size"))
    return first.join(F.broadcast(sizes), "bucket").withColumn(
        "more", F.greatest(F.lit(0), F.col("bucket_size") - limit)
    )


def top_n(findings: DataFrame, limit: int = 25) -> DataFrame:
    """The first findings in display order and how many remain."""
    order = severity_order(findings)
    total = findings.agg(F.count("*")).scalar()
    return (
        findings.orderBy(*order)
        .limit(limit)
        .withColumn("position", F.row_number().over(Window.orderBy(*order)))
        .withColumn("more", F.greatest(F.lit(0), total - limit))
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
