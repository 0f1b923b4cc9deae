"""Reading source files and ignore lists."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import paths as pt
from siftline.functions.text import normalise_newlines, strip
from siftline.sources import tree

FILE_LIMIT = 50
MAX_FILE_BYTES = 1048576


def relative(path, root: str):
    """Path below the scanned root, without scheme and root prefix."""
    scheme = r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*/"
    plain, prefix = F.regexp_replace(path, scheme, "/"), re.sub(scheme, "/", root).rstrip("/") + "/"
    return F.when(F.startswith(plain, F.lit(prefix)), F.substring(plain, F.lit(len(prefix) + 1), F.length(plain))).otherwise(plain)


def read_files(spark: SparkSession, root: str, errors: str = "strict", max_bytes: int | None = None) -> DataFrame:
    """``path, content, size, mtime, language, error`` of the supported files below ``root``.

    Names, folders and sizes are matched in the listing, before any content is read: an excluded folder
    is never opened. Empty files and names with a leading underscore or dot are read like others. A file
    that is not UTF-8 (``strict``; with ``ignore`` it is repaired) and one of ``max_bytes`` or more stays
    as a row with null content and its ``error``; so does one that no row can hold.
    """
    listed = tree.list_files(spark, root).filter(pt.is_scannable(F.col("name")))
    limit = tree.MOST_BYTES if max_bytes is None else min(max_bytes, tree.MOST_BYTES)
    about = ["name", "size", "mtime"]
    large = listed.filter(F.col("size") >= limit).select(
        F.lit(None).cast("string").alias("content"), *about, F.lit("too large").alias("error")
    )
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    if errors == "strict":
        found, error = F.when(valid, text), F.when(~valid, "not UTF-8")
    else:
        # Invalid bytes are dropped, as an ignoring decoder does.
        repaired = F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit(""))
        found, error = F.when(valid, text).otherwise(repaired), F.lit(None).cast("string")
    small = tree.read_contents(listed.filter(F.col("size") < limit), root)
    rows = small.select(found.alias("content"), *about, error.alias("error")).unionByName(large)
    path = F.concat(F.lit(tree.qualified(spark, root) + "/"), F.col("name"))
    return rows.select(
        path.alias("path"), normalise_newlines(F.col("content")).alias("content"), "size", "mtime",
        pt.language(F.col("name")).alias("language"), "error",
    )


def scannable(files: DataFrame) -> DataFrame:
    return files.filter(pt.is_scannable(F.col("path")))


def first_files(files: DataFrame, limit: int) -> DataFrame:
    """The first files of a review, in path order."""
    return files.orderBy("path").limit(limit)


def size_labelled(files: DataFrame, limit: int) -> DataFrame:
    """All files with ``too_large``: whether their content has more than ``limit`` characters."""
    return files.withColumn("too_large", F.coalesce(F.length("content") > limit, F.lit(False)))


def ignore_patterns(lines: DataFrame, column: str = "value") -> DataFrame:
    """Patterns of an ignore file: stripped, without blank and comment lines."""
    return lines.select(strip(F.col(column)).alias("pattern")).filter(
        (F.col("pattern") != "") & ~F.startswith("pattern", F.lit("#"))
    )


def read_ignore_file(spark: SparkSession, path: str) -> DataFrame:
    return ignore_patterns(spark.read.text(path))
