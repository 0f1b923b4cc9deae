"""Folder trees as tables: listed, read and written by tasks.

The file source of Spark leaves out empty files and names that begin with an underscore or a dot,
which a source tree is full of. Here the folders of one depth are listed side by side and those of the
next depth are found among their entries, so no process holds the whole listing; a folder that is
excluded is never listed.
"""

from __future__ import annotations

import os
import re
from typing import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import paths as pt
from siftline.session import checkpointed

#: Entries, and bytes of contents, that leave a task in one batch.
BATCH_ENTRIES, BATCH_BYTES = 10_000, 64 << 20
#: Contents of this size and more are not read; a row could not hold them.
MOST_BYTES = 1 << 30

_ENTRY = pa.schema(
    [("name", pa.string()), ("is_dir", pa.bool_()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC"))]
)
_READ = pa.schema([("name", pa.string()), ("content", pa.binary()), *list(_ENTRY)[2:]])


def qualified(spark: SparkSession, root: str) -> str:
    """The root with its scheme; a bare path lies in the default file system of the cluster."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", whole).rstrip("/")


def _open(root: str) -> tuple[arrow_fs.FileSystem, str]:
    scheme, rest = root.split("://", 1)
    return arrow_fs.FileSystem.from_uri(f"{scheme}://{quote(rest, safe='/:@')}")


def _listing(root: str):
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(root)
        for batch in batches:
            for folder in batch.column("name").to_pylist():
                above = f"{folder}/" if folder else ""
                infos = files.get_file_info(arrow_fs.FileSelector(f"{base}/{folder}".rstrip("/")))
                # A linked folder may lie above itself.
                linked = lambda i: files.type_name == "local" and not i.is_file and os.path.islink(i.path)
                infos = [i for i in infos if i.type != arrow_fs.FileType.NotFound and not linked(i)]
                for at in range(0, len(infos), BATCH_ENTRIES):
                    part = infos[at : at + BATCH_ENTRIES]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([above + i.base_name for i in part], pa.string()),
                            pa.array([not i.is_file for i in part], pa.bool_()),
                            pa.array([i.size if i.is_file else None for i in part], pa.int64()),
                            pa.array([i.mtime for i in part], _ENTRY.field("mtime").type),
                        ],
                        schema=_ENTRY,
                    )

    return entries


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``name, size, mtime`` of all files below ``root``, empty and hidden ones too; names are relative.

    Folders with an excluded name are not listed, wherever they lie below the root; links to folders are
    not followed. One job for each depth, whose entries are written to the checkpoint folder.
    """
    whole = qualified(spark, root)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level, found = spark.createDataFrame([("",)], "name string"), None
    while True:
        entries = checkpointed(
            level.mapInArrow(_listing(whole), "name string, is_dir boolean, size bigint, mtime timestamp")
        )
        files = entries.filter("NOT is_dir").drop("is_dir")
        found = files if found is None else found.unionByName(files)
        folders = entries.filter(
            F.col("is_dir") & ~F.substring_index("name", "/", -1).isin(*pt.EXCLUDED_DIRS)
        ).select("name")
        if folders.isEmpty():
            return found
        level = folders.repartition(tasks, "name")


def read_contents(files: DataFrame, root: str) -> DataFrame:
    """``name, content, size, mtime``: the listed files with their bytes, null from ``MOST_BYTES`` on.

    Only names move: they are dealt into as many tasks as the bytes need splits of the configured size.
    """
    spark = files.sparkSession
    whole = qualified(spark, root)
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // split))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored, base = _open(whole)
        rows, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                row["content"] = None
                if row["size"] < MOST_BYTES:
                    with stored.open_input_stream(f"{base}/{row['name']}") as f:
                        row["content"] = f.read()
                    held += row["size"]
                rows.append(row)
                if held >= BATCH_BYTES or len(rows) >= BATCH_ENTRIES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    dealt = files.select("name", "size", "mtime").repartition(tasks, "name")
    return dealt.mapInArrow(contents, "name string, content binary, size bigint, mtime timestamp")


def write_files(corpus: DataFrame, root: str) -> int:
    """Write ``path, content`` as files below ``root`` and return how many; null contents are empty files.

    A task that is repeated writes the same files again. Paths stay below the root.
    """
    whole = qualified(corpus.sparkSession, root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored, base = _open(whole)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(*(batch.column(c).to_pylist() for c in ("path", "content"))):
                folder = "/".join([base, *path.split("/")[:-1]])
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"not below the root: {path}")
                if folder not in made:
                    stored.create_dir(folder, recursive=True)
                    made.add(folder)
                with stored.open_output_stream(f"{base}/{path}") as f:
                    f.write((content or "").encode("utf-8"))
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    written = corpus.select("path", F.col("content").cast("string").alias("content")).mapInArrow(write, "n bigint")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
