"""Helpers shared by the corpus operators: text kernels on Arrow buffers, labelled samples."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.session import checkpoint_dir

#: Bytes of text that the array kernels take at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/siftline-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``limit`` bytes of text each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        slot = np.cumsum(sizes.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the offset where each row begins (and the end).

    A null is a row of no bytes.
    """
    values = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word ``[^\\x20\\x09-\\x0D]+``, and for each row its first word's place."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = offsets[(offsets > 0) & (offsets < len(raw))]
    first[borders] = inside[borders]
    last[borders - 1] = inside[borders - 1]
    begins = np.flatnonzero(first)
    return begins, np.flatnonzero(last) + 1, np.searchsorted(begins, offsets)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for base in (_BASE, inverse):
        table = np.full(n, base, np.uint64)
        table[0] = 1
        out.append(np.multiply.accumulate(table))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(
    raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, fold: bool = False
) -> np.ndarray:
    """A 64-bit hash of each span of bytes; with ``fold``, A-Z count as a-z."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    size = 1 << max(20, int(len(raw)).bit_length())
    up, down = _powers(size)
    values = (_BYTE_VALUES[_LOWER] if fold else _BYTE_VALUES)[raw] * up[: len(raw)]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return mixed((total[ends] - total[begins]) * down[begins])


def lowered(raw: np.ndarray) -> np.ndarray:
    """The bytes with a-z for A-Z."""
    return _LOWER[raw]


def summed(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each row, where row i has ``values[offsets[i]:offsets[i + 1]]``."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; null for a null id."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % m).cast("int")


def label_rows(labels: DataFrame, label: str) -> DataFrame:
    """One row (``doc_id``, ``label`` 0.0 or 1.0) per labelled id; several labels of an id are averaged."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("double").alias("label"))
    )


def label_sample(labels: DataFrame, label: str, train: Column, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids of the training fold, those with the smallest hashes."""
    return (
        label_rows(labels.where(train), label)
        .orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id")
        .limit(rows)
    )


def one_text_each(rows: DataFrame) -> DataFrame:
    """One row (``doc_id``, ``label``, ``text``) per id: of repeated ids the text with the smallest hash."""
    text = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")
    return rows.groupBy("doc_id", "label").agg(text).select("doc_id", "label", "least.text")


def isotonic(counts: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Non-decreasing rates fitted to bins in order (pool adjacent violators, one virtual pair a block)."""
    blocks: list[list[float]] = []
    for i, (n, k) in enumerate(zip(counts.tolist(), ones.tolist(), strict=True)):
        blocks.append([k, n, i, i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            k2, n2, _, end = blocks.pop()
            blocks[-1] = [blocks[-1][0] + k2, blocks[-1][1] + n2, blocks[-1][2], end]
    rates = np.zeros(len(counts))
    for k, n, a, b in blocks:
        rates[a : b + 1] = k / n if n else 0.0
    return rates
