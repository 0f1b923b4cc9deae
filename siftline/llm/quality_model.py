"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic rates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm import common
from siftline.llm.quality_rules import rule_counts

#: Random features; the normal equations have this many rows, whatever the corpus.
FEATURES = 192
RIDGE = 1e-3
#: Bins of the raw score for the isotonic fit.
BINS = 1_000
#: Parts over which the normal equations are summed; each sends one matrix to the driver.
PARTS = 16

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".",
    "comma": b",;:",
    "mark": b"!?",
    "bar": b"|",
    "hash": b"#*$%&",
    "angle": b"<>{}[]",
    "at": b"@/\\_=+~^",
    "quote": b"\"'()-",
    "line": b"\n",
    "space": b" \t",
}
_TABLE = np.full(256, len(_CLASSES), np.int64)
for _i, _members in enumerate(_CLASSES.values()):
    _TABLE[list(_members)] = _i
STATISTICS = len(_CLASSES) + 1 + 8


def statistics(column: pa.Array) -> np.ndarray:
    """A row of numbers for each text: shares of character classes, lengths and repetition."""
    raw, offsets = common.utf8(column)
    rows, kinds = len(column), len(_CLASSES) + 1
    per = np.bincount(common.row_of(offsets) * kinds + _TABLE[raw], minlength=rows * kinds).reshape(rows, kinds)
    counts = rule_counts(column)
    size = np.diff(offsets)
    n = counts["n_words"]
    begins, ends, at = common.words(raw, offsets)
    hashes = common.span_hashes(raw, begins, ends, fold=True)
    key = hashes + common.row_of(at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    found, which = np.unique(key, return_index=True)
    distinct = np.bincount(common.row_of(at)[which], minlength=rows)
    lengths = (ends - begins).astype(float)
    mean = common.summed(lengths, at) / np.maximum(n, 1)
    spread = common.summed(lengths * lengths, at) / np.maximum(n, 1) - mean * mean
    columns = [
        *np.sqrt(per / np.maximum(size, 1)[:, None]).T,
        np.log1p(size),
        np.log1p(n),
        mean,
        np.sqrt(np.maximum(spread, 0)),
        distinct / np.maximum(n, 1),
        counts["n_symbols"] / np.maximum(n, 1),
        np.log1p(counts["n_dup_lines"]),
        counts["n_repeat_words"] / np.maximum(n, 1),
    ]
    return np.stack(columns, axis=1)


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and its ``stats`` for every whole text."""
    source = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.text_slices(batches, "text"):
            values = statistics(part.column("text"))
            ends = (np.arange(part.num_rows + 1) * STATISTICS).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.ListArray.from_arrays(ends, values.ravel())], names=["doc_id", "stats"]
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


@dataclass
class Kernel:
    """Random Fourier features of standardised statistics, with a linear score on top."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    rates: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(7)
        frequencies = rng.normal(size=(stats.shape[1], FEATURES)) / np.sqrt(stats.shape[1])
        phases = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ frequencies + phases), np.ones((len(z), 1))])

    def bins(self, stats: np.ndarray) -> np.ndarray:
        raw = self.features(stats) @ self.weights
        return np.clip((raw + 0.5) * BINS / 2, 0, BINS - 1).astype(int)

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return self.rates[self.bins(stats)]


def _sums(rows: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """The normal equations, summed over the rows of each part and then over the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            z = kernel.features(_matrix(batch.column("stats")))
            a += z.T @ z
            b += z.T @ np.asarray(batch.column("label"))
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([b.tobytes()])], names=["a", "b"])

    found = rows.select("stats", "label").repartition(PARTS).mapInArrow(run, "a binary, b binary").collect()
    a = sum(np.frombuffer(r["a"]).reshape(FEATURES + 1, -1) for r in found)
    return a, sum(np.frombuffer(r["b"]) for r in found)


def fit(rows: DataFrame) -> Kernel:
    """A classifier from all labelled statistics (``doc_id``, ``stats``, ``label``).

    A quarter of the rows, by hash, is kept for the isotonic rates; the rest gives the scores.
    Without rows every score is one half.
    """
    places = F.posexplode("stats").alias("i", "x")
    moments = rows.select(places).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
    mean, scale = np.zeros(STATISTICS), np.ones(STATISTICS)
    for r in moments:
        mean[r["i"]], scale[r["i"]] = r["m"], max(r["s"], 1e-6)
    kernel = Kernel(mean, scale, np.zeros(FEATURES + 1), np.full(BINS, 0.5))
    if not moments:
        return kernel
    apart = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(4)) == 0
    a, b = _sums(rows.where(~apart), kernel)
    kernel.weights = np.linalg.solve(a + RIDGE * max(1.0, a[-1, -1]) / FEATURES * np.eye(len(b)), b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = kernel.bins(_matrix(batch.column("stats")))
            yield pa.RecordBatch.from_arrays([pa.array(where), batch.column("label")], names=["bin", "label"])

    held = rows.where(apart).select("stats", "label").mapInArrow(run, "bin long, label double")
    counts, ones = np.zeros(BINS), np.zeros(BINS)
    for r in held.groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("k")).collect():
        counts[r["bin"]], ones[r["bin"]] = r["n"], r["k"]
    share = (ones.sum() + 1) / (counts.sum() + 2)
    kernel.rates = common.isotonic(counts + 0.01, ones + 0.01 * share)
    # strictly increasing inside the fitted steps, so that equal rates still rank
    kernel.rates = np.clip(kernel.rates * 0.998 + np.linspace(0, 0.002, BINS), 0, 1)
    return kernel


def scored(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality") -> DataFrame:
    """``doc_id`` and ``score`` (probability of label 1) of every whole text.

    Learns from all labels for which ``train`` holds. A null or empty text is scored by its
    statistics, all zero but for the standardisation. Repeated rows are scored each; null ids are
    scored and never learnt from. Only ``doc_id`` and ``text`` are read.
    """
    stats = common.stored(document_statistics(docs), "statistics")
    known = common.label_rows(labels.where(train), label)
    kernel = docs.sparkSession.sparkContext.broadcast(fit(stats.join(known, "doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = kernel.value.scores(_matrix(batch.column("stats")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.mapInArrow(run, f"doc_id {kind}, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores and predictions; ids whose remainder is 1 are held out (a null id is not)."""
    rest = common.remainder(F.col("doc_id"), 3)
    return scored(docs, labels, rest != 1).select(
        "doc_id",
        F.coalesce(rest == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def kept(docs: DataFrame, labels: DataFrame, least: float, label: str = "quality") -> DataFrame:
    """The documents, all columns, whose score is ``least`` or more; learns from all labels."""
    known = document_statistics(docs).join(common.label_rows(labels, label), "doc_id")
    kernel = docs.sparkSession.sparkContext.broadcast(fit(common.stored(known, "statistics")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.text_slices(batches, "text"):
            yield part.filter(pa.array(kernel.value.scores(statistics(part.column("text"))) >= least))

    return docs.mapInArrow(run, docs.schema)
