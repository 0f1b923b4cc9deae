"""Quality rules and a hashed n-gram classifier, both scored in one Arrow pass."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import common

#: Labelled rows the classifier is fitted on at most.
SAMPLE_ROWS = 2_000
#: Hashed features; a fixed number, whatever the corpus.
BITS = 16
#: Orders of the word and byte n-grams.
WORD_ORDERS = (1, 2)
CHAR_ORDERS = (3, 4)
#: A document is kept at this probability of label 1 or more.
KEEP_AT = 0.5
#: Words of a repeated window, and the share of words in such windows that fails.
WINDOW = 8
MAX_REPEATED = 30
MIN_WORDS = 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SEED = np.uint64(0xD6E8FEB86659FD93)


def _seed(order: int) -> np.uint64:
    return np.uint64(order * int(_SEED) & (1 << 64) - 1)


def rule_counts(part: pa.Array) -> dict[str, np.ndarray]:
    """The counts that the rules rest on, for each text of a string column."""
    raw, offsets = common.utf8(part)
    begins, ends, at = common.words(raw, offsets)
    hashes = common.span_hashes(raw, begins, ends)
    points = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
    lines = [
        [line for line in (t or "").split("\n") if line.strip(" \t\n\v\f\r")] for t in part.to_pylist()
    ]
    return {
        "n_words": np.diff(at),
        "word_chars": common.summed(points[ends] - points[begins], at),
        "n_symbols": common.summed(_SYMBOL[raw], offsets),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": _repeated(hashes, at),
    }


def _repeated(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words that lie in a window of ``WINDOW`` words which the same text holds twice or more."""
    n = len(hashes) - WINDOW + 1
    if n < 1:
        return np.zeros(len(at) - 1, np.int64)
    row = common.row_of(at)
    window = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        window = (window ^ hashes[k : k + n]) * _SEED
        window ^= window >> np.uint64(29)
    begins = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    key = common.mixed(window[begins] + row[begins].astype(np.uint64) * _SEED)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(begins), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, begins[twice], 1)
    np.add.at(edge, begins[twice] + WINDOW, -1)
    return common.summed((np.cumsum(edge[:-1]) > 0).astype(np.int64), at)


def _grams(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the feature of each n-gram, and where each text's n-grams begin and end."""
    shift = np.uint64(64 - BITS)
    begins, ends, at = common.words(raw, offsets)
    hashes = common.span_hashes(raw, begins, ends, fold=True)
    for order in WORD_ORDERS:
        yield _ordered(hashes, at, order, _seed(order), shift)
    for order in CHAR_ORDERS:
        yield _ordered(raw.astype(np.uint64) + np.uint64(1), offsets, order, _seed(64 + order), shift)


def _ordered(
    values: np.ndarray, at: np.ndarray, order: int, seed: np.uint64, shift: np.uint64
) -> tuple[np.ndarray, np.ndarray]:
    n = max(0, len(values) - order + 1)
    out = np.full(n, seed, np.uint64)
    for k in range(order):
        out = (out ^ values[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    spans = np.stack([np.minimum(at[:-1], n), np.minimum(np.maximum(at[1:] - order + 1, at[:-1]), n)])
    return ((out * _SEED) >> shift).astype(np.int32), spans


@dataclass
class Model:
    """Weights by feature, and the calibration of the logit."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, column: pa.Array) -> np.ndarray:
        """A text without any n-gram has the bias alone."""
        raw, offsets = common.utf8(column)
        score, count = np.zeros(len(column)), np.zeros(len(column))
        for features, (a, b) in _grams(raw, offsets):
            total = np.zeros(len(features) + 1)
            np.cumsum(self.weights[features], out=total[1:])
            score += total[b] - total[a]
            count += b - a
        return self.bias + score / np.maximum(count, 1)

    def probabilities(self, column: pa.Array) -> np.ndarray:
        return _sigmoid(self.slope * self.logits(column) + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: DataFrame) -> Model:
    """A calibrated logistic regression on labelled texts (``doc_id``, ``text``, ``label``).

    The caller bounds the rows; n-grams are hashed and counted in the tasks, so what arrives here
    has at most ``2 ** BITS`` pairs a row. A fifth of the rows calibrates. Without rows of both
    labels every probability is the share of label 1 (one half without rows).
    """
    schema = "label double, holds boolean, features array<int>, shares array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.text_slices(batches, "text"):
            raw, offsets = common.utf8(part.column("text"))
            grams = list(_grams(raw, offsets))
            features, shares = [], []
            for i in range(part.num_rows):
                own = np.concatenate([f[a[i] : b[i]] for f, (a, b) in grams])
                found, n = np.unique(own, return_counts=True)
                features.append(found)
                shares.append(n / max(1, len(own)))
            columns = [part.column("label"), part.column("holds"), pa.array(features, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(shares, pa.list_(pa.float64()))], names=["label", "holds", "features", "shares"]
            )

    chosen = texts.select("label", (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0).alias("holds"), "text")
    rows = chosen.mapInArrow(run, schema).toArrow()
    label = np.asarray(rows["label"], float)
    model = Model(np.zeros(1 << BITS), 0.0)
    if len(set(label.tolist())) < 2:
        rate = (label.sum() + 1) / (len(label) + 2) if len(label) else 0.5
        return Model(model.weights, float(np.log(rate / (1 - rate))))
    holds = np.asarray(rows["holds"], bool)
    lists = rows["features"].combine_chunks()
    row = common.row_of(np.asarray(lists.offsets) - lists.offsets[0].as_py())
    column = np.asarray(lists.flatten())
    share = np.asarray(rows["shares"].combine_chunks().flatten())
    model = _descend(label, row, column, share, ~holds if (~holds).any() else holds)
    logits = model.bias + np.bincount(row, model.weights[column] * share, len(label))
    fold = holds if len(set(label[holds].tolist())) == 2 else np.ones(len(label), bool)
    model.slope, model.shift = _platt(logits[fold], label[fold])
    return model


def _descend(label: np.ndarray, row: np.ndarray, column: np.ndarray, share: np.ndarray, used: np.ndarray) -> Model:
    """Logistic regression by adaptive gradient steps over the sparse rows."""
    size, n = 1 << BITS, used.sum()
    weights, bias = np.zeros(size), float(np.log((label[used].sum() + 1) / (n - label[used].sum() + 1)))
    seen, rate = np.full(size, 1e-8), 2.0
    kept = used[row]
    row, column, share = row[kept], column[kept], share[kept]
    for _ in range(40):
        z = bias + np.bincount(row, weights[column] * share, len(label))
        error = np.where(used, _sigmoid(z) - label, 0.0) / n
        slope = np.bincount(column, error[row] * share, size) + 1e-7 * weights
        seen += slope * slope
        weights -= rate * slope / np.sqrt(seen)
        bias -= error.sum()
    return Model(weights, bias)


def _platt(z: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logit by Newton steps, with smoothed labels."""
    ones = label.sum()
    target = np.where(label > 0, (ones + 1) / (ones + 2), 1 / (len(label) - ones + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = _sigmoid(a * z + b)
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(max(a, 0.0)), float(b)


def assess(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, keep_at: float = KEEP_AT) -> DataFrame:
    """Rule counts and the verdict of every whole text.

    Trained on at most ``sample_rows`` labelled quality rows, chosen by the hash of their id. A
    null or empty text has no words and fails the base rules. Repeated rows are assessed each;
    null ids are assessed like others. Only ``doc_id`` and ``text`` are read.
    """
    source = docs.select("doc_id", "text")
    sample = common.label_sample(labels, "quality", F.lit(True), sample_rows)
    model = fit(common.one_text_each(source.join(F.broadcast(sample), "doc_id")))
    weights = docs.sparkSession.sparkContext.broadcast(model)
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, probability double"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.text_slices(batches, "text"):
            counts = rule_counts(part.column("text"))
            chance = weights.value.probabilities(part.column("text"))
            n = counts["n_words"]
            failed = (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEATED * n)
            counts |= {"base_failed": failed, "kept": ~failed & (chance >= keep_at), "probability": chance}
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *map(pa.array, counts.values())], names=["doc_id", *counts]
            )

    return source.mapInArrow(run, schema)
