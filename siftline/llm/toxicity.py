"""Toxicity of texts whose disguises are undone first by a noisy-channel decoder."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm import common
from siftline.llm.quality_rules import _sigmoid

#: Labelled rows that the terms and the calibration are fitted on at most.
SAMPLE_ROWS = 9_000
#: Terms kept at most, their least count of toxic documents, least evidence and least weight.
MAX_TERMS = 2_000
MIN_DOCUMENTS = 5
MIN_EVIDENCE = 25.0
MIN_WEIGHT = 1.3
#: Lengths of the word beginnings that are terms besides whole words.
STEMS = (3, 4, 5, 6, 7, 8)
#: Score from which a document counts as toxic.
TOXIC_AT = 0.3
#: Score of every text where the labels do not hold both kinds.
UNKNOWN = 0.1
#: Decoded tokens a worker remembers.
REMEMBERED = 200_000

# The letters that a character is written for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e",
}
_LETTER = r"[^\W\d_]"
_SIGN = r"[0-9@$!|+(€]"
#: Tokens that may be disguised: single letters and signs spaced out, signs or breaks at letters, a letter three times.
#: Runs are taken whole and never entered in the middle, so that the time is linear in their length.
SUSPECT = re.compile(
    rf"(?<![^\W_])(?:(?:{_LETTER}|{_SIGN})(?:[ .\-_*]++(?:{_LETTER}|{_SIGN})){{2,}})(?![^\W_])"
    rf"|(?<![^\W_])(?:(?<!{_SIGN}){_SIGN}++(?={_LETTER})|{_LETTER}++(?:{_SIGN}|[.\-_*]++(?={_LETTER})))"
    rf"(?:{_LETTER}|{_SIGN}|[.\-_*]++(?=[^\W_]))*+"
    rf"|(?<![^\W_])(?:{_LETTER}*({_LETTER})\1\1{_LETTER}*)"
)

#: Symbols of the character model: 0 is any break, 1-26 are a-z, the others share 37 places.
SYMBOLS = 64
_CODES = np.zeros(0x3000, np.int64)
for _c in range(0x3000):
    if chr(_c).isalpha():
        _CODES[_c] = 1 + _c - 97 if 97 <= _c < 123 else 27 + _c % 37
_KEEP, _SIGN_COST, _DROP, _STUTTER = 0.0, 0.7, 0.2, 0.1
# what a sign or a break costs that stays as it is: the first of several, and each that follows
_STAY, _STAY_ON = 2.0, 0.2


def symbol(c: str) -> int:
    return int(_CODES[ord(c)]) if ord(c) < 0x3000 else 27 + ord(c) % 37 if c.isalpha() else 0


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all letter trigrams of all whole texts, as a cube; its size does not grow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for part in common.text_slices(batches, "text"):
            text = "\n\n".join(["", *(t.lower() for t in part.column("text").to_pylist() if t), ""])
            points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
            codes = np.where(points < 0x3000, _CODES[np.minimum(points, 0x2FFF)], 27 + points % 37)
            total += np.bincount((codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:], minlength=SYMBOLS**3)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["gram", "n"])

    counts = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    cube = np.zeros(SYMBOLS**3)
    rows = counts.toArrow()  # at most SYMBOLS ** 3 rows
    cube[np.asarray(rows["gram"])] = np.asarray(rows["n"])
    return cube.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


class Decoder:
    """The likeliest plain spelling of a disguised token under the character model."""

    def __init__(self, cube: np.ndarray) -> None:
        pair = cube.sum(axis=0)
        single = pair.sum(axis=0)
        smooth = (single + 1) / (single.sum() + SYMBOLS)
        smooth = (pair + 20 * smooth) / (pair.sum(axis=1, keepdims=True) + 20)
        likely = (cube + 20 * smooth[None]) / (cube.sum(axis=2, keepdims=True) + 20)
        self.cost = -np.log(likely)
        self._known: dict[str, str] = {}

    def __call__(self, token: str) -> str:
        found = self._known.get(token)
        if found is None:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            found = self.decode(token)
            if len(token) < 64:
                self._known[token] = found
        return found

    def decode(self, token: str) -> str:
        """Viterbi over the lattice of keeps, sign readings, dropped breaks and dropped repeats.

        A sign or break may stay as it is and then ends a word, so that the model spares plain tokens
        and an opening bracket. A state is the last two characters; ties go to the state found first.
        """
        cost = self.cost
        states: dict[tuple[str, str], tuple[float, tuple | None]] = {("", ""): (0.0, None)}
        for at, c in enumerate(token):
            if c.isalpha():
                readings, drop = ((c, _KEEP),), None
            elif c in LEET:
                readings, drop = tuple((x, _SIGN_COST) for x in LEET[c]), 6.0
            else:
                readings, drop = (), _DROP
            after: dict[tuple[str, str], tuple[float, tuple | None]] = {}
            for (a, b), (paid, path) in states.items():
                for letter, extra in readings:
                    price = paid + extra + cost[symbol(a) if a else 0, symbol(b) if b else 0, symbol(letter)]
                    if (b, letter) not in after or price < after[b, letter][0]:
                        after[b, letter] = (price, (path, letter))
                    if letter == b and at:
                        price = paid + extra + _STUTTER
                        if (a, b) not in after or price < after[a, b][0]:
                            after[a, b] = (price, path)
                if drop is not None:
                    # signs that stay after another, or in front, are one break
                    within = b and symbol(b)
                    price = paid + (_STAY + cost[symbol(a) if a else 0, symbol(b), 0] if within else _STAY_ON)
                    price += 0 if within or b or c == "(" else _STAY - _STAY_ON
                    if (b, c) not in after or price < after[b, c][0]:
                        after[b, c] = (price, (path, c))
                if drop is not None and (not readings or at in (0, len(token) - 1)):
                    price = paid + drop
                    if (a, b) not in after or price < after[a, b][0]:
                        after[a, b] = (price, path)
            states = after
        ends = {
            key: paid + (cost[symbol(key[0]) if key[0] else 0, symbol(key[1]), 0] if key[1] and symbol(key[1]) else 0.0)
            for key, (paid, _) in states.items()
        }
        path, letters = states[min(ends, key=ends.get)][1], []
        while path is not None:
            path, letter = path
            letters.append(letter)
        return "".join(reversed(letters))

    def restored(self, text: str) -> str:
        """The text in lower case with its disguised tokens spelled out."""
        return SUSPECT.sub(lambda m: self(m.group()) if any(map(str.isalpha, m.group())) else m.group(), text.lower())


EVIDENCE = ("found", "most", "sum", "size")
_WORD = re.compile(rf"{_LETTER}+")


def _terms(text: str) -> set[str]:
    """Whole words (between spaces) and word beginnings of a restored text."""
    found = set()
    for word in set(_WORD.findall(text)):
        found.add(f" {word} ")
        found.update(f" {word[:n]}" for n in STEMS if len(word) > n)
    return found


@dataclass
class Model:
    """Terms with their log odds, found by one automaton, and the calibration of their sums."""

    weights: dict[str, float]
    decoder: Decoder
    curve: np.ndarray = field(default_factory=lambda: np.zeros(5))

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        by_stem: dict[str, list[tuple[bool, float]]] = {}
        for term, weight in self.weights.items():
            by_stem.setdefault(term.strip(), []).append((term.endswith(" "), weight))
        for stem, kinds in by_stem.items():
            made.add_word(stem, (len(stem), kinds))
        made.make_automaton()
        return made

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def evidence(self, text: str) -> tuple[float, float, float, float]:
        """Whether a term was found, the largest weight, the sum over distinct words, the log of the length.

        The length counts only where a term was found: longer texts hold more by chance.
        """
        if not text or not self.weights:
            return 0.0, 0.0, 0.0, 0.0
        restored = self.decoder.restored(text)
        words: dict[tuple[str, int], float] = {}
        size = len(restored)
        for end, (length, kinds) in self.automaton.iter(restored):
            begin = end - length + 1
            if begin and restored[begin - 1].isalpha():
                continue
            whole = end + 1 == size or not restored[end + 1].isalpha()
            for exact, weight in kinds:
                if exact == whole:
                    stop = end + 1
                    while not whole and stop < size and restored[stop].isalpha():
                        stop += 1
                    word = restored[begin:stop]
                    words[word] = max(weight, words.get(word, 0.0))
        if not words:
            return 0.0, 0.0, 0.0, 0.0
        return 1.0, max(words.values()), sum(words.values()), float(np.log1p(size))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return _sigmoid(np.hstack([evidence, np.ones((len(evidence), 1))]) @ self.curve)


def _learn_terms(sample: DataFrame, decoder: Decoder) -> dict[str, float]:
    """Terms that documents of label 1 hold far oftener, by the likelihood ratio of their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for part in common.text_slices(batches, "text"):
            for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True):
                for term in _terms(decoder.restored(text or "")):
                    counts.setdefault(term, [0, 0])[int(label)] += 1
            if len(counts) > 500_000:
                yield batch(counts)
                counts = {}
        yield batch(counts)

    def batch(counts: dict[str, list[int]]) -> pa.RecordBatch:
        columns = [list(counts), [v[1] for v in counts.values()], [v[0] for v in counts.values()]]
        kinds = (pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["term", "ones", "zeros"]
        )

    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    ones, zeros = sizes.get(1.0, 0), sizes.get(0.0, 0)
    if not ones or not zeros:
        return {}
    a, b = F.col("ones") + 0.5, F.col("zeros") + 0.5
    p, q, r = a / (ones + 1), b / (zeros + 1), (a + b) / (ones + zeros + 2)
    gain = a * F.log(p / r) + b * F.log(q / r)
    gain += (ones + 1 - a) * F.log((1 - p) / (1 - r)) + (zeros + 1 - b) * F.log((1 - q) / (1 - r))
    terms = (
        sample.select("text", "label")
        .mapInArrow(run, "term string, ones long, zeros long")
        .groupBy("term")
        .agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
        .where(F.col("ones") >= MIN_DOCUMENTS)
        .select("term", F.log(p / q).alias("weight"), (2 * gain).alias("gain"))
        .where((F.col("weight") >= MIN_WEIGHT) & (F.col("gain") >= MIN_EVIDENCE))
    )
    best = terms.orderBy(F.desc("gain"), "term").limit(MAX_TERMS).collect()
    return {t["term"]: t["weight"] for t in best}


def _evidence(docs: DataFrame, model, keep: list[str]) -> DataFrame:
    """``keep`` columns and the evidence of every whole text; ``model`` is a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.text_slices(batches, "text"):
            found = np.array([model.value.evidence(t or "") for t in part.column("text").to_pylist()])
            columns = [*(part.column(c) for c in keep), *map(pa.array, found.T), pa.array(model.value.score(found))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *EVIDENCE, "score"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, " + ", ".join(f"{c} double" for c in (*EVIDENCE, "score")))


def _calibrated(rows: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Logistic regression on the evidence by Newton steps."""
    x = np.hstack([rows, np.ones((len(rows), 1))])
    curve = np.zeros(5)
    ridge = np.diag([1e-2, 1e-2, 1e-2, 1e-2, 1e-4])
    for _ in range(50):
        p = _sigmoid(x @ curve)
        w = np.maximum(p * (1 - p), 1e-6)
        curve -= np.clip(np.linalg.solve((x.T * w) @ x + ridge, x.T @ (p - label) + ridge @ curve), -2, 2)
    return curve


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str, sample_rows: int) -> Model:
    """The character model of all documents, terms and calibration from a bounded labelled sample.

    Two thirds of the sample give the terms, one third the calibration. Without rows of both labels
    nothing can be told apart: every text has the score ``UNKNOWN``, below the threshold.
    """
    source = docs.select("doc_id", "text")
    decoder = Decoder(trigram_counts(source))
    chosen = common.label_sample(labels, label, train, sample_rows)
    sample = common.one_text_each(source.join(F.broadcast(chosen), "doc_id"))
    sample = common.stored(sample, "toxicity-sample")
    part = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(3))
    model = Model(_learn_terms(sample.where(part != 0), decoder), decoder)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = _evidence(sample.where(part == 0), shared, ["label"]).toArrow()
    marks = np.asarray(rows["label"], float)
    if len(set(marks.tolist())) == 2:
        found = np.stack([np.asarray(rows[c]) for c in EVIDENCE], axis=1)
        model.curve = _calibrated(found, marks)
    else:
        model.curve = np.array([0, 0, 0, 0, np.log(UNKNOWN / (1 - UNKNOWN))])
    return model


def scored(
    docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``doc_id`` and ``score`` (probability of label 1) of every whole text.

    A null or empty text has no evidence and gets the score that goes with none. Repeated rows are
    scored each; null ids are scored and never learnt from. Only ``doc_id`` and ``text`` are read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, train, label, sample_rows))
    return _evidence(docs, model, ["doc_id"]).select("doc_id", "score")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores and predictions; ids whose remainder is 2 are held out (a null id is not)."""
    rest = common.remainder(F.col("doc_id"), 4)
    return scored(docs, labels, rest != 2).select(
        "doc_id",
        F.coalesce(rest == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"),
    )


def kept(docs: DataFrame, labels: DataFrame, below: float = TOXIC_AT) -> DataFrame:
    """The documents, all columns, whose score lies below the threshold; learns from all labels."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, F.lit(True), "toxic", SAMPLE_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.text_slices(batches, "text"):
            found = np.array([model.value.evidence(t or "") for t in part.column("text").to_pylist()])
            yield part.filter(pa.array(model.value.score(found) < below))

    return docs.mapInArrow(run, docs.schema)
