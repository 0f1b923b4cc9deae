"""Byte-pair encoding and decoding by a dynamic programme over prefixes."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import common

#: Pieces whose ids a worker remembers; the memory is emptied when it is full.
REMEMBERED = 300_000
#: Pieces that are held at once of a very long text.
RUN = 1 << 16

# How the byte-level vocabularies cut a text into pieces.
_PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_ASCII_PIECES = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+"
    r"|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)
_NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, by its rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and the automaton that reports every token a prefix ends with."""

    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.tokens = {i: bytes(letters[c] for c in token) for token, i in ids.items()}
        self.tokens |= {i: content.encode() for content, i in self.special.items()}
        self.joined: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made = dict.fromkeys(self.tokens, -1)
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair, whole = (ids[left], ids[right]), ids[left + right]
            if pair not in self.joined:
                self.joined[pair] = rank
                if whole not in self.parts:
                    self.parts[whole], self.made[whole] = pair, rank
        self.automaton = ahocorasick.Automaton()
        for i, raw in self.tokens.items():
            if len(raw) == 1 or (i in self.parts and self._clean(*self.parts[i], first=False)):
                self.automaton.add_word(raw.decode("latin-1"), (len(raw), i))
        self.automaton.make_automaton()
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.raw = np.empty(max(self.tokens) + 1, object)
        self.raw[list(self.tokens)] = list(self.tokens.values())
        self._fits: dict[tuple[int, int], bool] = {}

    def _clean(self, left: int, right: int, first: bool = True) -> bool:
        """Whether no merge joins bytes of ``left`` with bytes of ``right`` when both are built.

        Goes back in time: the later of the two border tokens is undone until both are bytes; a
        pair that could have merged before one of its halves was used up would have crossed.
        """
        left_used = right_used = _NEVER
        while True:
            rank = self.joined.get((left, right)) if first else None
            first = True
            if rank is not None and rank < left_used and rank <= right_used:
                return False
            if self.made[left] < 0 and self.made[right] < 0:
                return True
            if self.made[left] >= self.made[right]:
                left_used, left = self.made[left], self.parts[left][1]
            else:
                right_used, right = self.made[right], self.parts[right][0]

    def fits(self, left: int, right: int) -> bool:
        key = (left, right)
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            found = self._fits[key] = self._clean(left, right)
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece: the only token that can end each prefix, then the way back."""
        last = [-1] * (len(piece) + 1)
        for end, (length, token) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] < 0:
                begin = end - length
                if not begin or (last[begin] >= 0 and self.fits(last[begin], token)):
                    last[end] = token
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at -= len(self.tokens[last[at]])
        return ids[::-1]

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text that holds no special token, in runs."""
        pattern = _ASCII_PIECES if text.isascii() else _PIECES
        if len(text) < 1 << 20:
            yield pattern.findall(text)
            return
        found = (m.group() for m in pattern.finditer(text))
        while run := list(islice(found, RUN)):
            yield run

    def segments(self, text: str) -> Iterator[tuple[str, int]]:
        """Text between special tokens, with the id of the special token behind it (or -1)."""
        at = 0
        if self.cut is not None:
            for m in self.cut.finditer(text):
                yield text[at : m.start()], self.special[m.group()]
                at = m.end()
        yield text[at:], -1

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.raw[ids]).decode("utf-8", "replace")


class Encoder(dict):
    """Ids of pieces, remembered."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> list[int]:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.vocabulary.encode_piece(piece.encode())
        if len(piece) < 64:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        runs = []
        for part, special in self.vocabulary.segments(text):
            runs += [
                np.fromiter(chain.from_iterable(map(self.__getitem__, run)), np.int32)
                for run in self.vocabulary.pieces(part)
            ]
            if special >= 0:
                runs.append(np.array([special], np.int32))
        return np.concatenate(runs) if runs else np.zeros(0, np.int32)


@functools.lru_cache(maxsize=1)
def _encoder(definition: str) -> Encoder:
    return Encoder(Vocabulary(definition))


def encoded(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` of every whole text.

    ``vocabulary_path`` is a byte-level tokenizer definition that the driver can read; its bounded
    content is broadcast. A null or empty text has no ids and decodes to the empty text. Repeated
    rows and null ids are encoded like others; other columns are not read.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition.value)
        for part in common.text_slices(batches, "text", 1 << 20):
            ids = [encoder.encode(t or "") for t in part.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.ListArray.from_arrays(ends, np.concatenate(ids)),
                    pa.array([encoder.vocabulary.decode(x) for x in ids], pa.string()),
                ],
                names=["doc_id", "ids", "decoded"],
            )

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return encoded(docs, vocabulary_path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        sha(F.col("decoded")).alias("decoded_sha256"),
    )
