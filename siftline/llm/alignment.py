"""Alignment of two tokenizers' tokens by diagonal run skipping, and statistics of the linked id pairs.

Both tokenizers cut the same bytes, so that a token is known by where it ends. Where the two lists of
ends run side by side, one index shift maps one list onto the other: exponential probing compares
longer and longer stretches at the current shift and a bisection finds where the stretch ends. The
irregular group behind it is walked token by token up to the next common end, which gives a new shift.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import common
from siftline.llm.byte_encoding import encoder

#: Parts into which the id pairs are dealt by their A id.
PARTS = 64
#: Slices of text whose pairs one task looks up at most in one part.
SLICES_A_TASK = 2_048
#: Texts of a slice at most; a text is named by two bytes.
SLICE_ROWS = 1 << 16
#: Distinct id pairs that a task counts before it hands them on.
COUNTED = 1 << 21


def group_ends(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """How many A and how many B tokens lie before the end of each group.

    ``a`` and ``b`` are the strictly increasing ends of both lists' tokens, with the same last end.
    """
    starts_a: list[int] = []
    starts_b: list[int] = []
    lengths: list[int] = []
    i = j = 0
    n = len(a)
    while i < n:
        run, step = 0, 1
        while (own := a[i + run : i + run + step]) and own == b[j + run : j + run + step]:
            run += len(own)
            step += step
        if own:  # the stretch ends within these
            while step > 1:
                step >>= 1
                if a[i + run : i + run + step] == b[j + run : j + run + step]:
                    run += step
        if run:
            starts_a.append(i)
            starts_b.append(j)
            lengths.append(run)
            i += run
            j += run
        if i < n:
            x, y = a[i], b[j]
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            starts_a.append(i)
            starts_b.append(j)
            lengths.append(1)
            i += 1
            j += 1
    size = np.array(lengths, np.int64)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + 1
    return tuple(np.repeat(np.array(s, np.int64), size) + within for s in (starts_a, starts_b))


def overlaps(
    ends_a: np.ndarray, ends_b: np.ndarray, groups_a: np.ndarray, groups_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The A and the B token (by place) of every pair of tokens whose byte ranges overlap."""
    in_a, in_b = np.diff(groups_a, prepend=0), np.diff(groups_b, prepend=0)
    odd = (in_a > 1) | (in_b > 1)
    a, b = np.flatnonzero(np.repeat(odd, in_a)), np.flatnonzero(np.repeat(odd, in_b))
    # between two neighbouring ends of either list lies one pair
    cuts = np.unique(np.concatenate([ends_a[a], ends_b[b]]))
    first, second = a[np.searchsorted(ends_a[a], cuts)], b[np.searchsorted(ends_b[b], cuts)]
    return np.concatenate([groups_a[~odd] - 1, first]), np.concatenate([groups_b[~odd] - 1, second])


class Pair:
    """The two tokenizers, the bytes of their tokens and how their ids are written."""

    def __init__(self, definition: str, model: bytes) -> None:
        self.a = encoder(definition, False)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        raw = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.raw = (self.a.raw, np.array(raw, object))
        self.size = tuple(np.array([len(x) for x in own], np.int64) for own in self.raw)
        # an id with what follows it: within a side, and at the end of the A or B side
        self.written = tuple(
            np.array([[f"{i}{sign}".encode() for i in range(len(own))] for sign in (",", last)], object)
            for own, last in zip(self.raw, "|;", strict=True)
        )

    def encoded(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """The ids of both, for each text; none where the text is empty or a side does not give it back."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            whole = " " + text
            a = self.a.ids(whole) if text else []
            raw = whole.encode()
            same = text and b"".join(self.raw[0][a]) == raw and b"".join(self.raw[1][b]) == raw
            out.append((a, b) if same else ([], []))
        return out


@functools.lru_cache(maxsize=1)
def _pair(definition: str, model: bytes) -> Pair:
    return Pair(definition, model)


def _written(pair: Pair, ids: tuple, ends: tuple, cuts: np.ndarray) -> list[bytes]:
    """For each text, its groups ``a1,a2|b1;…``; ``ends``: the groups' ends in tokens, ``cuts``: in groups."""
    out = np.empty(len(ids[0]) + len(ids[1]), object)
    sizes = [np.diff(e, prepend=0) for e in ends]
    before = (ends[1] - sizes[1], ends[0])  # tokens of the other side that come first
    for side in (0, 1):
        last = np.zeros(len(ids[side]), np.int64)
        last[ends[side] - 1] = 1
        place = np.arange(len(ids[side])) + np.repeat(before[side], sizes[side])
        out[place] = pair.written[side][last, ids[side]]
    token_cuts = np.concatenate([[0], ends[0] + ends[1]])[cuts].tolist()
    return [b"".join(out[x:y])[:-1] for x, y in zip(token_cuts, token_cuts[1:], strict=False)]


def _blobs(keys: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """For each part: its pairs, the number of texts of each, these texts, and how often each has the pair.

    ``keys`` are sorted: part, A id, B id and text from the highest bits down.
    """
    parts = keys >> 48
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(keys)]
    for x, y in zip(cuts, cuts[1:], strict=False):
        pairs = (keys[x:y] >> 16) & 0xFFFFFFFF
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        own = times[x:y]
        yield (
            int(parts[x]),
            pairs[first].astype("<u4").tobytes(),
            np.diff(first, append=y - x).astype("<u4").tobytes(),
            (keys[x:y] & 0xFFFF).astype("<u2").tobytes(),
            own.astype("<u1" if own.max() < 256 else "<u4").tobytes(),
        )


def _times(data: bytes, texts: int) -> np.ndarray:
    return np.frombuffer(data, "<u1" if len(data) == texts else "<u4").astype(np.int64)


#: What becomes of a slice: a row for each text, and one for each part that its id pairs fall into.
_FIELDS = (
    ("slice", pa.int64()), ("part", pa.int32()), ("place", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()),
    ("texts_of", pa.binary()), ("texts", pa.binary()), ("times", pa.binary()),
)
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}


def _slice_rows(pair: Pair, texts: list[str]) -> tuple[dict, list[tuple]]:
    """The columns of the texts, and the blobs of their id pairs."""
    found = pair.encoded(texts)
    counts = [np.array([len(x[side]) for x in found], np.int64) for side in (0, 1)]
    ids = tuple(np.array([i for x in found for i in x[side]], np.int64) for side in (0, 1))
    ends = tuple(np.cumsum(pair.size[side][ids[side]]) for side in (0, 1))
    groups = group_ends(ends[0].tolist(), ends[1].tolist())
    tokens = np.cumsum(counts[0])
    cuts = np.concatenate([[0], np.searchsorted(groups[0], tokens, side="right")])
    row = np.repeat(np.arange(len(texts)), counts[0])
    link_a, link_b = overlaps(*ends, *groups)
    a, b = ids[0][link_a], ids[1][link_b]
    keys, times = np.unique((a % PARTS) << 48 | a << 32 | b << 16 | row[link_a], return_counts=True)
    written = _written(pair, ids, groups, cuts)
    columns = {
        "n_a": counts[0], "n_b": counts[1], "n_groups": np.diff(cuts),
        "n_links": np.bincount(row[link_a], minlength=len(texts)),
        "groups_sha256": [hashlib.sha256(w).hexdigest() if w else "" for w in written],
    }
    return columns, list(_blobs(keys, times)) if len(keys) else []


def _sliced(docs: DataFrame, definition_path: str, model_path: str) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    with open(definition_path, encoding="utf-8") as f, open(model_path, "rb") as g:
        files = sc.broadcast((f.read(), g.read()))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*files.value)
        number = TaskContext.get().partitionId() << 32
        for part in common.text_slices(batches, "text"):
            for at in range(0, part.num_rows, SLICE_ROWS):
                own = part.slice(at, SLICE_ROWS)
                columns, blobs = _slice_rows(pair, [t or "" for t in own.column("text").to_pylist()])
                n, m = own.num_rows, len(blobs)
                columns |= {"slice": [number] * n, "part": [-1] * n, "place": range(n)}
                parts, *binary = zip(*blobs, strict=True) if m else [()] * 5
                more = dict(zip(("pairs", "texts_of", "texts", "times"), binary, strict=True))
                more |= {"slice": [number] * m, "part": parts}
                doc_id = own.column("doc_id")
                for rows, given, named in ((n, columns, doc_id), (m, more, pa.nulls(m, doc_id.type))):
                    arrays = [
                        pa.array(given[name], t) if name in given else pa.nulls(rows, t) for name, t in _FIELDS
                    ]
                    yield pa.RecordBatch.from_arrays([named, *arrays], names=["doc_id", *(f for f, _ in _FIELDS)])
                number += 1

    schema = ", ".join([f"doc_id {kind}", *(f"{name} {_SQL[t]}" for name, t in _FIELDS)])
    return docs.mapInArrow(run, schema)


def pair_counts(blobs: DataFrame) -> DataFrame:
    """``part``, ``pair`` and ``n``, how many texts hold it, of every id pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            pairs, n = (np.concatenate(x) for x in zip(*held, strict=True))
            own, place = np.unique(pairs, return_inverse=True)
            return own, np.bincount(place, weights=n, minlength=len(own)).astype(np.int64)

        def out(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            for pairs, n in zip(batch.column("pairs").to_pylist(), batch.column("texts_of").to_pylist(), strict=True):
                held.append((np.frombuffer(pairs, "<u4").astype(np.int64), np.frombuffer(n, "<u4").astype(np.int64)))
                size += len(held[-1][0])
            if size > 2 * COUNTED:
                held = [summed()]
                size = len(held[0][0])
                if size > COUNTED:
                    yield out(*held[0])
                    held, size = [], 0
        if held:
            yield out(*summed())

    counted = blobs.select("pairs", "texts_of").mapInArrow(run, "pair long, n long")
    part = F.shiftright("pair", 16) % PARTS
    return counted.groupBy("pair").agg(F.sum("n").alias("n")).select(part.cast("int").alias("part"), "pair", "n")


def _looked_up(blobs: DataFrame, counts: DataFrame, tasks: int) -> DataFrame:
    """For each slice and part, its texts with the sums over their links in that part.

    A part's counts go first into each of its ``tasks``, then its slices pass by one after another.
    """
    none = {c: F.lit(None).cast("binary").alias(c) for c in ("pairs", "texts_of", "texts", "times")}
    own = blobs.select(
        "part", (F.col("slice") % tasks).cast("int").alias("task"), F.lit(1).alias("turn"), "slice",
        F.lit(None).cast("long").alias("pair"), F.lit(None).cast("long").alias("n"), *none,
    )
    every = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task")
    known = counts.select(
        "part", every, F.lit(0).alias("turn"), F.lit(None).cast("long").alias("slice"), "pair", "n", *none.values()
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        pairs = n = best = np.zeros(0, np.int64)
        for batch in batches:
            group = batch.column("part").to_numpy().astype(np.int64) << 32 | batch.column("task").to_numpy()
            turn = batch.column("turn").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(group << 1 | turn)) + 1).tolist(), len(turn)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                rows = batch.slice(x, y - x)
                if group[x] != at:
                    at, held = group[x], []
                if not turn[x]:
                    held.append((rows.column("pair").to_numpy(), rows.column("n").to_numpy()))
                    continue
                if held:
                    pairs, n = (np.concatenate(c) for c in zip(*held, strict=True))
                    order = np.argsort(pairs)
                    pairs, n, held = pairs[order], n[order], []
                    first = np.flatnonzero(np.diff(pairs >> 16, prepend=-1))
                    most = np.maximum.reduceat(n, first)
                    best = n == np.repeat(most, np.diff(first, append=len(n)))
                yield summed(rows, pairs, n, best)

    def summed(rows: pa.RecordBatch, pairs: np.ndarray, n: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
        out: list[list[bytes]] = [[], [], []]
        blobs = (rows.column(c).to_pylist() for c in ("pairs", "texts_of", "texts", "times"))
        for own, texts_of, texts, times in zip(*blobs, strict=True):
            place = np.searchsorted(pairs, np.frombuffer(own, "<u4"))
            place = np.repeat(place, np.frombuffer(texts_of, "<u4"))
            row = np.frombuffer(texts, "<u2").astype(np.int64)
            times = _times(times, len(row))
            order = np.argsort(row, kind="stable")
            first = np.flatnonzero(np.diff(row[order], prepend=-1))
            out[0].append(row[order][first].astype("<u2").tobytes())
            for column, value in zip(out[1:], (best[place] * times, n[place] * times), strict=True):
                column.append(np.add.reduceat(value[order], first).astype("<i8").tobytes())
        columns = [rows.column("slice"), *(pa.array(c, pa.binary()) for c in out)]
        return pa.RecordBatch.from_arrays(columns, names=["slice", "texts", "n_best", "count_sum"])

    rows = known.unionByName(own).repartition(PARTS * tasks, "part", "task")
    rows = rows.sortWithinPartitions("part", "task", "turn")
    return rows.mapInArrow(run, "slice long, texts binary, n_best binary, count_sum binary")


def _summed(looked_up: DataFrame) -> DataFrame:
    """``slice``, ``place``, ``n_best`` and ``count_sum``: the parts of each slice summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, np.zeros((2, SLICE_ROWS), np.int64)
        for batch in batches:
            for slice_id, texts, best, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if slice_id != at:
                    if at is not None:
                        yield out(at, sums)
                    at = slice_id
                    sums[:] = 0
                row = np.frombuffer(texts, "<u2")
                sums[0, row] += np.frombuffer(best, "<i8")
                sums[1, row] += np.frombuffer(count, "<i8")
        if at is not None:
            yield out(at, sums)

    def out(slice_id: int, sums: np.ndarray) -> pa.RecordBatch:
        place = np.flatnonzero(sums[1])
        columns = [np.full(len(place), slice_id), place.astype(np.int32), sums[0, place], sums[1, place]]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["slice", "place", "n_best", "count_sum"])

    dealt = looked_up.repartition("slice").sortWithinPartitions("slice")
    return dealt.mapInArrow(run, "slice long, place int, n_best long, count_sum long")


def aligned(docs: DataFrame, definition_path: str, model_path: str) -> DataFrame:
    """Both tokenizers' tokens of every whole text, their groups and links, and the links' corpus-wide counts.

    Returns ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and
    ``groups_sha256``. Both files are read by the driver and broadcast; their size is fixed. A null or
    empty text, and one that a tokenizer does not give back byte for byte, has no tokens: zeros and an
    empty digest. Repeated rows and null ids are rows like others; other columns are not read.

    Texts are encoded once. A slice of texts leaves as one small table for each of ``PARTS`` parts of its
    id pairs; the pair counts come from these, and are looked up where the tables of a part meet them, so
    that nothing is broadcast and no pair of a text is a row of its own.
    """
    rows = common.stored(_sliced(docs.select("doc_id", "text"), definition_path, model_path), "aligned")
    blobs = rows.where("part >= 0").select("slice", "part", "pairs", "texts_of", "texts", "times")
    counts = common.stored(pair_counts(blobs), "pair-counts")
    slices = rows.where("place = 0").count()
    sums = _summed(_looked_up(blobs, counts, max(1, -(-slices // SLICES_A_TASK))))
    texts = rows.where("part < 0").join(sums, ["slice", "place"], "left")
    return texts.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), "groups_sha256",
    )
