"""Near-duplicate vectors by an inverted multi-index: a product grid of two codebooks, walked cell by cell.

Each half of a normalised vector has a codebook of its own; a vector lies in the cell of its two nearest
codes. The other cells are visited in the order of a lower bound of their distance (multi-sequence
traversal of two sorted lists of half distances) until the bound reaches what the target recall takes.
What meets in a cell is verified in double precision.

Vectors that lie close together are one unit before anything is shuffled: all pairs of a unit are links by
the triangle inequality of angles, and two units mostly link whole or not at all. So a crowd of near
copies stays a few rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import common
from siftline.llm.links import components

#: Cosine from which two vectors link.
NEAR = 0.98
#: Share of links at the limit that the visited cells must hold; measured when the index is fitted.
TARGET_RECALL = 0.999
#: Vectors that the codebooks are fitted on at most, and rounds of their fit.
SAMPLE_ROWS, ROUNDS = 16_384, 12
#: Units that a cell should hold, and codes of a half at most.
CELL_UNITS, MOST_CODES = 1_024, 512
#: Units of a cell that go to a task together, and those that are held against each other at once.
BLOCK, TILE = 4_096, 1_024
#: Vectors that a task puts into units at once, and the share of the linking angle that a unit reaches.
UNIT_ROWS, UNIT_SHARE = 4_096, 0.125


@dataclass
class Index:
    """The codebooks of both halves, for vectors of one length."""

    codes: tuple[np.ndarray, np.ndarray]
    between: tuple[np.ndarray, np.ndarray]  # distances between the codes of a half
    reach: float  # the largest squared lower bound that is visited

    def bounds(self, vectors: np.ndarray) -> list[np.ndarray]:
        """For each half, the squared lower bound of the distance of each vector to each code's region."""
        half = vectors.shape[1] // 2
        out = []
        for part, codes, between in zip((vectors[:, :half], vectors[:, half:]), self.codes, self.between, strict=True):
            far = np.maximum(_squared(part, codes), 0)
            own = far.argmin(axis=1)
            rows = np.arange(len(part))
            # how far it is to the plane between the own code and the other
            gap = (far - far[rows, own][:, None]) / np.maximum(2 * between[own], 1e-12)
            gap[rows, own] = 0
            out.append(gap * gap)
        return out

    def cell(self, i: int, j: int) -> int:
        return i * len(self.codes[1]) + j


def _squared(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(axis=1)[None]


def nearest_cells(first: np.ndarray, second: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """The cells whose bounds add up to ``reach`` at most, nearest first, by multi-sequence traversal."""
    a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    out, seen = [], {(0, 0)}
    heap = [(float(first[a[0]] + second[b[0]]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        if bound > reach:
            break
        out.append((a[i], b[j]))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (float(first[a[x]] + second[b[y]]), x, y))
    return out


def _codebook(part: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    codes = part[rng.choice(len(part), n, replace=False)]
    for _ in range(ROUNDS):
        own = _squared(part, codes).argmin(axis=1)
        size = np.bincount(own, minlength=n)
        sums = np.zeros_like(codes)
        np.add.at(sums, own, part)
        codes = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], codes)
    return np.unique(codes, axis=0)


def fit(sample: np.ndarray, rows: int, near: float = NEAR, recall: float = TARGET_RECALL) -> Index:
    """Codebooks of normalised vectors, and the bound that holds ``recall`` of partners at the limit.

    The grid's size follows the number of rows. Partners are drawn at the largest angle that two units with
    a link can have; one of the two must find the cell of the other among the cells with smaller numbers.
    """
    rng = np.random.default_rng(7)
    n = 1 << max(0, round(math.log2(max(1.0, rows / CELL_UNITS)) / 2))
    n = max(1, min(n, MOST_CODES, len(sample) // 8))
    half = sample.shape[1] // 2
    codes = tuple(_codebook(part, n, rng) if part.shape[1] else part[:1] for part in (sample[:, :half], sample[:, half:]))
    index = Index(codes, tuple(np.sqrt(np.maximum(_squared(c, c), 0)) for c in codes), 0.0)
    if n == 1:
        return index
    angle = math.acos(near) * (1 + 2 * UNIT_SHARE)
    tried = sample[rng.choice(len(sample), min(len(sample), 4_096), replace=False)]
    aside = rng.normal(size=tried.shape)
    aside -= (aside * tried).sum(axis=1)[:, None] * tried
    aside /= np.maximum(np.linalg.norm(aside, axis=1), 1e-12)[:, None]
    partner = math.cos(angle) * tried + math.sin(angle) * aside
    bounds, other = index.bounds(tried), index.bounds(partner)
    own = np.arange(len(tried))
    needed = sum(b[own, o.argmin(axis=1)] for b, o in zip(bounds, other, strict=True))
    index.reach = float(min(np.quantile(needed, recall), (2 * math.sin(angle / 2)) ** 2))
    return index


def _normalised(embedding: np.ndarray) -> np.ndarray:
    x = embedding.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """A row for each list; the lists are of one length and hold no nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _alike(x: np.ndarray, y: np.ndarray, near: float) -> np.ndarray:
    """Which normalised rows are links; products at the limit are summed exactly."""
    cosines = x @ y.T
    links = cosines >= near
    for i, j in zip(*np.nonzero(np.abs(cosines - near) < 1e-13), strict=True):
        links[i, j] = math.fsum((x[i] * y[j]).tolist()) >= near
    return links


def _classes(vectors: DataFrame) -> DataFrame:
    """One row for each label and distinct vector: ``id`` (the smallest), ``copies``, label and vector.

    Only vectors that may link: with a label and an id, without null, not finite and without length.
    """
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (
        vectors.where("vec_id is not null and label is not null and embedding is not null")
        .where(finite & F.exists("embedding", lambda v: v != 0))
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    )


def _runs(values: list) -> list[tuple[int, int]]:
    """The begin and end of every run of equal values."""
    cuts = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
    return list(zip(cuts, cuts[1:], strict=False)) if values else []


def _units(classes: DataFrame, near: float) -> DataFrame:
    """The classes with a number (``node``) and that of the leader of their unit (``unit``).

    ``weight`` counts the vectors of a leader's unit and ``radius`` is its largest angle; other rows have
    none. A leader takes in what lies within a fixed share of the linking angle, among the rows that a
    task holds at once; so all pairs of a unit link.
    """
    most = math.cos(math.acos(near) * UNIT_SHARE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, UNIT_ROWS):
                part = batch.slice(at, UNIT_ROWS)
                n = part.num_rows
                copies = part.column("copies").to_numpy()
                lengths = part.column("embedding").value_lengths().to_pylist()
                groups: dict[tuple, list[int]] = {}
                for row, key in enumerate(zip(part.column("label").to_pylist(), lengths, strict=True)):
                    groups.setdefault(key, []).append(row)
                unit, weight, radius = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
                for rows in map(np.array, groups.values()):
                    x = _normalised(_matrix(part.column("embedding").take(pa.array(rows))))
                    close = x @ x.T >= most
                    left = np.ones(len(rows), bool)
                    for i in range(len(rows)):
                        if left[i]:
                            close[i, i] = True
                            own = np.flatnonzero(close[i] & left)
                            left[own] = False
                            unit[rows[own]] = rows[i]
                            weight[rows[i]] = copies[rows[own]].sum()
                            chord = np.sqrt(((x[own] - x[i]) ** 2).sum(axis=1)).max()
                            radius[rows[i]] = 2 * math.asin(min(1.0, chord / 2))
                extra = {"node": number + np.arange(n), "unit": number + unit, "weight": weight, "radius": radius}
                names = [*part.schema.names, *extra]
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, extra.values())], names=names)
                number += n

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields)
    return classes.mapInArrow(run, f"{schema}, node long, unit long, weight long, radius double")


def fitted(leaders: DataFrame, near: float, recall: float) -> dict[int, Index]:
    """An index for each common length of vectors, fitted on a bounded sample."""
    rows = leaders.count()
    drawn = leaders.orderBy(F.xxhash64("unit"), "unit").limit(SAMPLE_ROWS).select("embedding").toArrow()
    by_length: dict[int, list] = {}
    for v in drawn["embedding"].to_pylist():
        by_length.setdefault(len(v), []).append(v)
    return {
        n: fit(_normalised(np.array(v)), rows * len(v) // len(drawn), near, recall)
        for n, v in by_length.items()
        if len(v) >= 64
    }


def _placed(leaders: DataFrame, near: float, recall: float) -> DataFrame:
    """A row for each cell that a unit lies in (``home``) or visits; only cells before its own are visited.

    So two units meet once. Vectors of a length without an index share one cell.
    """
    shared = leaders.sparkSession.sparkContext.broadcast(fitted(leaders, near, recall))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("embedding").value_lengths().to_numpy()
            for length in np.unique(lengths).tolist():
                part = batch.take(pa.array(np.flatnonzero(lengths == length)))
                index = shared.value.get(length)
                place, cell = list(range(part.num_rows)), [0] * part.num_rows
                home = [True] * part.num_rows
                if index is not None:
                    place, cell, home = [], [], []
                    for row, bounds in enumerate(zip(*index.bounds(_normalised(_matrix(part.column("embedding")))), strict=True)):
                        first, *others = (index.cell(*x) for x in nearest_cells(*bounds, index.reach))
                        visited = [first, *(c for c in others if c < first)]
                        place += [row] * len(visited)
                        cell += visited
                        home += [True] + [False] * (len(visited) - 1)
                rows = part.take(pa.array(place, pa.int64()))
                extra = {"length": [length] * len(place), "cell": cell}
                columns = [*rows.columns, *(pa.array(c, pa.int32()) for c in extra.values()), pa.array(home, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[*rows.schema.names, *extra, "home"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in leaders.schema.fields)
    return leaders.mapInArrow(run, f"{schema}, length int, cell int, home boolean")


def _meetings(placed: DataFrame) -> DataFrame:
    """The rows of each cell dealt into meetings ``x``, ``y`` of two blocks of bounded size.

    A block of those at home meets itself and the later ones, and every block of visitors (``y`` below
    zero), so that a crowded cell spans many tasks. A row goes to all meetings of its block.
    """
    keys = ["label", "length", "cell"]
    sizes = placed.groupBy(*keys).agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests"))
    sizes = sizes.where("homes > 0 and homes + guests > 1").select(
        *keys, *(F.expr(f"cast(ceil({c} / {BLOCK}) as int)").alias(c) for c in ("homes", "guests"))
    )
    rows = placed.join(common.stored(sizes, "cells"), keys).withColumn(
        "at", F.expr("cast(pmod(xxhash64(unit), if(home, homes, guests)) as int)")
    )
    meetings = F.expr("""
        if(home,
           concat(transform(sequence(0, homes - 1), k -> struct(least(at, k) as x, greatest(at, k) as y)),
                  transform(if(guests > 0, sequence(0, guests - 1), array()), k -> struct(at as x, -1 - k as y))),
           transform(sequence(0, homes - 1), k -> struct(k as x, -1 - at as y)))
    """)
    rows = rows.withColumn("meeting", F.explode(meetings))
    order = [*keys, "x", "y"]
    rows = rows.select(*keys, "meeting.*", "home", "at", "unit", "weight", "radius", "embedding")
    return rows.repartition(*order).sortWithinPartitions(*order)


def _components(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest node (rows first, then columns) that each row and each column reaches over the links."""
    rows, columns = np.arange(links.shape[0]), links.shape[0] + np.arange(links.shape[1])
    none = sum(links.shape)
    while True:
        before = rows, columns
        rows = np.minimum(rows, np.where(links, columns[None], none).min(axis=1, initial=none))
        columns = np.minimum(columns, np.where(links, rows[:, None], none).min(axis=0, initial=none))
        if (rows == before[0]).all() and (columns == before[1]).all():
            return rows, columns


def _found(links: np.ndarray, a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For every row and column with a link: one that it is connected with, and how many vectors it links with."""
    names = np.concatenate([a, b])
    for own, root, weights, there in zip((a, b), _components(links), (wb, wa), (links, links.T), strict=True):
        rows = np.flatnonzero(there.any(axis=1))
        if len(rows):
            yield _batch(own[rows], names[root[rows]], there[rows] @ weights, 0)


def _batch(a: np.ndarray, b: np.ndarray, n: np.ndarray, kind: int) -> pa.RecordBatch:
    columns = [a, b, n.astype(np.int64), np.full(len(a), kind, np.int32)]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["a", "b", "n", "kind"])


def _by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of each key; rows of a key follow each other."""
    key, held = None, []
    for batch in batches:
        own = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
        for x, y in _runs(own):
            if own[x] != key:
                if held:
                    yield key, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                key, held = own[x], []
            held.append(batch.slice(x, y - x))
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _met(placed: DataFrame, near: float) -> DataFrame:
    """What the units find in their cells.

    ``kind`` 0: ``a`` links with ``n`` vectors and is connected with ``b``; ``kind`` 1: the vectors of ``a``
    and ``b`` must be held against each other one by one.
    """
    limit = math.acos(near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (*_, x, y), rows in _by_key(batches, ["label", "length", "cell", "x", "y"]):
            home, at = rows.column("home").to_numpy(zero_copy_only=False), rows.column("at").to_numpy()
            vectors = _normalised(_matrix(rows.column("embedding")))
            unit, weight, radius = (rows.column(c).to_numpy() for c in ("unit", "weight", "radius"))
            first = np.flatnonzero(home & (at == x))
            second = np.flatnonzero(home & (at == y) if y >= 0 else ~home)
            for i in range(0, len(first), TILE):
                for j in range(i if x == y else 0, len(second), TILE):
                    a, b = first[i : i + TILE], second[j : j + TILE]
                    links = _alike(vectors[a], vectors[b], near)
                    unsure = np.zeros_like(links)
                    spread = radius[a][:, None] + radius[b][None]
                    if spread.any():
                        angle = np.arccos(np.clip(vectors[a] @ vectors[b].T, -1, 1))
                        links = np.where(spread > 0, angle + spread <= limit - 1e-7, links)
                        unsure = (spread > 0) & ~links & (angle - spread <= limit + 1e-7)
                    if x == y and i == j:
                        links, unsure = np.triu(links, 1), np.triu(unsure, 1)
                    yield from _found(links, unit[a], unit[b], weight[a], weight[b])
                    p, q = np.nonzero(unsure)
                    if len(p):
                        yield _batch(unit[a][p], unit[b][q], np.zeros(len(p)), 1)

    return _meetings(placed).mapInArrow(run, "a long, b long, n long, kind int")


def _one_by_one(unsure: DataFrame, units: DataFrame, near: float) -> DataFrame:
    """The links between the vectors of two units that neither link whole nor lie apart; rows as of kind 0."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("unit")), F.struct(F.lit(1).alias("side"), F.col("b").alias("unit")))
    rows = unsure.select("a", "b", F.explode(sides).alias("x")).select("a", "b", "x.*")
    rows = rows.join(units.select("unit", "node", "copies", "embedding"), "unit")
    rows = rows.repartition("a", "b").sortWithinPartitions("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _by_key(batches, ["a", "b"]):
            side = own.column("side").to_numpy()
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            vectors = _normalised(_matrix(own.column("embedding")))
            node, copies = own.column("node").to_numpy(), own.column("copies").to_numpy()
            for i in range(0, len(a), TILE):
                for j in range(0, len(b), TILE):
                    p, q = a[i : i + TILE], b[j : j + TILE]
                    yield from _found(_alike(vectors[p], vectors[q], near), node[p], node[q], copies[p], copies[q])

    return rows.mapInArrow(run, "a long, b long, n long, kind int")


def near_vectors(vectors: DataFrame, near: float = NEAR, recall: float = TARGET_RECALL) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row of ``vec_id``, ``label``, ``embedding``.

    Two vectors link if their labels are equal and their cosine is ``near`` (above zero) or more, in double
    precision, and the index lets them meet: ``recall`` of the links at the limit and more of the others; none
    below it. Vectors of different lengths never link. A row without a label or whose vector is null, zero or
    holds null or not finite components links with nothing and is its own component; one without an id has
    no component and is not kept. Rows that repeat an id count as vectors each. An empty table gives no rows.
    """
    source = vectors.select("vec_id", "label", "embedding")
    if source.schema["embedding"].dataType.simpleString() != "array<float>":
        source = source.withColumn("embedding", F.col("embedding").cast("array<double>"))
    units = common.stored(_units(_classes(source), near), "vector-units")
    leaders = units.where("node = unit").select("label", "embedding", "unit", "weight", "radius")
    met = common.stored(_met(_placed(leaders, near, recall), near), "vector-links")
    single = common.stored(_one_by_one(met.where("kind = 1"), units, near), "vector-pairs")
    whole = met.where("kind = 0")
    found = whole.union(single)
    own = units.where("node <> unit").select(F.col("node").alias("a"), F.col("unit").alias("b"))
    parts = components(found.select("a", "b").union(own))
    rows = units.select("label", "embedding", "node", "unit", "id")
    of_unit = whole.groupBy(F.col("a").alias("unit")).agg(F.sum("n").alias("by_unit"))
    of_node = single.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("by_node"))
    size = units.where("node = unit").select("unit", "weight")
    rows = rows.join(size, "unit").join(of_unit, "unit", "left").join(of_node, "node", "left").join(parts, "node", "left")
    rows = rows.withColumn("component", F.coalesce("component", "node"))
    rows = rows.withColumn("n", F.expr("weight - 1 + coalesce(by_unit, 0) + coalesce(by_node, 0)"))
    rows = common.stored(rows.select("label", "embedding", "id", "component", "n"), "vector-classes")
    least = rows.groupBy("component").agg(F.min("id").alias("component_id"))
    named = rows.join(common.stored(least, "vector-components"), "component").select("label", "embedding", "n", "component_id")
    out = source.join(named, ["label", "embedding"], "left")
    has_id = F.col("vec_id").isNotNull()
    component = F.when(has_id, F.coalesce("component_id", "vec_id"))
    return out.select(
        "vec_id", F.when(has_id, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
