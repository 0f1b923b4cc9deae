"""Document fingerprints by a randomised edit embedding, bit-sampled, banded and verified.

Every text is walked with the same random bits: at step t the walk stays on its character or moves to
the next one, as a shared bit for (t, character) says. Two texts that differ by an edit drift apart
there and fall into step again, so the edit distance becomes a Hamming distance of the embedded
strings. A fingerprint samples the embedded string at shared places, one in each cell of a length
that doubles with the text's, so that the finer sample holds the coarser one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siftline.llm import common
from siftline.llm.links import components

#: Least samples of a text that is long enough; up to twice as many are taken.
SAMPLES = 64
#: Steps after which the shared random bits repeat.
PERIOD = 1 << 12
#: Likeness from which two fingerprints count as near.
NEAR = 0.8
#: Classes of a band that are held against each other at once; more are told apart by their rarest blocks.
HOT_BAND = 64
#: Cells of a block.
BLOCK = 2
#: Counters that put blocks in order of how often they are held; blocks that share one only meet more often.
COUNTERS = 1 << 18
#: Rows drawn for each range to find where the ranges end.
CUT_SAMPLES = 64
#: Rows that still walk side by side; fewer walk on one by one.
SIDE_BY_SIDE = 24
#: Characters that are embedded at once.
SLICE_CHARS = 2 << 20

_CLASSES = 256


def _gaps() -> np.ndarray:
    """Steps that a character class stays from each step on, until its bit says to move."""
    bits = np.random.default_rng(11).integers(0, 2, (_CLASSES, PERIOD), dtype=np.uint8)
    bits[:, -1] = 1
    twice = np.concatenate([bits, bits], axis=1)
    gap = np.zeros((_CLASSES, 2 * PERIOD), np.int64)
    gap[:, -1] = 1
    for t in range(2 * PERIOD - 2, -1, -1):
        gap[:, t] = np.where(twice[:, t] == 1, 1, gap[:, t + 1] + 1)
    return gap[:, :PERIOD]


_GAP = _gaps().astype(np.int32)
_GAP_ROWS = [row.tolist() for row in _GAP]


def _classes(points: np.ndarray) -> np.ndarray:
    return ((points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8)


def walk(classes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The step at which each character begins, and the length of each embedded text."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    begins, lengths = offsets[:-1][order], sizes[order]
    steps, at = np.zeros(len(classes), np.int32), np.zeros(len(order), np.int32)
    live = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
    flat = _GAP.ravel()
    for i, n in enumerate(live.tolist()):
        if n < SIDE_BY_SIDE:
            break
        place = begins[:n] + i
        now = at[:n]
        steps[place] = now
        now += flat[(classes[place].astype(np.int32) << 12) + (now & (PERIOD - 1))]
    else:
        i = len(live)
    for row in np.flatnonzero(lengths > i).tolist():
        begin, t = int(begins[row]), int(at[row])
        own, gap, mask = [], _GAP_ROWS, PERIOD - 1
        for c in classes[begin + i : begin + int(lengths[row])].tolist():
            own.append(t)
            t += gap[c][t & mask]
        steps[begin + i : begin + int(lengths[row])] = own
        at[row] = t
    ends = np.zeros(len(order), np.int64)
    ends[order] = at
    return steps, ends


def _bit(level: int, cell: np.ndarray) -> np.ndarray:
    return (common.mixed(cell.astype(np.uint64) + np.uint64(level << 56)) & np.uint64(1)).astype(np.int64)


def places(level: int, cells: int) -> np.ndarray:
    """The sampled step of each cell: the place of one of its two halves, chosen by a shared bit."""
    at = np.arange(cells)
    for k in range(level, 0, -1):
        at = 2 * at + _bit(k, at)
    return at


def level_of(length: int) -> int:
    return max(0, (length // SAMPLES).bit_length() - 1)


def fingerprints(texts: list[str]) -> list[str]:
    """Level (two digits) and two hex digits for each sample; an empty text has ``00`` alone.

    A sample is a hash of the four characters that follow the place; behind the end they are none.
    """
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    offsets = np.cumsum([0, *map(len, points)])
    joined = np.concatenate([*points, np.zeros(0, np.uint32)])
    steps, ends = walk(_classes(joined), offsets)
    out = []
    for i, length in enumerate(ends.tolist()):
        level = level_of(length)
        at = places(level, -(-length >> level))
        at = at[at < length]
        place = np.searchsorted(steps[offsets[i] : offsets[i + 1]], at, side="right") - 1
        own = np.concatenate([points[i], np.zeros(4, np.uint32)]).astype(np.uint64)
        value = np.zeros(len(place), np.uint64)
        for k in range(4):
            value = common.mixed(value + own[place + k] + np.uint64(1))
        out.append(f"{level:02d}" + (value >> np.uint64(56)).astype(np.uint8).tobytes().hex())
    return out


def _samples(fingerprint: str) -> tuple[int, np.ndarray]:
    return int(fingerprint[:2]), np.frombuffer(bytes.fromhex(fingerprint[2:]), np.uint8)


def coarser(level: int, samples: np.ndarray) -> tuple[int, np.ndarray]:
    """The samples of the next level, which are among these; a last cell without its sample is left out."""
    cells = np.arange(-(-len(samples) // 2))
    at = 2 * cells + _bit(level + 1, cells)
    return level + 1, samples[at[at < len(samples)]]


def likeness(a: str, b: str) -> float:
    """Share of equal samples at the coarser level of the two; equal fingerprints have 1."""
    if a == b:
        return 1.0
    (la, x), (lb, y) = _samples(a), _samples(b)
    while la < lb:
        la, x = coarser(la, x)
    while lb < la:
        lb, y = coarser(lb, y)
    n = min(len(x), len(y))
    most = max(len(x), len(y))
    return float((x[:n] == y[:n]).sum() / most) if most else 0.0


@lru_cache(maxsize=1024)
def _most_unlike(cells: int, near: float) -> int:
    """Cells in which near samples of so many cells differ at most."""
    return next(d for d in range(cells, -1, -1) if not d or (cells - d) / cells >= near)


@lru_cache(maxsize=8)
def _size_classes(near: float) -> list[tuple[int, int]]:
    """The largest number of cells of each class of sizes, and its bands: two more than may differ."""
    largest = [1]
    while largest[-1] < 2 * SAMPLES:
        largest.append(min(2 * SAMPLES, max(largest[-1] + 1, int(largest[-1] / near))))
    return [(m, _most_unlike(m, near) + 2) for m in largest]


def _of_level(keys: np.ndarray, level: int) -> np.ndarray:
    """Keys whose lowest bit says whether their level is odd."""
    return (keys & ~np.uint64(1) | np.uint64(level & 1)).view(np.int64)


def _bit_words(fingerprint: str, above: int, bits: range) -> tuple[list[int], int]:
    """These bits of each sample, two longs a bit, ``above`` levels over the fingerprint's, and the number of samples."""
    level, samples = _samples(fingerprint)
    for _ in range(above):
        level, samples = coarser(level, samples)
    cells = np.zeros(2 * SAMPLES, np.uint8)
    cells[: len(samples)] = samples
    words = [np.packbits(cells >> k & 1).view(np.int64) for k in bits]
    return np.concatenate(words).tolist(), len(samples)


def sketch(fingerprint: str, above: int = 0) -> list[int]:
    """Two bits of each sample, ``above`` levels over the fingerprint's, as four longs, and the number of samples.

    The first two longs hold the lowest bits and the last two the next ones, so that samples with a bit that
    differs are counted by words; they are no more than the samples that differ.
    """
    words, n = _bit_words(fingerprint, above, range(2))
    return [*words, n]


def finer_sketch(fingerprint: str, above: int = 0) -> list[int]:
    """The six bits of each sample that :func:`sketch` leaves out, as twelve longs in the same order."""
    return _bit_words(fingerprint, above, range(2, 8))[0]


def _reaches(fingerprint: str, near: float) -> Iterator[tuple[int, np.ndarray, int, int, int, int]]:
    """Each level and class of sizes in which a near partner may be: level, samples there, the class's largest size
    and number of bands, and the sizes from and to which partners are that have at least as many samples.
    """
    level, own = _samples(fingerprint)
    for lv, samples, least in ((level, own, 1), (*coarser(level, own), SAMPLES)):
        n, before = len(samples), 0
        for most, count in _size_classes(near):
            low, high = max(before + 1, n, least), min(most, int(n / near + 1e-9))
            before = most
            if n and low <= high and count > 2:  # else near samples are equal
                yield lv, samples, most, count, low, high


def _dealt(level: int, samples: np.ndarray, most: int, count: int) -> np.ndarray:
    """A key for each of ``count`` parts, to which the cells of a class of sizes are dealt round."""
    cells = np.arange(-(-most // count) * count, dtype=np.uint64)
    cells[: len(samples)] += (samples.astype(np.uint64) + np.uint64(1)) << np.uint64(8)
    sums = common.mixed(cells + np.uint64(1)).reshape(-1, count).sum(axis=0, dtype=np.uint64)
    place = np.arange(count, dtype=np.uint64) + np.uint64(level << 16 | most << 8)
    return _of_level(common.mixed(sums + common.mixed(place)), level)


def bands(fingerprint: str, near: float = NEAR) -> list[np.ndarray]:
    """Keys of the bands, an array for each level and class of sizes in which a near partner may be.

    The cells of a class are dealt round to its bands, so that each reaches over the whole text. Two
    fingerprints with a likeness of ``near`` (above one half) differ in fewer cells than there are
    bands, so that at least two of their keys are equal. Neighbours across a level meet at the next.
    """
    return [_dealt(lv, own, most, count) for lv, own, most, count, _, _ in _reaches(fingerprint, near)]


def blocks(fingerprint: str, near: float = NEAR) -> list[tuple[int, np.ndarray]]:
    """For each array of :func:`bands` the keys of its blocks of ``BLOCK`` cells, and how many of them are enough.

    In any one order of all keys, near fingerprints have an equal key among so many of their first ones: the
    others are fewer than the blocks they must share. Where all partners have more samples, the cells that
    only they have differ for sure; their blocks are left out and so many fewer cells differ in the rest.
    """
    found = []
    for lv, own, most, _, low, high in _reaches(fingerprint, near):
        count = -(-most // BLOCK)
        shared = np.ones(count, bool)
        shared[np.arange(len(own), low) % count] = False
        enough = _most_unlike(high, near) - (low - len(own)) + 1
        found.append((max(0, enough), _dealt(lv, own, most, count)[shared]))
    return found


def _counter(keys: np.ndarray) -> np.ndarray:
    return keys >> 1 & COUNTERS - 1


def band_keys(fingerprint: str, near: float = NEAR) -> list[int]:
    return [key for own in bands(fingerprint, near) for key in own.tolist()]


def near_names(prints: DataFrame, near: float = NEAR) -> DataFrame:
    """``fingerprint`` and ``near_id``, the smallest id reachable over near fingerprints, of those with an id.

    ``prints`` has ``doc_id`` and ``fingerprint``. Equal fingerprints are one class. In each band the
    smallest class is held against the others first; then the classes of a band that are still apart
    are held against each other, until each pair of a band is verified or of one component. In bands
    of more than ``HOT_BAND`` classes that takes an equal key among the rarest blocks, which near pairs
    have: what a crowd shares is common, so its members and strangers meet only in what few others hold.
    """
    spark = prints.sparkSession

    def verified(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                both = zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist(), strict=True)
                alike = pa.array([likeness(x, y) >= near for x, y in both], pa.bool_())
                yield batch.select(["a", "b"]).filter(alike)

        pairs = pairs.join(classes.select(F.col("node").alias("a"), F.col("fingerprint").alias("fa")), "a")
        pairs = pairs.join(classes.select(F.col("node").alias("b"), F.col("fingerprint").alias("fb")), "b")
        return common.stored(pairs.select("a", "b", "fa", "fb").mapInArrow(run, "a long, b long"), "near-links")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [band_keys(f, near) for f in batch.column("fingerprint").to_pylist()]
            nodes = np.repeat(batch.column("node").to_numpy(), list(map(len, found)))
            flat = np.array([key for own in found for key in own], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(flat)], names=["node", "key"])

    def hot_blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        rows = (batch.column(c).to_pylist() for c in ("node", "open", "fingerprint"))
        for node, open_, fingerprint in zip(*rows, strict=True):
            for band, (enough, own) in zip(bands(fingerprint, near), blocks(fingerprint, near), strict=True):
                if not set(open_).isdisjoint(band.tolist()):
                    yield node, enough, own

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            own = [_counter(keys) for _, _, keys in hot_blocks(batch)]
            held += np.bincount(np.concatenate([np.zeros(0, np.int64), *own]), minlength=COUNTERS)
        often = np.flatnonzero(held > 1)  # what a task sees once is rare
        yield pa.RecordBatch.from_arrays([pa.array(often), pa.array(held[often])], names=["counter", "held"])

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, found = [], []
            for node, enough, own in hot_blocks(batch):
                first = np.lexsort((own, often_held.value[_counter(own)]))[:enough]
                found += own[first].tolist()
                nodes += [node] * len(first)
            columns = [pa.array(nodes, pa.int64()), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "key"])

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("fingerprint").to_pylist(), batch.column("own").to_pylist(), strict=True)
            found = [sketch(f, above) + finer_sketch(f, above) for f, above in ((f, 0 if own else 1) for f, own in rows)]
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(sketched))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("own"), *columns], names=["node", "own", *sketched]
            )

    def own_level(node: str):  # whether a key is of its class's own level and not of the next
        return F.expr(f"({node} ^ key) & 1 = 0")

    def met(keyed: DataFrame) -> DataFrame:
        """The classes that share a key, with its smallest class and its size; the keys are dealt once."""
        same = Window.partitionBy("key")
        sized = keyed.withColumn("first", F.min("node").over(same)).withColumn("n", F.count("*").over(same))
        return common.stored(sized.where("n > 1"), "near-bands")

    def to_first(rows: DataFrame) -> DataFrame:
        """The links of the classes with the smallest classes of their keys.

        A class is held against one of them, the smallest of all, and then against those that are still of
        another component: in a crowd of near copies, one pair for a class and not one for each band.
        """
        rows = rows.where(own_level("first") | own_level("node")).where("node <> first")
        one = rows.groupBy(F.col("node").alias("b")).agg(F.min("first").alias("a")).select("a", "b")
        links = verified(one)
        named = components(links)
        theirs = named.select(F.col("node").alias("first"), F.col("component").alias("first_component"))
        rest = rows.select("first", "node").distinct().join(named, "node", "left").join(theirs, "first", "left")
        open_ = F.coalesce("component", "node") != F.coalesce("first_component", "first")
        rest = rest.where(open_).select(F.col("first").alias("a"), F.col("node").alias("b"))
        return links.union(verified(rest.join(one, ["a", "b"], "left_anti")))

    def apart(rows: DataFrame, found: DataFrame) -> DataFrame:
        """The rows of keys whose classes are of several components and not all held against the first yet."""
        rows = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        parts = rows.groupBy("key", "component").agg(F.count("*").alias("c"), F.max(own_level("node")).alias("own"))
        most = F.max(F.struct("c", "component")).alias("most")
        parts = parts.groupBy("key").agg(most, F.count("*").alias("parts"), F.max("own").alias("own"))
        open_keys = parts.where("parts > 1 and own").select("key", F.col("most.component").alias("main"))
        return rows.where("n > 2").join(common.stored(open_keys, "open-keys"), "key")

    sketched = ("low0", "low1", "high0", "high1", "cells", *(f"finer{i}" for i in range(12)))

    def across(rows: DataFrame, keys_met: int) -> DataFrame:
        """The pairs of a key in different components that may be near; those of the first class are verified already.

        Near pairs meet in ``keys_met`` keys, of the own level of one of them. Rows carry the samples into the join,
        which tests two bits of each first and then all, and gives out only pairs in which no more differ than in near
        ones: strangers that share a passage often agree in two bits, so few that are not near come out.
        """
        rows = rows.where("node <> first").withColumn("own", own_level("node")).select("key", "node", "component", "main", "own")
        ends = rows.select("node", "own").distinct().join(classes.select("node", "fingerprint"), "node")
        kinds = ", ".join(f"{c} long" for c in sketched)
        ends = common.stored(ends.mapInArrow(sketches, f"node long, own boolean, {kinds}"), "sketches")
        rows = rows.join(ends, ["node", "own"])
        x, y = (
            rows.select("key", "main", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "component", "own", *sketched)))
            for side in "xy"
        )
        few = [[f"(low{i}_x ^ low{i}_y)", f"(high{i}_x ^ high{i}_y)"] for i in (0, 1)]
        whole = [few[i] + [f"(finer{j}_x ^ finer{j}_y)" for j in range(i, 12, 2)] for i in (0, 1)]
        differ, differ_whole = (" + ".join(f"bit_count({' | '.join(own)})" for own in words) for words in (few, whole))
        most = f"{1 - near + 1e-9} * greatest(cells_x, cells_y)"
        pairs = x.where("component_x <> main").join(y.drop("main"), "key").where(
            "component_x <> component_y and (component_y = main or node_x < node_y) and (own_x or own_y) "
            f"and {differ} <= {most} and {differ_whole} <= {most}"
        )
        pairs = pairs.groupBy(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))
        return pairs.agg(F.count("*").alias("met")).where(F.col("met") >= keys_met).select("a", "b")

    prints = prints.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("id"))
    # Small numbers are short in shuffles; stored, they stay. Their lowest bit is that of the level.
    level = F.substring("fingerprint", 1, 2).cast("long")
    node = F.monotonically_increasing_id() * 2 + level % 2
    classes = common.stored(prints.select(node.alias("node"), "fingerprint", "id"), "classes")
    rows = met(classes.select("node", "fingerprint").mapInArrow(keys, "node long, key long"))
    links = to_first(rows)
    left = common.stored(apart(rows, components(links)), "near-apart")
    links = links.union(verified(across(left.where(F.col("n") <= HOT_BAND), 2)))
    # at most one key for each band, so the lists are short
    hot = left.where(F.col("n") > HOT_BAND).groupBy("node").agg(F.collect_list("key").alias("open"))
    hot = common.stored(hot.join(classes.select("node", "fingerprint"), "node"), "hot-classes")
    often = hot.mapInArrow(counted, "counter long, held long").groupBy("counter").agg(F.sum("held").alias("held")).toArrow()
    held = np.zeros(COUNTERS, np.int64)
    held[often["counter"].to_numpy()] = often["held"].to_numpy()
    often_held = spark.sparkContext.broadcast(held)
    rows = met(hot.mapInArrow(rarest, "node long, key long"))
    links = links.union(to_first(rows))
    links = links.union(verified(across(common.stored(apart(rows, components(links)), "near-apart"), 1)))
    named = classes.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("id").alias("near_id"))
    return named.select("fingerprint", "component").join(common.stored(least, "near-ids"), "component").drop("component")


def near_groups(prints: DataFrame, near: float = NEAR) -> DataFrame:
    """``doc_id`` and ``near_id``, the smallest id of the group; a null id is its own group."""
    out = prints.where("doc_id is not null").join(near_names(prints, near), "fingerprint").select("doc_id", "near_id")
    return out.union(prints.where("doc_id is null").select("doc_id", "doc_id"))


def neighbours(docs: DataFrame) -> DataFrame:
    """Each document with its own fingerprint, its edited text's, and how like the next one's it is.

    The next document is that with the next smaller id (equal ids: by a hash of the text; null ids
    last), and after the last the first. Texts are dealt by ranges of ids and hashes, so that a repeated
    id is split; each range also gets a copy of the row that begins the next, so one shuffle of the
    texts is enough.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    source = source.withColumn("tie", F.xxhash64("text"))
    ids = source.select("doc_id", "tie")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    drawn = ids.orderBy(F.xxhash64("doc_id", "tie")).limit(CUT_SAMPLES * parts).collect()
    drawn = [(r["doc_id"], r["tie"]) for r in drawn]
    drawn = sorted((r for r in drawn if r[0] is not None), key=lambda r: (r[0], -r[1]), reverse=True) + sorted(
        (r for r in drawn if r[0] is None), key=lambda r: r[1]
    )
    cuts = list(dict.fromkeys(drawn[len(drawn) * i // parts] for i in range(1, parts))) if drawn else []
    bounds = F.array(*(F.struct(F.lit(i).cast(kind).alias("id"), F.lit(t).cast("long").alias("tie")) for i, t in cuts))

    def reached(cut):  # whether a row lies at the cut or behind it: ids count down, nulls are last
        same = cut["id"].eqNullSafe(F.col("doc_id")) & (cut["tie"] <= F.col("tie"))
        return same | (cut["id"].isNotNull() & F.coalesce(F.col("doc_id") < cut["id"], F.lit(True)))

    dealt_to = (F.size(F.filter(bounds, reached)) if cuts else F.lit(0)).cast("int")
    own = source.withColumn("range", dealt_to).withColumn("guest", F.lit(0))
    largest = F.max(F.struct("doc_id", F.bitwise_not("tie").alias("turned"))).alias("first")
    firsts = ids.groupBy(dealt_to.alias("range")).agg(largest).collect()  # one row a range
    firsts = sorted((r["range"], r["first"]["doc_id"], ~r["first"]["turned"]) for r in firsts)
    used = [r for r, _, _ in firsts]
    into = [(doc_id, tie, used[i - 1]) for i, (_, doc_id, tie) in enumerate(firsts)]
    into = spark.createDataFrame(into, f"g_id {kind}, g_tie long, range int")
    guests = source.join(F.broadcast(into), F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("tie") == F.col("g_tie")))
    # of rows equal in both, one is enough
    guests = guests.groupBy("range").agg(*(F.first(c).alias(c) for c in ("doc_id", "text", "tie")))
    guests = guests.withColumn("guest", F.lit(1))
    columns = ["doc_id", "text", "range", "guest", "tie"]
    rows = own.select(columns).union(guests.select(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for part in common.text_slices(batches, "text", SLICE_CHARS):
            held += zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "range", "guest")), strict=True)
            yield from embedded(held[:-1], held[1:])
            held = held[-1:]

    def embedded(rows: list[tuple], following: list[tuple]) -> Iterator[pa.RecordBatch]:
        pairs = [(a, b[1]) for a, b in zip(rows, following, strict=True) if not a[3] and a[2] == b[2]]
        if not pairs:
            return
        texts = [a[1] for a, _ in pairs]
        after = [text for _, text in pairs]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, after, strict=True)]
        # the next text is mostly the next row's own
        lone = [n for n, own in zip(after, [*texts[1:], None], strict=True) if n is not own]
        prints = dict(zip([*map(id, texts), *map(id, lone)], fingerprints(texts + lone), strict=True))
        changed = fingerprints(edited)
        mine = [prints[id(t)] for t in texts]
        columns = [
            pa.array([a[0] for a, _ in pairs], part_type),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
            pa.array(mine),
            pa.array(changed),
            pa.array([likeness(a, b) for a, b in zip(mine, changed, strict=True)], pa.float64()),
            pa.array([likeness(a, prints[id(n)]) for a, n in zip(mine, after, strict=True)], pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    part_type = to_arrow_type(docs.schema["doc_id"].dataType)
    dealt = rows.repartitionByRange(max(1, len(used)), "range").sortWithinPartitions(
        "range", "guest", F.desc_nulls_last("doc_id"), "tie"
    )
    schema = (
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return dealt.mapInArrow(run, schema)


def grouped(docs: DataFrame) -> DataFrame:
    """The rows of :func:`neighbours` with ``near_id``, the smallest id of the group of like fingerprints.

    Ids without a partner are their own group; a null id has none.
    """
    rows = common.stored(neighbours(docs), "fingerprints")
    names = near_names(rows.select("doc_id", "fingerprint"))
    own = F.when(F.col("doc_id").isNotNull(), F.col("near_id"))
    return rows.join(names, "fingerprint", "left").select(*rows.columns, own.alias("near_id"))
