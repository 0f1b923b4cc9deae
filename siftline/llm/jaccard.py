"""Exact near-duplicate groups of texts by the Jaccard similarity of their word shingles.

A size-aware join: sets up to a boundary are small, the others large. A small set lists its subsets
of the size that a partner must share, so two small sets are linked exactly when they list a common
one. A large set scans inverted lists: every pair above the threshold shares one of each set's
rarest shingles, in one order for all sets. The boundary is where listing subsets stops being
cheaper than scanning.

Neither step pairs all members of a list. First each list pairs one set of each range of sizes with
the others of that range; pairs that hold are contracted to components, and then only members of one
list that are still in different components are paired. Histograms of the sets rule out most pairs. Every pair that could add a link between components is verified on
the whole sets, so the components are exact up to equal 64-bit hashes of different shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm import common
from siftline.llm.links import components

#: Counters of the shingle frequencies that order the inverted lists; a fixed number.
COUNTERS = 1 << 20
#: Subsets a set may list at most before lists are always taken to be cheaper.
MOST_SUBSETS = 5_000
#: Buckets of the histogram of a set's elements, which bounds what two sets can have in common.
BUCKETS = 256
#: Bits of the filter that says which texts are worth hashing again; a fixed number.
FILTER_BITS = 1 << 24
#: Set ids that a task remembers in order to send equal sets once.
REMEMBERED = 500_000

_KEY, _SIZE, _PLACE = "__siftline_key", "__siftline_size", "__siftline_place"
_ROW = "key long, side int, band int, n int, sid long, place int"


def needed(n: int, m: int, percent: int) -> int:
    """Least common elements of sets of n and m elements whose similarity is ``percent`` or more."""
    return -(-percent * (n + m) // (100 + percent))


def partner_sizes(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subsets_of(n: int, percent: int) -> int:
    """Subsets that a set of n elements lists for partners of every size."""
    return sum(math.comb(n, needed(n, m, percent)) for m in partner_sizes(n, percent) if needed(n, m, percent) <= min(n, m))


def prefix_of(n: int, percent: int) -> int:
    """How many of its rarest elements a set needs, so that every partner holds one of them."""
    return n - -(-percent * n // 100) + 1


def boundary(sizes: dict[int, int], list_length: float, percent: int) -> int:
    """The largest small size: cost of listing subsets against scanning lists, over the sizes there are."""
    best, best_cost, small = 0, 0.0, 0.0
    for n in range(1, max(sizes, default=0) + 1):
        subsets = subsets_of(n, percent)
        if subsets > MOST_SUBSETS:
            break
        small += sizes.get(n, 0) * (subsets - prefix_of(n, percent) * max(1.0, list_length))
        if small <= best_cost:
            best, best_cost = n, small
    return best


def shingles(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct k-word shingles of each text; fewer words are one shingle."""
    raw, offsets = common.utf8(column)
    begins, ends, at = common.words(raw, offsets)
    hashes = common.span_hashes(raw, begins, ends, fold=True)
    n = max(0, len(hashes) - k + 1)
    whole = np.zeros(n, np.uint64)
    for i in range(k):
        whole = common.mixed(whole + hashes[i : i + n])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for h in hashes[a:b]:
                short = common.mixed(np.array([short ^ h]))[0]
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(own: np.ndarray) -> int:
    """Id of a set: equal sets have equal ids."""
    return int(common.mixed(np.array([common.mixed(own).sum() + np.uint64(len(own))]))[0].astype(np.int64))


def _survey(docs: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """Size, id and histogram of each row's set, and the shingle frequencies in fixed counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.int64)
        kind = None
        for part in common.text_slices(batches, "text"):
            sets = shingles(part.column("text"), k)
            places = np.concatenate(sets) & np.uint64(COUNTERS - 1)
            counters += np.bincount(places.astype(np.int64), minlength=COUNTERS)
            kind = part.column("row").type
            sizes, ids = [len(s) for s in sets], [set_id(s) for s in sets]
            yield batch(part.column("row"), sizes, ids, [_histogram(s) for s in sets], [_levels(s) for s in sets])
        if kind is not None:
            cuts = np.array_split(counters, 64)
            for i, cut in enumerate(cuts):
                yield batch(pa.nulls(1, kind), [-1 - i], [0], [cut.astype(np.int32).tobytes()], [None])

    def batch(row: pa.Array, n: list[int], sid: list[int], cuts: list, levels: list) -> pa.RecordBatch:
        columns = [row, pa.array(n, pa.int32()), pa.array(sid, pa.int64()), pa.array(cuts, pa.binary())]
        columns.append(pa.array(levels, pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, names=["row", "n", "sid", "cut", "levels"])

    kind = docs.schema["row"].dataType.simpleString()
    seen = common.stored(docs.mapInArrow(run, f"row {kind}, n int, sid long, cut binary, levels array<long>"), "sets")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for part in batches:
            for n, cut in zip(part.column("n").to_pylist(), part.column("cut").to_pylist(), strict=True):
                own = np.frombuffer(cut, np.int32).astype(np.int64)
                sums[n] = sums[n] + own if n in sums else own
        rows = [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(rows, names=["n", "cut"])

    cuts = seen.where("n < 0").select("n", "cut").repartition(16, "n").mapInArrow(add, "n int, cut binary").collect()
    parts = [np.frombuffer(r["cut"], np.int64) for r in sorted(cuts, key=lambda r: -r["n"])]
    counters = np.concatenate(parts) if parts else np.zeros(COUNTERS, np.int64)
    return seen.where("n >= 0").withColumnRenamed("cut", "histogram"), counters


def _levels(own: np.ndarray) -> list[int]:
    """Bits for 128 coarser buckets: whether one holds more than 0, 1, 2 and 3 elements, two longs each.

    Common bits of two sets count the elements they can share, but for those above the fourth.
    """
    counts = np.bincount((own >> np.uint64(49) & np.uint64(127)).astype(np.int64), minlength=128)
    bits = np.concatenate([counts > level for level in range(4)])
    return np.packbits(bits).view(np.int64).tolist()


def _histogram(own: np.ndarray) -> bytes | None:
    """Elements in each bucket; None where a bucket holds more than a byte can say."""
    counts = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=BUCKETS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def _emitted(docs: DataFrame, k: int, percent: int, small: int, counters: np.ndarray) -> DataFrame:
    """Rows of inverted lists (side -1) and of subset classes (side 0: equal sizes, 1: smaller, 2: larger)."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counters, (1 << 24) - 1).astype(np.int32))

    def lists(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        often = shared.value[(own & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64)
        rank = (often << np.uint64(40)) | (own >> np.uint64(24))
        chosen = np.argsort(rank, kind="stable")[: prefix_of(len(own), percent)]
        return own[chosen], np.arange(len(chosen))

    def subsets(own: np.ndarray) -> Iterator[tuple[int, int]]:
        n = len(own)
        marks = common.mixed(own).tolist()
        whole = sum(marks)
        for m in partner_sizes(n, percent):
            t = needed(n, m, percent)
            if m > small or t > min(n, m) or (n == m == t):
                continue  # larger partners are met in the lists, equal sets are one set
            side = 0 if n == m else 1 if n < m else 2
            tag = (min(n, m) << 32) + max(n, m)
            for left_out in combinations(marks, n - t):
                yield (whole - sum(left_out)) * 0x9E3779B97F4A7C15 + tag & (1 << 64) - 1, side

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in common.text_slices(batches, "text"):
            keys, sides, sizes, sids, spots = [], [], [], [], []
            for own in shingles(part.column("text"), k):
                n = len(own)
                sid = set_id(own) if n else 0
                if not n or sid in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(sid)
                if n <= small and (found := list(subsets(own))):
                    keys.append(common.mixed(np.array([x for x, _ in found], np.uint64)))
                    sides.append(np.array([s for _, s in found]))
                    spots.append(np.zeros(len(found), np.int64))
                    sizes.append(np.full(len(found), n))
                    sids.append(np.full(len(found), sid))
                if 100 * n // percent > small and prefix_of(n, percent) and n * 100 > percent * n:
                    key, spot = lists(own)
                    keys.append(key)
                    sides.append(np.full(len(key), -1))
                    spots.append(spot)
                    sizes.append(np.full(len(key), n))
                    sids.append(np.full(len(key), sid))
            if keys:
                side, size = np.concatenate(sides), np.concatenate(sizes)
                # lists are looked at by sets of about one size; subset classes are taken whole
                band = np.where(side < 0, np.floor(np.log(size) * 20), -1)
                columns = [np.concatenate(keys), side, band, size, np.concatenate(sids), np.concatenate(spots)]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, kinds, strict=True)],
                    names=["key", "side", "band", "n", "sid", "place"],
                )

    return docs.select("text").mapInArrow(run, _ROW)


def _marks(wanted: DataFrame) -> np.ndarray:
    """A filter of fixed size over the wanted rows' marks; it may let others through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[np.asarray(batch.column("mark")) & (FILTER_BITS - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()])], names=["bits"])

    total = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in wanted.select("mark").coalesce(8).mapInArrow(run, "bits binary").collect():
        total |= np.frombuffer(r["bits"], np.uint8)
    return total


def _arrays(source: DataFrame, k: int, sids: DataFrame, chosen: DataFrame) -> DataFrame:
    """``sid`` and the shingles of the sets named in ``sids``, stored.

    Each set is hashed again from the one row chosen for it; the texts stay where they are read, and
    only the shingles of wanted rows travel.
    """
    wanted = sids.join(chosen, "sid").select("sid", F.col("row").alias("w_row"), F.xxhash64("row").alias("mark"))
    marks = source.sparkSession.sparkContext.broadcast(_marks(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.text_slices(batches, "text"):
            place = np.asarray(part.column("mark")) & (FILTER_BITS - 1)
            part = part.filter(pa.array((marks.value[place >> 3] >> (7 - (place & 7)) & 1).astype(bool)))
            if part.num_rows:
                sets = shingles(part.column("text"), k)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, np.concatenate(sets).astype(np.int64))
                ids = pa.array([set_id(s) if len(s) else 0 for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("mark"), ids, lists], names=["mark", "sid", "own"])

    marked = source.select(F.xxhash64("row").alias("mark"), "text")
    made = marked.mapInArrow(run, "mark long, sid long, own array<long>")
    once = Window.partitionBy("sid").orderBy("mark")
    made = made.join(wanted.select("sid", "mark"), ["sid", "mark"], "left_semi")
    made = made.withColumn("nth", F.row_number().over(once)).where("nth = 1").select("sid", "own")
    return common.stored(made, "shingles")


def _could(n: Column, m: Column, i: Column, j: Column, percent: int) -> Column:
    """Whether sets of n and m elements that first meet at places i and j can be similar enough."""
    common_most = F.least(n - i, m - j)
    return ((100 + percent) * common_most >= percent * (n + m)) & (100 * F.least(n, m) >= percent * F.greatest(n, m))


def groups(docs: DataFrame, k: int, percent: int, row: str = "doc_id", text: str = "text") -> DataFrame:
    """``row``, ``n_shingles``, ``component`` (smallest row id reachable by links) of every row.

    Sets are linked from a similarity of ``percent`` hundredths. Texts without words (null or empty)
    have the empty set, which is linked with nothing; equal sets are linked. Repeated ids are rows
    of their own; a null id is never a component's name unless all its members have none. Other
    columns are not read.
    """
    source = docs.select(F.col(row).alias("row"), F.col(text).alias("text"))
    sets, counters = _survey(source, k)
    sizes = {r["n"]: r["count"] for r in sets.where("n between 1 and 200").groupBy("n").count().collect()}
    total = float(counters.sum())
    length = max(1.0, (float((counters.astype(float) ** 2).sum()) - total * total / COUNTERS) / max(total, 1.0))
    small = boundary(sizes, length, percent)
    emitted = _emitted(source, k, percent, small, counters)
    # the filter stands here so that both uses below have the same plan, and the rows are dealt once
    emitted = emitted.where("key is not null and band is not null").repartition("key").distinct()
    # another first set in every list, so that a set is held against many of its group
    lists = emitted.groupBy("key", "band").agg(
        F.min(F.struct(F.xxhash64("sid", "key").alias("draw"), "sid", "n", "place")).alias("first"),
        F.min(F.when(F.col("side") == 1, F.col("sid"))).alias("smaller"),
        F.min(F.when(F.col("side") == 2, F.col("sid"))).alias("larger"),
        F.count("*").alias("here"),
    )
    lists = lists.withColumn("members", F.sum("here").over(Window.partitionBy("key"))).where("members > 1")
    met = common.stored(emitted.join(lists.drop("here", "members"), ["key", "band"]), "lists")
    chosen = sets.where("n > 0").groupBy("sid").agg(F.min(F.struct("row", "histogram", "levels")).alias("one"))
    chosen = common.stored(chosen.select("sid", "one.row", "one.histogram", "one.levels"), "classes")

    partner = (
        F.when(F.col("side") == 1, F.col("larger")).when(F.col("side") == 2, F.col("smaller")).otherwise(F.col("first.sid"))
    )
    possible = (F.col("side") >= 0) | _could(F.col("first.n"), F.col("n"), F.col("first.place"), F.col("place"), percent)
    pairs = met.withColumn("a", partner).where("a is not null and a <> sid").where(possible)
    pairs = _likely(_ordered(pairs.select("a", F.col("sid").alias("b"))), chosen, percent)
    links = _verified(pairs, _arrays(source, k, _ends(pairs), chosen), percent)

    named = met.where("side < 0").select("key", "n", "sid", "place")
    named = _with_components(named, "sid", "component", common.stored(components(links), "components"))
    in_list = named.groupBy("key", "component").agg(F.count("*").alias("c"))
    mixed = in_list.groupBy("key").agg(F.max(F.struct("c", "component")).alias("most"), F.count("*").alias("parts"))
    mixed = mixed.where("parts > 1").select("key", F.col("most.component").alias("main"))
    open_lists = named.join(mixed, "key").join(chosen.select("sid", "levels"), "sid")
    open_lists = common.stored(open_lists, "open")
    rest = open_lists.where("component <> main")
    a = rest.select("key", *(F.col(c).alias(f"a_{c}") for c in ("n", "sid", "place", "component", "levels")))
    b = open_lists.select("key", *(F.col(c).alias(f"b_{c}") for c in ("n", "sid", "place", "component", "levels", "main")))
    across = a.join(b, "key").where(
        (F.col("a_component") != F.col("b_component"))
        & ((F.col("b_component") == F.col("b_main")) | (F.col("a_sid") < F.col("b_sid")))
        & _could(F.col("a_n"), F.col("b_n"), F.col("a_place"), F.col("b_place"), percent)
        & _could_share(percent)
    )
    across = _ordered(across.select(F.col("a_sid").alias("a"), F.col("b_sid").alias("b")))
    across = _likely(across, chosen, percent)
    arrays = _arrays(source, k, _ends(across), chosen)
    # one partner of each set first: most of the others then are in its component already
    some = across.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = links.union(_verified(some, arrays, percent))
    others = across.join(some, ["a", "b"], "left_anti")
    found = common.stored(components(links), "components")
    others = _with_components(_with_components(others, "a", "ca", found), "b", "cb", found)
    links = links.union(_verified(others.where("ca <> cb").select("a", "b"), arrays, percent))
    return _named(sets, components(links))


def _could_share(percent: int) -> Column:
    """Whether the levels of two sets allow enough common elements."""
    ones = lambda side: sum((F.bit_count(F.col(side)[i]) for i in range(1, 8)), F.bit_count(F.col(side)[0]))
    shared = F.bit_count(F.col("a_levels")[0].bitwiseAND(F.col("b_levels")[0]))
    for i in range(1, 8):
        shared += F.bit_count(F.col("a_levels")[i].bitwiseAND(F.col("b_levels")[i]))
    beyond = F.least(F.col("a_n") - ones("a_levels"), F.col("b_n") - ones("b_levels"))
    return (100 + percent) * (shared + beyond) >= percent * (F.col("a_n") + F.col("b_n"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()


def _with_components(rows: DataFrame, node: str, name: str, found: DataFrame) -> DataFrame:
    """The rows with the component of a column's set; a set without links is its own."""
    rows = rows.join(found.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left")
    return rows.withColumn(name, F.coalesce(name, node))


def _likely(pairs: DataFrame, chosen: DataFrame, percent: int) -> DataFrame:
    """The pairs whose histograms allow enough common elements, stored; no pair above the threshold is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            keep = np.ones(batch.num_rows, bool)
            known = [i for i in range(batch.num_rows) if x[i] is not None and y[i] is not None]
            if known:
                left, right = (
                    np.frombuffer(b"".join(h[i] for i in known), np.uint8).reshape(-1, BUCKETS).astype(np.int32)
                    for h in (x, y)
                )
                both = np.minimum(left, right).sum(axis=1)
                sizes = left.sum(axis=1) + right.sum(axis=1)
                keep[known] = (100 + percent) * both >= percent * sizes
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    pairs = pairs.join(chosen.select(F.col("sid").alias("a"), F.col("histogram").alias("x")), "a")
    pairs = pairs.join(chosen.select(F.col("sid").alias("b"), F.col("histogram").alias("y")), "b")
    return common.stored(pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "likely")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough, stored."""
    pairs = pairs.join(arrays.select(F.col("sid").alias("a"), F.col("own").alias("x")), "a")
    pairs = pairs.join(arrays.select(F.col("sid").alias("b"), F.col("own").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    close = 100 * both >= percent * (F.size("x") + F.size("y") - both)
    return common.stored(pairs.where(close).select("a", "b"), "links")


def _named(sets: DataFrame, whole: DataFrame) -> DataFrame:
    """Every row with its size and the smallest row id of its component."""
    classes = sets.where("n > 0").groupBy("sid").agg(F.min("row").alias("least"))
    classes = classes.join(whole.withColumnRenamed("node", "sid"), "sid", "left")
    classes = classes.withColumn("component", F.coalesce("component", "sid"))
    roots = classes.groupBy("component").agg(F.min("least").alias("least"))
    names = classes.select("sid", "component").join(roots, "component").select("sid", "least")
    out = sets.where("n > 0").join(names, "sid").select("row", "n", F.col("least").alias("component"))
    empty = sets.where("n = 0").select("row", "n", F.col("row").alias("component"))
    return out.union(empty).select("row", F.col("n").cast("long").alias("n_shingles"), "component")


def linked_groups(docs: DataFrame) -> DataFrame:
    """Groups of documents whose sets of three-word shingles are 0.9 similar."""
    found = groups(docs, k=3, percent=90)
    return found.select(F.col("row").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near duplicates: of each group the row of the smallest id stays.

    Rows with equal ids are told apart by their texts; of rows equal in both one stays. Texts
    without words all stay. A row with a null id stays only in a group that has no other.
    """
    key = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", F.xxhash64("text").alias("text"))
    keyed = docs.withColumn(_KEY, key)
    found = groups(keyed, k, percent, row=_KEY)
    stay = found.where("n_shingles = 0 or row = component").groupBy("row").agg(F.max("n_shingles").alias(_SIZE))
    once = Window.partitionBy(_KEY).orderBy(F.xxhash64(*docs.columns))
    rows = keyed.join(stay.withColumnRenamed("row", _KEY), _KEY)
    return rows.withColumn(_PLACE, F.row_number().over(once)).where(f"{_SIZE} = 0 or {_PLACE} = 1").select(docs.columns)
