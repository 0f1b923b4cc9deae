"""Token sequences of full length by cutting-stock column generation over the length histogram.

Documents are cut into full sequences and a remainder. The histogram of remainder lengths, in fixed
classes, is a cutting-stock problem of bounded size: a linear programme over patterns, whose columns
a knapsack programme prices. The rounded patterns are handed to documents by their rank in their
class; the few that no whole pattern takes are laid end to end and cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm import common
from siftline.llm.byte_encoding import encoder

#: Tokens of a sequence, and of a length class.
LENGTH, WIDTH = 2048, 4
#: The programme ends when its value is this close to its lower bound, or after so many columns.
GAP, MOST_COLUMNS = 5e-4, 6_000
#: Id that closes every document.
END_ID = 1
_END = np.array([END_ID], "<u4")


def token_ids(definition: str, text: str | None) -> np.ndarray:
    """The ids of a text (a null is empty) and the id that closes it."""
    return np.concatenate([encoder(definition, True).id_array(text or ""), _END])


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.tobytes())


def _best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The knapsack of largest price, by dynamic programming over capacities."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    own_sizes, own_prices = sizes[order], prices[order]
    for room in range(1, capacity + 1):
        n = np.searchsorted(own_sizes, room, side="right")
        value[room] = value[room - 1]
        if n:
            worth = value[room - own_sizes[:n]] + own_prices[:n]
            best = int(worth.argmax())
            if worth[best] > value[room] + 1e-12:
                value[room], choice[room] = worth[best], order[best]
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= sizes[choice[room]]
    return value[capacity], pattern


def _greedy_patterns(sizes: np.ndarray, wanted: np.ndarray, capacity: int) -> np.ndarray:
    """First columns: patterns filled from the largest size left, each repeated until a size runs short."""
    left, found = wanted.copy(), []
    fullness = sizes * (1 + 1e-3 * sizes / capacity)
    while (open_ := np.flatnonzero(left > 0)).size:
        pattern = np.zeros(len(sizes))
        pattern[open_[-1]] = 1
        room = int(capacity - sizes[open_[-1]])
        fits = open_[sizes[open_] <= room]
        if fits.size:
            pattern[fits] += _best_pattern(fullness[fits], sizes[fits], room)[1]
            pattern = np.minimum(pattern, left)
        has = pattern > 0
        left -= np.floor((left[has] / pattern[has]).min()) * pattern
        found.append(pattern)
    return np.array(found).T


def cutting_stock(demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (size: count) and how often each is used, without taking more of a size than there is.

    Column generation; whole uses of the last solution are kept. It starts from one pattern per size,
    takes in greedy patterns while they pay, and then what the knapsack programme finds.
    """
    sizes = np.array(sorted(demand), int)
    wanted = np.array([demand[s] for s in sizes.tolist()], float)
    n = len(sizes)
    if not n:
        return []
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    used = wanted / np.diag(basis)
    pool = _greedy_patterns(sizes, wanted, capacity)
    # prices are drawn towards the best known bound, else they swing and the columns fill badly
    anchor, bound, pull = sizes / capacity, (sizes * wanted).sum() / capacity, 0.9
    for _ in range(MOST_COLUMNS):
        if used.sum() <= bound * (1 + GAP):
            break
        prices = inverse.sum(axis=0)
        worths = (pool * prices[:, None]).sum(axis=0)
        if worths.max() > 1 + 1e-6:
            pattern = pool[:, int(worths.argmax())]
        else:
            blend = pull * anchor + (1 - pull) * prices
            worth, pattern = _best_pattern(blend, sizes, capacity)
            if (here := (blend * wanted).sum() / max(worth, 1.0)) > bound:
                bound, anchor = here, blend / max(worth, 1.0)
            if (prices * pattern).sum() <= 1 + 1e-7:
                if pull == 0:
                    break
                pull = pull / 2 if pull > 0.05 else 0.0
                continue
        has = np.flatnonzero(pattern)
        step = (inverse[:, has] * pattern[has]).sum(axis=1)
        ratios = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        leaving = int(ratios.argmin())
        used = np.maximum(used - ratios[leaving] * step, 0)
        used[leaving] = ratios[leaving]
        basis[:, leaving] = pattern
        row = inverse[leaving] / step[leaving]
        inverse = inverse - step[:, None] * row
        inverse[leaving] = row
    plans, left = [], wanted.astype(int).copy()
    for j in np.argsort(-used, kind="stable"):
        pattern = basis[:, j].astype(int)
        has = pattern > 0
        count = int(min(np.floor(used[j] + 1e-6), (left[has] // pattern[has]).min())) if has.any() else 0
        if count > 0:
            left -= count * pattern
            plans.append(({int(sizes[i]): int(pattern[i]) for i in np.flatnonzero(has)}, count))
    return plans


def tokenised(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """For every whole text: its token count, the checksum of each cut at ``LENGTH``, and counts in its part.

    ``part`` is the task that read the row; ``blocks`` and ``rank`` count full sequences, and
    documents of the same class, before the row in that part.
    """
    definition = _shared(docs, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks, ranks = TaskContext.get().partitionId(), 0, {}
        for batch in common.text_slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                ids = token_ids(definition.value, text)
                n, cls = len(ids), -(-(len(ids) % LENGTH) // WIDTH)
                cuts = [_crc(ids[i : i + LENGTH]) for i in range(0, n, LENGTH)]
                rank = ranks.get(cls, 0)
                rows.append((n, cuts, cuts[0] if n <= LENGTH else _crc(ids), part, blocks, cls, rank))
                ranks[cls] = rank + 1
                blocks += n // LENGTH
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    names = ["doc_id", "n", "cuts", "crc", "part", "blocks", "class", "rank"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, cuts array<long>, crc long, part int, blocks long, class int, rank long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _shared(docs: DataFrame, vocabulary_path: str):
    with open(vocabulary_path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _laid_out(rows: list, sequence: int) -> list[tuple]:
    """Remainders end to end, cut into full sequences and then into powers of two.

    Gives the row's place in ``rows`` with start, length, sequence and offset of each piece.
    """
    total = sum(r["n"] % LENGTH for r in rows)
    rooms = [LENGTH] * (total // LENGTH) + [1 << b for b in range(10, -1, -1) if total % LENGTH >> b & 1]
    pieces, at, offset = [], 0, 0
    for i, r in enumerate(rows):
        start = r["n"] - r["n"] % LENGTH
        while start < r["n"]:
            length = min(r["n"] - start, rooms[at] - offset)
            pieces.append((i, start, length, sequence + at, offset))
            start += length
            offset += length
            if offset == rooms[at]:
                at, offset = at + 1, 0
    return pieces


def packed(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """The pieces of all documents in sequences of at most ``LENGTH`` tokens.

    A null text is empty, so every row has at least its closing id. Repeated rows are documents of
    their own, null ids are kept, an empty table gives no rows. Only ``doc_id`` and ``text`` are
    read. Sequence ids are distinct but not gapless.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = common.stored(tokenised(docs, vocabulary_path), "tokens")

    # how many full sequences and members of each class lie in the parts before
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    full = rows.groupBy("part").agg(F.sum(F.floor(F.col("n") / LENGTH)).alias("here"))
    full = full.select("part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("blocks_ahead"))
    in_class = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = rows.where("class > 0").groupBy("class", "part").count()
    ranks = ranks.select("class", "part", F.coalesce(F.sum("count").over(in_class), F.lit(0)).alias("rank_ahead"))

    counts = rows.where("class > 0").groupBy("class").count().collect()  # at most LENGTH / WIDTH rows
    demand = {r["class"]: r["count"] for r in counts}
    plan, given, sequence = [], dict.fromkeys(demand, 0), 0
    for pattern, uses in cutting_stock(demand, LENGTH // WIDTH):
        slot = 0
        for cls in sorted(pattern, reverse=True):
            per = pattern[cls]
            plan.append((cls, given[cls], given[cls] + per * uses, sequence, per, slot))
            given[cls] += per * uses
            slot += per
        sequence += uses
    plan_df = spark.createDataFrame(plan, "p_class int, low long, high long, first long, per int, slot int")
    taken = spark.createDataFrame(list(given.items()), "p_class int, taken long")

    ranked = rows.where("class > 0").join(ranks, ["class", "part"])
    ranked = ranked.withColumn("place", F.col("rank") + F.col("rank_ahead"))
    whole = ranked.join(
        F.broadcast(plan_df),
        (F.col("class") == F.col("p_class")) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")),
    )
    nth = F.col("place") - F.col("low")
    rest = F.col("n") % LENGTH
    in_sequence = Window.partitionBy("sequence_id").orderBy("spot").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(
        "doc_id",
        (F.col("n") - rest).alias("start"),
        rest.alias("length"),
        F.element_at("cuts", -1).alias("ids_crc32"),
        F.col("n").alias("doc_tokens"),
        (F.col("first") + F.floor(nth / F.col("per"))).alias("sequence_id"),
        (F.col("slot") + nth % F.col("per")).alias("spot"),
    )
    whole = whole.withColumn("offset", F.coalesce(F.sum("length").over(in_sequence), F.lit(0))).drop("spot")

    # what no whole pattern takes: a bounded number of documents, whatever the corpus
    spare = ranked.join(F.broadcast(taken), F.col("class") == F.col("p_class")).where("place >= taken")
    spare = spare.select("doc_id", "n", "crc", F.element_at("cuts", -1).alias("last"), "class", "place")
    spare = spare.orderBy(F.desc("class"), "place").collect()
    pieces = _laid_out(spare, sequence)
    sequence = max((p[3] + 1 for p in pieces), default=sequence)
    loose = _loose(docs, vocabulary_path, spare, pieces, kind)

    blocks = rows.where(F.col("n") >= LENGTH).join(full, "part")
    cuts = F.posexplode(F.slice("cuts", F.lit(1), F.floor(F.col("n") / LENGTH).cast("int"))).alias("at", "ids_crc32")
    blocks = blocks.select("doc_id", "n", (F.col("blocks") + F.col("blocks_ahead") + sequence).alias("base"), cuts)
    blocks = blocks.select(
        "doc_id",
        (F.col("at") * LENGTH).cast("long").alias("start"),
        F.lit(LENGTH).cast("long").alias("length"),
        "ids_crc32",
        F.col("n").alias("doc_tokens"),
        (F.col("base") + F.col("at")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    order = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return whole.select(*order).union(blocks.select(*order)).union(loose.select(*order))


def _loose(docs: DataFrame, vocabulary_path: str, spare: list, pieces: list[tuple], kind: str) -> DataFrame:
    """The pieces of the spare documents; those that were cut are read again for their checksums."""
    spark = docs.sparkSession
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    sure, cut = [], []
    for i, start, length, sequence, offset in pieces:
        r = spare[i]
        if length == r["n"] % LENGTH:
            sure.append((r["doc_id"], start, length, r["last"], r["n"], sequence, offset))
        else:
            cut.append((r["doc_id"], r["n"], r["crc"], start, length, sequence, offset))
    out = spark.createDataFrame(sure, schema)
    if not cut:
        return out
    definition = _shared(docs, vocabulary_path)
    wanted = spark.createDataFrame(
        cut, f"w_id {kind}, n long, crc long, start long, length long, sequence_id long, offset long"
    )
    spans = wanted.groupBy("w_id", "n", "crc").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    texts = docs.select("doc_id", "text").join(F.broadcast(spans), F.col("doc_id").eqNullSafe(F.col("w_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, "text"):
            rows = []
            for r in batch.to_pylist():
                ids = token_ids(definition.value, r["text"])
                if len(ids) == r["n"] and _crc(ids) == r["crc"]:
                    for s in r["spans"]:
                        own = ids[s["start"] : s["start"] + s["length"]]
                        rows.append((r["doc_id"], r["n"], r["crc"], s["start"], s["length"], _crc(own)))
            if rows:
                columns = [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[1:]]
                ids_ = pa.array([r[0] for r in rows], batch.column("doc_id").type)
                yield pa.RecordBatch.from_arrays(
                    [ids_, *columns], names=["c_id", "c_n", "c_crc", "c_start", "c_length", "ids_crc32"]
                )

    made = texts.mapInArrow(
        run, f"c_id {kind}, c_n long, c_crc long, c_start long, c_length long, ids_crc32 long"
    ).distinct()
    same = [F.col(f"c_{c}") == F.col(c) for c in ("n", "crc", "start", "length")]
    joined = wanted.join(made, [F.col("w_id").eqNullSafe(F.col("c_id")), *same])
    return out.union(
        joined.select(
            F.col("w_id").alias("doc_id"), "start", "length", "ids_crc32", F.col("n").alias("doc_tokens"), "sequence_id", "offset"
        )
    )
