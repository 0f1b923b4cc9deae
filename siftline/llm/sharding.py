"""Shards of near-equal size whose groups stay whole: longest processing time first."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.operators.ranking import with_position
from siftline.session import checkpointed

#: A group with more than this part of all rows is joined by broadcast, so there are fewer of them than this.
HOT_PART = 1024
#: Places of shards in partitions that are broadcast; above it they are joined by a shuffle.
BROADCAST_BLOCKS = 1 << 20


def longest_first(jobs: Iterable[tuple[str, int]], machines: int) -> dict[str, int]:
    """The machine of each job: largest first, each to the least-loaded machine (lowest number on ties)."""
    heap = [(0, m) for m in range(machines)]
    placed = {}
    for name, size in sorted(jobs, key=lambda job: (-job[1], job[0])):
        load, machine = heapq.heappop(heap)
        placed[name] = machine
        heapq.heappush(heap, (load + size, machine))
    return placed


def classes_first(classes: Iterable[tuple[int, int]], machines: int) -> Iterator[tuple[int, dict[int, int]]]:
    """Of each (size, how many jobs), largest size first: how many of its jobs each machine takes.

    The loads are those of ``longest_first``, without a step for every job: jobs of one size go to the
    smallest of the loads ``load + j * size``, so many of them are dealt at once, by the load that the
    last one meets.
    """
    heap = [(0, m) for m in range(machines)]
    for size, count in sorted(classes, reverse=True):
        taken: dict[int, int] = {}
        if size <= 0:
            taken[heap[0][1]] = count
        elif count <= machines:
            for _ in range(count):
                load, machine = heapq.heappop(heap)
                taken[machine] = taken.get(machine, 0) + 1
                heapq.heappush(heap, (load + size, machine))
        else:
            # The largest level with no more than ``count`` places below it.
            low, high = heap[0][0], heap[0][0] + size * count
            while low < high:
                level = (low + high + 1) // 2
                if sum(-(-(level - load) // size) for load, _ in heap if load < level) <= count:
                    low = level
                else:
                    high = level - 1
            taken = {m: -(-(low - load) // size) for load, m in heap if load < low}
            rest = count - sum(taken.values())
            at_level = sorted(m for load, m in heap if load <= low and (low - load) % size == 0)
            for m in at_level[:rest]:
                taken[m] = taken.get(m, 0) + 1
            heap = [(load + size * taken.get(m, 0), m) for load, m in heap]
            heapq.heapify(heap)
        yield size, taken


def text_key(text: Column) -> Column:
    """Key of equal texts; null texts are a group of their own."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit("null"))


def _group_shards(groups: DataFrame, n_shards: int) -> DataFrame:
    """``key, rows, shard`` of the groups (``key, bytes, rows``), longest first.

    The driver sees sizes and how many groups have them: sizes are few, since k different ones need
    k * k / 2 bytes. Groups are placed by size, and those of one size are handed out by their place.
    """
    placed = with_position(groups, [F.desc("bytes"), F.col("key")])
    counted = placed.groupBy("bytes").count().toArrow()
    classes = zip(*(counted.column(c).to_pylist() for c in ("bytes", "count")), strict=True)
    sizes, before, upto, machines, passed = [], [], [], [], 0
    for size, taken in classes_first(classes, n_shards):
        sizes.append(size)
        before.append(passed)
        ends = []
        for jobs in taken.values():
            passed += jobs
            ends.append(passed - before[-1])
        upto.append(ends)
        machines.append(list(taken))
    plan = pa.table(
        [
            pa.array(sizes, pa.int64()), pa.array(before, pa.int64()),
            pa.array(upto, pa.list_(pa.int64())), pa.array(machines, pa.list_(pa.int32())),
        ],
        names=["bytes", "before", "upto", "machines"],
    )
    place = F.col("position") - 1 - F.col("before")
    shard = F.get("machines", F.size(F.filter("upto", lambda end: end <= place)))
    return placed.join(groups.sparkSession.createDataFrame(plan), "bytes").select("key", "rows", shard.alias("shard"))


def shards(docs: DataFrame, n_shards: int, size: Column, key: Column, keep: dict[str, Column]) -> DataFrame:
    """The columns of ``keep`` with ``size``, ``shard`` (0 up) and ``slot`` (gapless in the shard).

    Rows of equal ``key`` share a shard; every group is scheduled, the largest first, to the shard with
    the fewest bytes. Rows of a large group are not moved: its shard is broadcast to them. Null ids are
    rows like others, repeated rows each have a slot, a null size counts as zero, an empty table gives no
    rows. Only the named columns are used, whatever others there are.
    """
    slim = checkpointed(
        docs.select(
            *(c.alias(f"k_{n}") for n, c in keep.items()),
            F.coalesce(size.cast("long"), F.lit(0)).alias("size"),
            key.alias("key"),
        )
    )
    groups = checkpointed(slim.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    shard_of = checkpointed(_group_shards(groups, n_shards))
    whole = shard_of.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot = shard_of.where(F.col("rows") * HOT_PART > whole).select("key", F.col("shard").alias("own"))
    rows = slim.join(F.broadcast(hot), "key", "left")
    large = rows.where("own IS NOT NULL").withColumnRenamed("own", "shard")
    other = rows.where("own IS NULL").drop("own").join(shard_of.drop("rows"), "key")
    placed = checkpointed(
        large.unionByName(other)
        .drop("key")
        .sortWithinPartitions("shard")
        .withColumn("part", F.spark_partition_id())
        .withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        placed.groupBy("part", "shard")
        .agg(F.min("at").alias("first"), F.count("*").alias("n"))
        .select("part", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    )
    if placed.rdd.getNumPartitions() * n_shards <= BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    return placed.join(blocks, ["part", "shard"]).select(
        *(F.col(f"k_{n}").alias(n) for n in keep), "size", "shard", (F.col("at") + F.col("shift")).cast("long").alias("slot")
    )


def document_shards(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """All documents in shards near equal in bytes; equal texts share a shard.

    A null text has size 1 and the checksum of no bytes. ``grown_shard`` is null: the law is
    ``bytes``, not a function of the key.
    """
    text = F.col("text")
    raw = F.coalesce(text, F.lit("")).cast("binary")
    out = shards(
        docs,
        n_shards,
        F.octet_length(raw) + 1,
        text_key(text),
        {"doc_id": F.col("doc_id"), "text_crc32": F.crc32(raw)},
    )
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
