"""Connected components of a link table, by union-find inside tasks and star passes between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm import common

#: Links that a task contracts at once; more are contracted in several runs.
RUN_LINKS = 500_000


def _stars(u: list, v: list) -> dict:
    """Every node that is not the smallest of its group, with the smallest."""
    above: dict = {}

    def root(x):
        top = x
        while (up := above.get(top, top)) != top:
            top = up
        while x != top:
            above[x], x = top, above[x]
        return top

    for a, b in zip(u, v, strict=True):
        a, b = root(a), root(b)
        if a != b:
            above[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(above)}


def _kept(links: DataFrame) -> DataFrame:
    """The links stored, by as many tasks as there are cores: links are few and narrow, and so are the runs then."""
    return common.stored(links.coalesce(links.sparkSession.sparkContext.defaultParallelism), "links")


def _lowest(edges: DataFrame) -> DataFrame:
    """The smallest ``low`` that each ``u`` hangs under; stored, so that joins with it can split a hot node."""
    return _kept(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each link ``u`` > ``v`` with ``v`` replaced by the smallest node that ``v`` hangs under."""
    up = edges.join(_lowest(edges), F.col("v") == F.col("node"), "left")
    return _kept(up.select("u", F.coalesce("low", "v").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node, and all it hangs under, under the smallest of these."""
    down = edges.join(_lowest(edges), F.col("u") == F.col("node"))
    ends = down.select(F.explode(F.array("u", "v")).alias("u"), F.col("low").alias("v"))
    return _kept(ends.where("u <> v").distinct())


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node hangs under one other only, which hangs under none."""
    none = F.lit(None).cast(edges.schema["u"].dataType)
    ends = F.array(
        F.struct(F.col("u").alias("node"), F.col("v").alias("up")), F.struct(F.col("v").alias("node"), none.alias("up"))
    )
    nodes = edges.select(F.explode(ends).alias("x")).groupBy("x.node")
    nodes = nodes.agg(F.min("x.up").alias("low"), F.max("x.up").alias("high"), F.max(F.col("x.up").isNull()).alias("root"))
    return nodes.where("low <> high or (root and low is not null)").isEmpty()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) for every node of the links ``a``-``b``.

    Each round first contracts the links where they lie, in runs of bounded size, and ends if a forest
    of stars is left. Else a large-star and a small-star pass bring the smallest node that each node
    hangs under to all its links, wherever they are. Both are a minimum by key, which combines before
    the shuffle, and a join of stored tables, which splits hot keys. What is connected stays so. Links
    in any direction, repeated links and loops are allowed; nulls link nothing. No links come to the
    driver. A table without links gives no rows.
    """
    kind = links.schema["a"].dataType.simpleString()
    edges = links.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )

    def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for batch in batches:
            u += batch.column("u").to_pylist()
            v += batch.column("v").to_pylist()
            if len(u) >= RUN_LINKS:
                yield out(_stars(u, v), batch.schema)
                u, v = [], []
            schema = batch.schema
        if u:
            yield out(_stars(u, v), schema)

    def out(stars: dict, schema: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array(list(stars), schema.field("u").type), pa.array(list(stars.values()), schema.field("v").type)]
        return pa.RecordBatch.from_arrays(columns, names=["u", "v"])

    edges = _kept(edges.distinct())
    for _ in range(most_rounds):
        edges = _kept(edges.mapInArrow(contracted, f"u {kind}, v {kind}").distinct())
        if _is_star_forest(edges):
            break
        edges = _small_star(_large_star(edges))
    else:
        raise RuntimeError(f"links did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
