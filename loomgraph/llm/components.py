"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import settle, tidy

EDGES_PER_TASK = 50_000


def _star(edges: DataFrame, tasks: int) -> DataFrame:
    """Every u with its smallest neighbour, stored: joins see its true size and can split a hot u."""
    return settle(edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) from at most ``EDGES_PER_TASK`` edges, merged one by one towards the smaller root."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(u, u)
            up.setdefault(v, v)
            x, y = root(u), root(v)
            up[max(x, y)] = min(x, y)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["node", "root"])


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node with an edge; the root is the smallest node that can be reached.

    Edges are pushed towards smaller nodes until every node points at its root
    (logarithmically many rounds).  Each round is stored below the checkpoint
    folder, so a lost executor costs one round; nothing is collected.  Edges few
    enough for one task of a round are merged by one task, without rounds.
    """
    e = settle(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    )
    known = e.count()
    tasks = 1 + known // EDGES_PER_TASK  # few edges are handled by few tasks
    if not known:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    if tasks == 1:
        kind = e.schema["u"].dataType.simpleString()
        return e.coalesce(1).mapInArrow(tidy(_joined), f"node {kind}, root {kind}")
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _star(both, tasks).select("u", F.least("u", "m").alias("m"))
        large = settle(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks))
        low = _star(large, tasks)
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settle(small.union(low.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks))
        roots = e.select(F.col("v").alias("u")).distinct()
        moving = e.join(roots, "u", "left_semi").select("u")
        double = e.groupBy("u").count().where("count > 1").select("u")
        if moving.union(double).isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                roots.select(F.col("u").alias("node"), F.col("u").alias("root"))
            )
    raise RuntimeError("components did not settle")
