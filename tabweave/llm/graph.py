"""Connected components of large edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, tidy


#: Edges up to which one task finds the components (16 bytes an edge).
ONE_TASK = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of an edge (a, b) reaches.

    Up to ONE_TASK edges go through one task's union-find. More alternate two steps
    until nothing changes: every node's larger neighbours are linked to its smallest
    one, then its smaller ones are. Each step is a grouped minimum with partial sums
    and a join that can be split; a chain of n nodes takes about log(n) rounds, a star
    two.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = keep(edges)
    before, state = None, _state(edges)
    if state[0] <= ONE_TASK:
        return keep(edges.coalesce(1).mapInArrow(tidy(_united), "id long, component long"))
    while state != before:
        edges = keep(_link(_link(edges, larger=True), larger=False))
        before, state = state, _state(edges)
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return stars.unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node with the smallest one of its component: links to smaller nodes, paths halved on the way."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = root(u), root(v)
            above[max(u, v)] = min(u, v)
    ids = list(above)
    for i in range(0, len(ids), 100_000):
        some = ids[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], names=["id", "component"])


def _link(edges: DataFrame, larger: bool) -> DataFrame:
    """Edges (u, v), u > v. larger: each node's larger neighbours get its smallest one; else its smaller ones do."""
    if larger:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        rest = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = rest.unionAll(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()
