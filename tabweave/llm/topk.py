"""Operator 5: exact top-k inner products by dual-tree search over cover trees.

Every row goes to the block of the nearest of a few sampled centres (at most CENTRES;
a large block is cut by a hash of the id), and a block's radius is the largest
distance to its centre. Queries first search their own block; the k-th score found
there is a threshold below which nothing counts. A query is then sent only to blocks
whose centre and radius allow its threshold, and a block's rows only to the groups of
queries (neighbours, by their own block) of which some reach it.

Where a group of queries meets a block, both get a cover tree (farthest-first centres,
radii that shrink by `SHRINK` from level to level), and node pairs are visited best
bound first. A pair is left out if the largest inner product that the covering radii
allow is below the worst k-th score of the queries under the node. Bounds only ever
drop pairs that can't reach a result, so results are exact.

Scores are inner products of floor(256 * x), exact in double precision up to 2^53;
beyond that the leaves are multiplied as Python integers.

Defined results: vectors that are null, or hold null or non-finite components, take
no part; vectors of different length aren't compared; a query id that repeats is
asked once (its smallest vector); candidates that carry the query's id are its own;
equal scores go to the smaller id; fewer than k candidates give fewer rows; an empty table gives an empty result; columns
of other names, those used inside included, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep

DATA_BLOCK, QUERY_BLOCK, LEAF, FAN, SHRINK = 8192, 2048, 256, 16, 1.3
#: Centres at most: a bounded sample, first by a hash of the id, that comes to the driver.
CENTRES = 256


class Node:
    __slots__ = ("at", "centre", "radius", "norm", "children")

    def __init__(self, at: np.ndarray, centre: np.ndarray, radius: float, children: list):
        self.at, self.centre, self.radius, self.children = at, centre, radius, children
        self.norm = float(np.sqrt(centre @ centre))


def build(x: np.ndarray, at: np.ndarray, first: int) -> Node:
    """The cover tree of rows `at`, with row `first` as the root's centre."""
    far = np.sqrt(np.maximum(((x[at] - x[first]) ** 2).sum(1), 0))
    radius = float(far.max()) if len(at) else 0.0
    if len(at) <= LEAF or radius == 0:
        return Node(at, x[first], radius, [])
    owner, centres = np.zeros(len(at), np.int64), [first]
    while far.max() > radius / SHRINK and len(centres) < FAN:
        c = int(at[far.argmax()])
        d = np.sqrt(((x[at] - x[c]) ** 2).sum(1))
        owner[d < far] = len(centres)
        far = np.minimum(far, d)
        centres.append(c)
    return Node(at, x[first], radius, [build(x, at[owner == k], c) for k, c in enumerate(centres) if (owner == k).any()])


def _bound(q: Node, d: Node) -> float:
    return float(q.centre @ d.centre) + q.norm * d.radius + q.radius * (d.norm + d.radius)


class Search:
    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, worst: np.ndarray | None = None):
        self.q, self.qi, self.d, self.di, self.k = queries, query_ids, data, data_ids, k
        self.best: list[list[tuple]] = [[] for _ in range(len(queries))]
        self.worst = np.full(len(queries), -np.inf) if worst is None else worst.copy()
        self.length = np.sqrt((queries * queries).sum(1))
        high = float(max(np.abs(queries).max(initial=0), np.abs(data).max(initial=0)))
        self.slack = _slack(queries, data)
        self.exact = high * high * queries.shape[1] < 2.0**53
        self.visited = 0

    def run(self) -> None:
        if len(self.q) and len(self.d):
            self.visit(build(self.q, np.arange(len(self.q)), 0), build(self.d, np.arange(len(self.d)), 0))

    def visit(self, q: Node, d: Node) -> None:
        if _bound(q, d) + self.slack < self.worst[q.at].min():
            return
        if not q.children and not d.children:
            # the same bound once more, for each query by itself
            reach = self.q[q.at] @ d.centre + self.length[q.at] * d.radius + self.slack >= self.worst[q.at]
            return self.meet(q.at[reach], d.at)
        if d.children and (not q.children or d.radius >= q.radius):
            for c in sorted(d.children, key=lambda c: -_bound(q, c)):
                self.visit(q, c)
        else:
            for c in q.children:
                self.visit(c, d)
        return None

    def meet(self, q: np.ndarray, d: np.ndarray) -> None:
        self.visited += len(q) * len(d)
        if self.exact:
            scores = self.q[q] @ self.d[d].T
        else:
            scores = np.array([[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in self.d[d]] for x in self.q[q]], object)
        good = (scores >= self.worst[q][:, None]) & (self.qi[q][:, None] != self.di[d][None])
        for r in np.flatnonzero(good.any(1)):
            i, cols = q[r], np.flatnonzero(good[r])
            if len(cols) > self.k:
                cols = cols[np.lexsort((self.di[d[cols]], -scores[r, cols]))[: self.k]]
            own = sorted(self.best[i] + [(-int(scores[r, c]), int(self.di[d[c]])) for c in cols])[: self.k]
            self.best[i] = own
            if len(own) == self.k:
                self.worst[i] = -own[-1][0]


def _matrix(t: pa.Table) -> np.ndarray:
    v = t.column("v").combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)


def whole(vector: str = "embedding") -> Column:
    """True for vectors that take part."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _slack(*arrays: np.ndarray) -> float:
    """More than rounding can take from a bound."""
    high = float(max(np.abs(x).max(initial=0) for x in arrays))
    return 1 + 1e-9 * high * high * arrays[0].shape[1]


def _by_length(batch: pa.RecordBatch) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and matrix of the vectors of each length."""
    v = batch.column("v")
    size, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.cumsum(size) - size
    return [(d, at, flat[start[at][:, None] + np.arange(d)]) for d in np.unique(size).tolist() for at in [np.flatnonzero(size == d)]]


def _renewed(df: DataFrame) -> DataFrame:
    """df with columns that a join of it with its own source can tell apart."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query row."""
    rows = vectors.where(whole(vector)).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * 256)).alias("v"), is_query.alias("asks"))
    rows = rows.where("id is not null")
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(min(CENTRES, n // data_block + 1)).select("v").collect()
    centres = [np.array(r[0], np.float64) for r in sample]
    of = {d: [i for i, c in enumerate(centres) if len(c) == d] for d in {len(c) for c in centres}}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, far = np.full(b.num_rows, -1, np.int64), np.zeros(b.num_rows)
            for d, at, x in _by_length(b):
                for i in of.get(d, ()):
                    own = np.sqrt(((x - centres[i]) ** 2).sum(1))
                    near = (block[at] < 0) | (own < far[at])
                    block[at[near]], far[at[near]] = i, own[near]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block), pa.array(far)], names=[*b.schema.names, "block", "far"])

    placed = keep(rows.mapInArrow(assign, "id long, v array<long>, asks boolean, block long, far double").withColumn("dim", F.size("v")))
    # a row for each centre, and one for vectors of a length that no centre has
    stats = placed.groupBy("block").agg(F.max("far").alias("radius"), F.count("*").alias("n"), F.count_if("asks").alias("asked"))
    radius = {r["block"]: r["radius"] for r in stats.collect()}
    used = {d: [i for i in own if i in radius] for d, own in of.items()}
    parts = stats.select("block", F.expr(f"n div {data_block} + 1").alias("subs"), F.expr(f"asked div {query_block} + 1").alias("query_subs"))
    dealt = placed.join(F.broadcast(parts), "block")
    deal = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(m))
    copies = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1))
    queries = dealt.where("asks").groupBy("dim", "id").agg(F.min_by(F.struct("v", "block", "query_subs"), "v").alias("q")).select("dim", "id", "q.*")
    queries = _renewed(queries.withColumn("group", deal("q", "query_subs")).withColumn("home", F.col("block")))
    data = dealt.select("dim", "id", "v", "block", "query_subs", deal("d", "subs").alias("sub"))

    def searched(q: pa.Table, d: pa.Table) -> Search | None:
        if not len(q) or not len(d):
            return None
        s = Search(_matrix(q), q.column("id").to_numpy(), _matrix(d), d.column("id").to_numpy(), k, q.column("worst").to_numpy() if "worst" in q.column_names else None)
        s.run()
        return s

    def first(q: pa.Table, d: pa.Table) -> pa.Table:
        s = searched(q, d)
        return q.select(["dim", "id", "v", "home", "group"]).append_column("worst", pa.array(s.worst if s else np.full(len(q), -np.inf)))

    on = ("dim", "block", "group")
    near = data.where("sub = 0").withColumn("group", copies("query_subs"))
    asking = keep(queries.groupBy(*on).cogroup(near.groupBy(*on)).applyInArrow(first, "dim int, id long, v array<long>, home long, group long, worst double"))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks that each query has to see."""
        for b in batches:
            worst, to = b.column("worst").to_numpy(), [[-1] for _ in range(b.num_rows)]
            for d, at, x in _by_length(b):
                if d in used:
                    own, length = used[d], np.sqrt((x * x).sum(1))
                    c = np.array([centres[i] for i in own])
                    bound = x @ c.T + length[:, None] * np.array([radius[i] for i in own]) + _slack(x, c) + 1e-9 * length[:, None]
                    for r, good in zip(at.tolist(), bound >= worst[at][:, None], strict=True):
                        to[r] = [own[j] for j in np.flatnonzero(good)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to, pa.list_(pa.int64()))], names=[*b.schema.names, "blocks"])

    sent = asking.mapInArrow(reach, "dim int, id long, v array<long>, home long, group long, worst double, blocks array<long>")
    sent = keep(sent.select("dim", "id", "v", "home", "group", "worst", F.explode("blocks").alias("block")))
    groups = _renewed(sent.select("dim", "home", "group", "block")).distinct()
    met = data.join(groups, ["dim", "block"])
    left = _renewed(sent.join(F.broadcast(parts), "block").withColumn("sub", copies("subs")).drop("subs", "query_subs"))

    def pair(q: pa.Table, d: pa.Table) -> pa.Table:
        s = searched(q, d)
        found = [(i, c, -m) for i, best in zip(q.column("id").to_pylist(), s.best, strict=True) for m, c in best] if s else []
        return pa.table({c: pa.array([f[j] for f in found], pa.int64()) for j, c in enumerate(("query_id", "vec_id", "score"))})

    on = ("dim", "block", "sub", "home", "group")
    found = left.groupBy(*on).cogroup(met.groupBy(*on)).applyInArrow(pair, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
